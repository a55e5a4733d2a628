"""Vectorised character n-grams over batches of texts, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], dtype=np.uint32)


def lowered(text: str) -> str:
    """Lower case with as many characters as ``text``, so that offsets hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low


class Block:
    """Code points of several texts or parts of texts. Part k starts at starts[k] and belongs to text docs[k];
    its first own[k] positions count here, the rest is the look-ahead of n-grams that begin in it."""

    def __init__(self, parts: list[str], docs: list[int], own: list[int], at: list[int]):
        raw = "".join(parts).encode("utf-32-le", "surrogatepass")
        self.codes = np.frombuffer(raw, dtype="<u4")
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.docs = np.array(docs, dtype=np.int64)
        self.own = np.array(own, dtype=np.int64)
        self.at = np.array(at, dtype=np.int64)

    def buckets(self, n: int, bits: int) -> np.ndarray:
        """For each position the bucket of the n-gram that begins there, 2**bits where none does."""
        codes, total = self.codes, len(self.codes)
        h = codes * _MULT[0]
        for j in range(1, n):
            h[: total - j] += codes[j:] * _MULT[j]
        h += np.uint32(n)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x846CA68B)
        h >>= np.uint32(32 - bits)
        out = h.astype(np.intp)
        valid = np.clip(np.minimum(self.own, self.size - n + 1), 0, None)
        gap = self.size - valid
        ends = np.cumsum(gap)
        out[np.repeat(self.starts + valid - (ends - gap), gap) + np.arange(ends[-1])] = 1 << bits
        return out


def blocks(texts: list[str], reach: int, block: int = 1 << 19) -> Iterator[Block]:
    """Blocks of at most about ``block`` characters that cover the whole of every text once; each text is
    lower-cased and padded with one space on both sides. ``reach`` is the longest n-gram."""
    parts, docs, own, at, total = [], [], [], [], 0
    for i, text in enumerate(texts):
        text = f" {lowered(text)} "
        for k in range(0, len(text), block):
            part = text[k : k + block + reach - 1]
            if parts and total + len(part) > block:
                yield Block(parts, docs, own, at)
                parts, docs, own, at, total = [], [], [], [], 0
            parts.append(part)
            docs.append(i)
            own.append(min(block, len(text) - k))
            at.append(k)
            total += len(part)
    if parts:
        yield Block(parts, docs, own, at)
