"""BPE encoding as a transducer of bounded lookahead, and decoding by a machine that keeps only what is unfinished.

Merges at the left of a text can depend on what stands to their right, but only so far. A merge (x, y) changes
a boundary on whose right side the texts differ; the boundary then moves left by x. For it to move again, a later merge
(x', y') must end at it, and y' begins with x. So the boundary moves at most as far as the heaviest chain of merges of
rising rank in which each left part begins the next right part: that sum of lengths is the merge list's
*sufficient lookahead*. A token that ends at least so far before the last symbol read is stable whatever follows; it is
emitted and forgotten, so a word of any length takes the memory of one window.

A text is prepared slice by slice as the model file says (NFC, white space, lower case), cut into words, and each word
goes through the transducer. Words met early keep their ids, up to a bound."""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

#: The preparation that this module follows; files that ask for another are refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


BITS, MASK, NONE = 24, (1 << 24) - 1, 1 << 60


def _class(test: Callable[[str], bool], limit: int) -> str:
    """The code points up to ``limit`` that pass ``test``, as the inside of a character class."""
    out, first = [], None
    for cp in range(limit + 2):
        hit = cp <= limit and test(chr(cp))
        if hit and first is None:
            first = cp
        elif not hit and first is not None:
            out.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return "".join(out)


def _unsure(c: str) -> bool:
    """Whether libraries may differ on ``c`` by the age of their Unicode data: it is unassigned in Python's, or it is
    younger than Unicode 3.2 and composition or order depend on it."""
    if unicodedata.category(c) == "Cn":
        return True
    return bool(unicodedata.combining(c) or unicodedata.decomposition(c)) and unicodedata.ucd_3_2_0.category(c) == "Cn"


@functools.cache
def _patterns(limit: int) -> tuple[re.Pattern, re.Pattern]:
    """Words of lower-cased text with code points up to ``limit``, and characters that are left to the library."""
    letters, numbers = (_class(lambda c, k=k: unicodedata.category(c)[0] == k, limit) for k in "LN")
    space = _class(lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f", limit)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+"), re.compile(f"[{_class(_unsure, limit)}]")


@functools.cache
def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where it is visible, else the next one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Model:
    """Vocabulary, merges and added tokens of a ``tokenizers`` file of a byte-level BPE model with word ends."""

    def __init__(self, spec: dict, path: str = ""):
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        split = pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": WORDS} and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        if spec["normalizer"] != NORMALIZER or not split or pre[1]["type"] != "ByteLevel" or pre[1]["add_prefix_space"]:
            raise ValueError("the file asks for another preparation of texts")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")) or spec["decoder"] is not None:
            raise ValueError("the file asks for another kind of model")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be taken from the text as they stand")
        self.path, self.end = path, model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {k: t for t, k in [*vocab.items(), *self.added.items()]}
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: left id << BITS | right id to rank << BITS | id of the merged token.
        self.pairs = {vocab[a] << BITS | vocab[b]: rank << BITS | vocab[a + b] for rank, (a, b) in enumerate(self.merges)}
        self.plain = [vocab.get(s, -1) for s in byte_symbols()]
        self.final = [vocab.get(s + self.end, -1) for s in byte_symbols()]
        if min(self.plain + self.final) < 0:
            raise ValueError("the vocabulary lacks bytes")
        self.width = {k: self._length(t) for t, k in vocab.items()}
        self.lookahead = self._sufficient_lookahead()

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), path)

    def _length(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) and token != self.end else len(token)

    def _sufficient_lookahead(self) -> int:
        """Symbols after which a boundary cannot change: the heaviest chain of merges, as the module says. It needs
        merges whose parts are made by earlier ones, as in every trained list."""
        made: set[str] = set()
        chain: dict[str, int] = {}
        heaviest = 0
        for left, right in self.merges:
            if any(self._length(part) > 1 and part not in made for part in (left, right)):
                raise ValueError(f"merge {left} {right} uses a part that no earlier merge makes")
            if left + right in made:
                raise ValueError(f"two merges make {left + right}")
            made.add(left + right)
            plain = self._length(right) - (self._length(right) != len(right))  # the last symbol of a word is another than the same one within it
            weight = len(left) + max((chain.get(right[:k], 0) for k in range(1, plain + 1)), default=0)
            chain[left] = max(weight, chain.get(left, 0))
            heaviest = max(heaviest, weight)
        return heaviest


class Transducer:
    """Reads the symbols of one word and emits ids that nothing to follow can change."""

    def __init__(self, model: Model):
        self.m, self.window, self.most = model, [], 0

    def _merge(self, ids: list[int]) -> list[int]:
        """Merges of the lowest rank first, leftmost first, until none applies."""
        find, n = self.m.pairs.get, len(ids)
        if n <= 48:
            best = [find(a << BITS | b, NONE) for a, b in itertools.pairwise(ids)]
            while best and (found := min(best)) != NONE:
                k = best.index(found)
                ids[k : k + 2] = [found & MASK]
                del best[k]
                if k < len(best):
                    best[k] = find(ids[k] << BITS | ids[k + 1], NONE)
                if k:
                    best[k - 1] = find(ids[k - 1] << BITS | ids[k], NONE)
            return ids
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found, k, a, b) for k, (a, b) in enumerate(itertools.pairwise(ids)) if (found := find(a << BITS | b)) is not None]
        heapq.heapify(heap)
        while heap:
            found, k, a, b = heapq.heappop(heap)
            r = after[k]
            if ids[k] != a or r >= n or ids[r] != b:
                continue
            new = found & MASK
            ids[k], ids[r] = new, -1
            after[k] = r = after[r]
            if r < n:
                before[r] = k
                if (found := find(new << BITS | ids[r])) is not None:
                    heapq.heappush(heap, (found, k, new, ids[r]))
            if (p := before[k]) >= 0 and (found := find(ids[p] << BITS | new)) is not None:
                heapq.heappush(heap, (found, p, ids[p], new))
        return [k for k in ids if k >= 0]

    def feed(self, symbols: Iterable[int]) -> list[int]:
        """Ids that are stable after ``symbols``."""
        self.window.extend(symbols)
        self.most = max(self.most, len(self.window))
        room = len(self.window) - self.m.lookahead
        if room <= 0:
            return []
        out, end = [], 0
        for k in self._merge(list(self.window)):
            if end + self.m.width[k] > room:
                break
            end += self.m.width[k]
            out.append(k)
        del self.window[:end]
        return out

    def finish(self) -> list[int]:
        """Ids of what is left at the end of the word."""
        out, self.window = self._merge(self.window), []
        return out

    def word(self, data: bytes) -> Iterator[list[int]]:
        """The ids of a word, in stable pieces."""
        plain, final = self.m.plain, self.m.final
        step = 2 * self.m.lookahead + 64
        for k in range(0, len(data) - 1 if len(data) > step else 0, step):
            yield self.feed([plain[b] for b in data[k : min(k + step, len(data) - 1)]])
        rest = data[-1:] if len(data) > step else data
        self.window.extend([plain[b] for b in rest[:-1]])
        self.window.append(final[rest[-1]])
        yield self.finish()


class Decoder:
    """Turns ids into text as they come. ``form`` is "library", the tokens joined by one space, which is what the model
    file asks for by naming no decoder, or "text", the bytes of the tokens with word ends as spaces. What is kept
    between two calls is whether a token came before, or the bytes of an unfinished character."""

    def __init__(self, model: Model, form: str = "library"):
        self.tokens, self.form, self.begun = token_texts(model) if form == "library" else token_bytes(model), form, False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; ids that the model does not have are left out."""
        parts = [t for t in map(self.tokens.get, ids) if t is not None]
        if self.form == "text":
            return self.bytes.decode(b"".join(parts))
        text = (" " if self.begun and parts else "") + " ".join(parts)
        self.begun = self.begun or bool(parts)
        return text

    def finish(self) -> str:
        """What an unfinished character gives at the end: U+FFFD."""
        return self.bytes.decode(b"", True) if self.form == "text" else ""


_TABLES: dict[tuple[int, str], dict] = {}


def token_texts(model: Model) -> dict[int, str]:
    return model.tokens


def token_bytes(model: Model) -> dict[int, bytes]:
    key = (id(model), "bytes")
    if key not in _TABLES:
        value = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        added = set(model.added.values())

        def spelled(k: int, t: str) -> bytes:
            if k in added:
                return t.encode()
            ends = model.end and t.endswith(model.end)
            return b"".join(value[c] for c in (t[: -len(model.end)] if ends else t)) + (b" " if ends else b"")

        _TABLES[key] = {k: spelled(k, t) for k, t in model.tokens.items()}
    return _TABLES[key]


class Encoder:
    """Encodes texts with one model."""

    LIMIT, LONGEST = 300_000, 64
    #: Characters of a slice at least; it ends before an ASCII space, over which nothing composes and no word goes on.
    SLICE = 1 << 16

    def __init__(self, model: Model):
        self.m, self.run = model, Transducer(model)
        self.known: dict[str, tuple[int, ...]] = {}
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(model.added, key=len, reverse=True))) + ")") if model.added else None

    def _words(self, part: str) -> list[str]:
        """The words of a slice. Where libraries may differ on a character, the tokenizers library prepares the slice."""
        if part.isascii():
            return self.ascii.findall(part.lower())
        words, unsure = _patterns(sys.maxunicode if self.beyond.search(part) else 0xFFFF)
        if unsure.search(part):
            lib = _library(self.m.path)
            value = {s: b for b, s in enumerate(byte_symbols())}
            return [bytes(value[c] for c in w).decode() for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))]
        # A sigma at the end of a word is lowered as any other, character by character.
        return words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= self.SLICE else text.find(" ", at + self.SLICE)
            end = len(text) if end < 0 else end
            yield text[at:end]
            at = end

    def ids(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text in pieces of bounded length; a null or empty text has none."""
        known = self.known
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if part in self.m.added:
                yield [self.m.added[part]]
                continue
            for piece in self._slices(part):
                out: list[int] = []
                for w in self._words(piece):
                    hit = known.get(w)
                    if hit is None:
                        if len(w) > self.LONGEST:
                            for some in self.run.word(w.encode()):
                                out.extend(some)
                            continue
                        hit = tuple(k for some in self.run.word(w.encode()) for k in some)
                        if len(known) < self.LIMIT:
                            known[w] = hit
                    out.extend(hit)
                yield out


@functools.cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Model.load(path))


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text. A null or empty text, or one of white space, has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            rows = [array("i", (k for some in enc.ids(t) for k in some)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, form: str = "library") -> DataFrame:
    """(doc_id, text) of (doc_id, ids), in a form of ``Decoder``; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path).m
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                machine = Decoder(model, form)
                texts.append(machine.feed(ids or []) + machine.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """DIGEST per row: number of ids, sha256 of the decimal ids joined by one space, sha256 of the decoded text. Ids go
    from the encoder to the decoder and both digests piece by piece. A null text counts as empty (no ids, digests of
    nothing); repeated rows count each; a null doc_id stays null; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        decimal = {k: str(k) for k in enc.m.tokens}
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                count, a, b, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc.m)
                for ids in enc.ids(text.as_py()):
                    if ids:
                        a.update(((" " if count else "") + " ".join(map(decimal.__getitem__, ids))).encode())
                        b.update(machine.feed(ids).encode())
                        count += len(ids)
                b.update(machine.finish().encode())
                n.append(count)
                ids_hash.append(a.hexdigest())
                text_hash.append(b.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)
