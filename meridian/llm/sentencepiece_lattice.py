"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A batch's distinct marked words (a run of ``▁`` and what follows it) are sorted, which lays them out as the paths of a
trie, and walked depth-first: the forward state of a prefix is computed once and used by every word that begins with
it. A forward state holds, for the prefix, the best score, the last piece and where it begins.

For a unigram model the score is the sum of piece scores and every piece may follow every other. For a BPE model a sum
of scores does not give the library's pieces; there an edge from piece a to piece b exists only if merging their
joined text by rank leaves exactly a and b. Each prefix has one path over such edges, and it is the BPE encoding, so
the same search gives the library's result. Characters without a piece become their bytes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A character without a piece counts this much less than the worst piece, as in the library.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """What a .model file says: pieces, scores, kinds, model type (1 unigram, 2 BPE) and how texts are prepared."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, self.kinds = [], []
        self.type, self.dummy_prefix, self.remove_extra, charsmap = 1, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif field == 2:
                self.type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.remove_extra = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap:
            raise ValueError("models that normalize characters are not supported")
        self.score = np.array(scores)
        self.id = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (1, 4)}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == 6}
        self.unknown = next((k for k, t in enumerate(self.kinds) if t == 2), 0)
        self.unknown_score = float(min((self.score[k] for k in self.id.values() if self.score[k] > -1e8), default=0.0)) - UNKNOWN_PENALTY
        #: Words may be encoded apart if no piece goes on with a mark after another character.
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())


class Lattice:
    """Encodes words of one model; keeps the ids of words met early, up to a bound."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.m = model
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if model.separable else re.compile("(?s).+")
        self.known: dict[str, tuple[bytes, float]] = {}
        self.pair: dict[int, bool] = {}
        self.states = 0
        # Every suffix of a piece, with the piece it is itself or -1; for BPE only pieces that merging leaves whole.
        whole = model.id if model.type != 2 else {p: k for p, k in model.id.items() if self._merged(p) == [p]}
        self.ends = {p[k:]: -1 for p in whole for k in range(len(p))} | whole

    def _merged(self, text: str) -> list[str]:
        """BPE by rank: the neighbours whose joined piece scores best are merged, leftmost first, until none is."""
        seq, ids, score = list(text), self.m.id, self.m.score
        while len(seq) > 1:
            best, at = None, -1
            for k in range(len(seq) - 1):
                piece = ids.get(seq[k] + seq[k + 1])
                if piece is not None and (best is None or score[piece] > best):
                    best, at = score[piece], k
            if best is None:
                break
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return seq

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves pieces a and b where they meet."""
        if len(self.pair) > 1_000_000:
            self.pair.clear()
        x, y = self.m.pieces[a], self.m.pieces[b]
        ok = self.pair[a * len(self.m.pieces) + b] = self._merged(x + y) == [x, y]
        return ok

    def encode_words(self, words: list[str]) -> dict[str, tuple[bytes, float]]:
        """Ids (little-endian unsigned 32 bit) and score of each word; ``words`` are distinct."""
        ends, score, bpe, size = self.ends, self.m.score.tolist(), self.m.type == 2, len(self.m.pieces)
        missing, may, pair = self.m.unknown_score, self._may_follow, self.pair
        out: dict[str, tuple[bytes, float]] = {}
        total, last, begin = [0.0], [-2], [0]  # forward states; -2: nothing yet, -1: a character without a piece
        before = ""
        for word in sorted(words):
            # Keep the states of the prefix shared with the word before.
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del total[keep + 1 :], last[keep + 1 :], begin[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                best, piece, start = None, -1, end - 1
                for a in range(end - 1, -1, -1):
                    k = ends.get(word[a:end])
                    if k is None:
                        break
                    p = last[a]
                    if k < 0 or p == -3:
                        continue
                    if bpe and p >= 0:
                        ok = pair.get(p * size + k)
                        if not (may(p, k) if ok is None else ok):
                            continue
                    s = total[a] + score[k]
                    if best is None or s > best:
                        best, piece, start = s, k, a
                if best is None:
                    if ends.get(word[end - 1], -1) >= 0:
                        total.append(0.0)
                        last.append(-3)  # no path ends here
                        begin.append(0)
                        continue
                    best = total[end - 1] + missing
                total.append(best)
                last.append(piece)
                begin.append(start)
            self.states += len(word) - keep
            path, at = [], len(word)
            while at:
                if last[at] >= 0:
                    path.append(last[at])
                elif self.m.bytes:
                    path.extend(self.m.bytes[b] for b in reversed(word[begin[at] : at].encode("utf-8", "surrogatepass")))
                else:
                    path.append(self.m.unknown)
                at = begin[at]
            out[word] = (np.array(path[::-1], dtype="<u4").tobytes(), total[-1])
            before = word
        return out

    def prepare(self, text: str | None) -> str:
        text = text or ""
        if self.m.remove_extra:
            text = re.sub(" +", " ", text).strip(" ")
        return ((" " if self.m.dummy_prefix else "") + text).replace(" ", MARK) if text else ""

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, float]]:
        """Ids and score of each text; a null or empty text has none."""
        cut = [self.words.findall(self.prepare(t)) for t in texts]
        known = self.known
        new = {w for ws in cut for w in ws if w not in known}
        found = self.encode_words(list(new))
        room = self.LIMIT - len(known)
        if room >= len(found):
            known.update(found)
            find = known.__getitem__
        else:
            find = lambda w: known.get(w) or found[w]
        out = []
        for ws in cut:
            hits = list(map(find, ws))
            out.append((b"".join([h[0] for h in hits]), sum([h[1] for h in hits])))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        m = self.m
        table = getattr(self, "_table", None)
        if table is None:
            table = [b"" if t in (2, 3) else bytes([int(p[3:5], 16)]) if t == 6 else p.replace(MARK, " ").encode() for p, t in zip(m.pieces, m.kinds, strict=True)]
            self._table = table
        text = b"".join([table[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if m.dummy_prefix and text.startswith(" ") else text


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One for each Python worker."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(Model.load(path))
    return _LATTICES[path]


ENCODED = "doc_id long, n_pieces long, ids_crc32 long, score double, round_trip boolean"


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text. A null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path)
        for batch in batches:
            rows = [np.frombuffer(b, "<u4").astype(np.int32) for b, _ in lat.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path)
        for batch in batches:
            texts = [lat.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """ENCODED per row: number of ids, their crc32 (little-endian unsigned 32 bit), sum of forward scores, and whether
    decoding gives the text back. A null text counts as empty: no ids, crc32 0, score 0, and true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = lat.encode(texts)
            same = [lat.decode(b) == (t or "") for (b, _), t in zip(got, texts, strict=True)]
            cols = ([len(b) // 4 for b, _ in got], [zlib.crc32(b) for b, _ in got], [float(s) for _, s in got], same)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", "n_pieces", "ids_crc32", "score", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ENCODED)
