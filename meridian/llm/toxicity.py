"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over the hashed character n-grams it holds (each
counted once), a document's score is a noisy-or, 1 - (1 - p0) prod(1 - p), over the sentences that hold any of the
model's n-grams and one empty sentence, so that neither length nor repetition alone speaks against a document. The
weights are fitted so that document scores meet document labels; the sentence scores then locate what offends. Features are chosen on the executors by how differently toxic and
other documents of the training sample hold them, so that the driver fits a model of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, held_out, materialize, unit_hash
from .text import Block, blocks

SIZES = (4, 5, 6)
BITS = 20
SCORE = "score double, n_sentences int, top_score double, top_start int, top_end int"
_ENDS = np.zeros(128, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentence_of(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each position the number of its sentence in the block, and for each sentence its first position. A new
    sentence begins after ``.``, ``!``, ``?`` or a line feed, and with every part of a text (so a text longer than
    a block is also cut there)."""
    end = (b.codes < 128) & _ENDS[np.minimum(b.codes, 127)]
    first = np.zeros(len(b.codes), dtype=bool)
    first[1:] = end[:-1] & ~end[1:]
    first[b.starts + b.size - 1] = False  # the space after a text is no sentence
    first[b.starts] = True
    return np.cumsum(first) - 1, np.flatnonzero(first)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicityModel:
    bucket: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def dense(self) -> np.ndarray:
        w = np.zeros((1 << self.bits) + 1)
        w[self.bucket] = self.weight
        return w

    def sentences(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of every sentence: text, start and end in that text's characters, probability, and whether it holds any of the
        model's n-grams; block by block."""
        if getattr(self, "_w", None) is None:
            self._w = self.dense()
            self._used = self._w != 0
        for b in blocks(texts, max(self.sizes)):
            sent, first = sentence_of(b)
            pairs = []
            for n in self.sizes:
                at = b.buckets(n, self.bits)
                hit = np.flatnonzero(self._used[at])
                pairs.append((sent[hit] << self.bits) + at[hit])
            pair = np.unique(np.concatenate(pairs))
            own = pair >> self.bits
            z = np.bincount(own, weights=self._w[pair & ((1 << self.bits) - 1)], minlength=len(first)) + self.bias
            part = np.searchsorted(b.starts, first, side="right") - 1
            shift = b.at[part] - b.starts[part] - 1  # one for the space before the text
            stop = np.append(first[1:], len(b.codes))
            stop = np.minimum(stop, b.starts[part] + b.own[part])
            yield b.docs[part], first + shift, stop + shift, _sigmoid(z), np.bincount(own, minlength=len(first)) > 0

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Noisy-or for each text; a null or empty one has the empty sentence only."""
        texts = [t if isinstance(t, str) else "" for t in texts]
        n = len(texts)
        log_clean, count = np.full(n, np.log1p(-_sigmoid(np.float64(self.bias)))), np.zeros(n, dtype=np.int32)
        top, start, end = np.full(n, -1.0), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        for doc, a, z, p, holds in self.sentences(texts):
            log_clean += np.bincount(doc[holds], weights=np.log1p(-np.minimum(p[holds], 1 - 1e-12)), minlength=n)
            count += np.bincount(doc, minlength=n).astype(np.int32)
            best = np.lexsort((a, -p, doc))
            best = best[np.unique(doc[best], return_index=True)[1]]
            better = best[p[best] > top[doc[best]]]
            k = doc[better]
            top[k], start[k], end[k] = p[better], np.maximum(a[better], 0), z[better]
        end = np.minimum(end, [len(t) for t in texts]).astype(np.int32) if n else end
        return pd.DataFrame({"score": -np.expm1(log_clean), "n_sentences": count, "top_score": top, "top_start": start, "top_end": end})


def _features(texts: list[str], bits: int, sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: text, sentence (numbered on from block to block) and bucket of every n-gram."""
    base = 0
    for b in blocks(texts, max(sizes)):
        sent, first = sentence_of(b)
        doc = np.repeat(b.docs, b.size)
        for n in sizes:
            at = b.buckets(n, bits)
            ok = at < 1 << bits
            yield doc[ok], sent[ok] + base, at[ok]
        base += len(first)


def noisy_or_fit(doc: np.ndarray, sent: np.ndarray, feature: np.ndarray, n_features: int, label: np.ndarray, weight: np.ndarray, doc_of_sentence: np.ndarray, rounds: int = 150, l2: float = 1e-3, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the weighted log-likelihood of bag labels under noisy-or, by AdaGrad.
    The gradient for a sentence's logit is p (1 - P) / P in a toxic bag and -p in another."""
    w, b = np.zeros(n_features), -4.0
    gw, gb = np.full(n_features, 1e-8), 1e-8
    n_sent, n_doc, total = len(doc_of_sentence), len(label), weight.sum()
    for _ in range(rounds):
        z = np.clip(np.bincount(sent, weights=w[feature], minlength=n_sent) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        big = np.clip(-np.expm1(np.bincount(doc_of_sentence, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_doc)), 1e-9, 1)
        bag = weight * np.where(label == 1, (1 - big) / big, -1.0)
        g = p * bag[doc_of_sentence]
        dw = np.bincount(feature, weights=g[sent], minlength=n_features) / total - l2 * w / n_features
        db = g.sum() / total
        gw += dw * dw
        gb += db * db
        w += rate * dw / np.sqrt(gw)
        b += rate * db / np.sqrt(gb)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, max_features: int = 1024, max_pairs: int = 8_000_000, bits: int = BITS, sizes=SIZES) -> ToxicityModel:
    """Fit on a sample of at most ``max_docs`` labelled documents outside fold 0, half of it toxic ones if there are
    so many, drawn by a hash of doc_id, and of these on as many, in the order of the hash, as have ``max_pairs`` pairs of
    a sentence and a feature together; weights restore the classes' shares. Of repeated labels the highest counts, null
    labels none; of repeated ids one text. Without both classes the model answers with the share of toxic labels."""
    spark = docs.sparkSession
    rows = labels.filter((fold() != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    flat = ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))), bits, tuple(sizes))
    if not n.get(1) or not n.get(0):
        return flat
    take = {1: min(n[1], max_docs // 2)}
    take[0] = min(n[0], max_docs - take[1])
    chance = F.when(F.col("y") == 1, take[1] / n[1]).otherwise(take[0] / n[0])
    # What the chance draws beyond the bound is cut in the order of the hash, so every layout draws the same documents.
    at = unit_hash("doc_id", seed=6)
    ids = rows.filter(at < chance).orderBy(at / chance, "doc_id").limit(max_docs)
    ids = ids.withColumnRenamed("doc_id", "__id")
    # The sample's ids are at most max_docs, so they may be broadcast: the texts of all others stay where they are.
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = materialize(sample, "toxicity-sample")
    drawn = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not drawn.get(1) or not drawn.get(0):
        return flat
    width = 1 << bits

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((2, width), dtype=np.int32)
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                seen = [at for _, _, at in _features([text], bits, sizes)]
                df[y, np.unique(np.concatenate(seen))] += 1
        at = np.flatnonzero(df.any(axis=0))
        yield pd.DataFrame({"b": at.astype("int32"), "n0": df[0, at].astype("int64"), "n1": df[1, at].astype("int64")})

    counts = sample.mapInPandas(frequency, "b int, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = lambda c, k: F.log((F.col(c) + 0.5) / (drawn[k] - F.col(c) + 0.5))
    # Evidence for toxicity: twice the odds at least, and by more than two standard errors.
    gap = odds("n1", 1) - odds("n0", 0)
    gain = gap / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.filter("n1 >= 2").select("b", gap.alias("gap"), gain.alias("g")).filter("gap >= 0.7 and g >= 2")
    best = best.orderBy(F.desc("g"), "b").limit(max_features).select("b").toPandas()
    bucket = np.sort(best["b"].to_numpy(dtype=np.int64))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot = np.full(width + 1, -1, dtype=np.int32)
        slot[bucket] = np.arange(len(bucket))
        for pdf in batches:
            rows = []
            for doc_id, text, y in zip(pdf["doc_id"], pdf["text"], pdf["y"], strict=True):
                pairs = []
                for _, s, at in _features([text], bits, sizes):
                    f = slot[at]
                    pairs.append((s[f >= 0] << bits) + f[f >= 0])
                pair = np.unique(np.concatenate(pairs))
                # Sentences that hold features are numbered from 1; 0 is the empty one.
                s = np.unique(pair >> bits, return_inverse=True)[1] + 1
                rows.append((doc_id, y, int(s.max(initial=0)) + 1, s.astype("<i4").tobytes(), (pair & (width - 1)).astype("<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "y", "n", "s", "f"])

    held = materialize(sample.mapInPandas(bags, "doc_id long, y int, n int, s binary, f binary"), "toxicity-bags")
    # Of at most max_docs rows: how many pairs come before, in the order of the hash.
    before = F.sum(F.length("s") / 4 + 1).over(Window.orderBy(unit_hash("doc_id", seed=6), "doc_id"))
    few = held.select("doc_id", before.alias("upto")).filter(F.col("upto") <= max_pairs).select("doc_id")
    fit = held.join(F.broadcast(few), "doc_id").orderBy("doc_id").toPandas()
    if not len(fit):
        return flat
    base = np.concatenate(([0], np.cumsum(fit["n"])))
    sent = np.concatenate([np.frombuffer(s, "<i4") + np.int32(base[k]) for k, s in enumerate(fit["s"])])
    feature = np.concatenate([np.frombuffer(f, "<i4") for f in fit["f"]])
    owner = np.repeat(np.arange(len(fit)), fit["n"])
    y = fit["y"].to_numpy()
    weight = np.where(y == 1, n[1] / drawn[1], n[0] / drawn[0])
    w, b = noisy_or_fit(owner[sent], sent, feature, len(bucket), y, weight / weight.mean(), owner)
    used = w != 0
    return ToxicityModel(bucket[used], w[used].astype(np.float32), b, bits, tuple(sizes))


def scorer(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """A column struct of SCORE for ``text``, whatever other columns the rows have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: max_features weights

    @F.pandas_udf(SCORE)
    def score(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())

    return score(F.col(text))


def detect(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, sentence count, and the span and score of the worst sentence."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, model).alias("p"))
    return scored.select("doc_id", "held_out", "p.score", F.when(F.col("p.score") >= 0.5, 1).otherwise(0).alias("predicted"), "p.n_sentences", "p.top_score", "p.top_start", "p.top_end")


def locate(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The offending sentences: a row (doc_id, start, end, score, sentence) for each that scores at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), [t if isinstance(t, str) else "" for t in pdf["text"]]
            for doc, a, z, p, _ in shared.value.sentences(texts):
                at = np.flatnonzero(p >= threshold)
                found = [(ids[doc[k]], max(int(a[k]), 0), min(int(z[k]), len(texts[doc[k]])), float(p[k])) for k in at]
                yield pd.DataFrame([(*x, texts[doc[k]][x[1] : x[2]]) for k, x in zip(at, found, strict=True)], columns=["doc_id", "start", "end", "score", "sentence"])

    return docs.select("doc_id", "text").mapInPandas(spans, "doc_id long, start int, end int, score double, sentence string")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, all their columns unchanged, that score under 0.5."""
    return docs.filter(scorer(docs, model)["score"] < 0.5)
