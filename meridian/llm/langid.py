"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on the executors and sums them by (language, bucket); what reaches the driver is
bounded by languages x buckets. The log-probability matrix goes to the executors with the function that
scores, which holds a batch as sparse rows (bucket indices, text boundaries) and sums matrix entries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, unit_hash
from .text import blocks

SIZES = (1, 2, 3)
BITS = 15
SCHEMA = "lang_pred string, score double"


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # (len(langs), 2**bits + 1); the last column is 0, for positions without an n-gram
    log_prior: np.ndarray
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for b in blocks(texts, max(self.sizes)):
            for n in self.sizes:
                at = b.buckets(n, self.bits)
                for k in range(len(self.langs)):
                    np.add.at(out[:, k], b.docs, np.add.reduceat(self.log_prob[k][at], b.starts, dtype=np.float64))
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """The likeliest language and its posterior; ``und`` and 0 for a null text or one without a letter."""
        known = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))] if self.langs else []
        lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        if known:
            s = self.scores([texts[i] for i in known]) + self.log_prior
            s = np.exp(s - s.max(axis=1, keepdims=True))
            s /= s.sum(axis=1, keepdims=True)
            best = s.argmax(axis=1)
            lang[known] = np.array(self.langs, dtype=object)[best]
            score[known] = s[np.arange(len(known)), best]
        return pd.DataFrame({"lang_pred": lang, "score": score})


def train(docs: DataFrame, max_docs: int = 20_000, max_langs: int = 256, least: int = 50, bits: int = BITS, sizes=SIZES, alpha: float = 0.5) -> LanguageModel:
    """Fit on a sample of about ``max_docs`` of the rows with a non-null lang outside fold 0, drawn by a hash of
    doc_id; of their languages the ``max_langs`` most frequent are learned. A rare language is drawn more often, so that
    about ``least`` of its documents (all, if it has fewer) are read; priors are the true shares. Whole texts count.
    Without such rows the model knows no language and answers ``und``."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    seen = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    langs = sorted(r["lang"] for r in seen)
    if not langs:
        return LanguageModel([], np.zeros((0, (1 << bits) + 1), np.float32), np.zeros(0), bits, tuple(sizes))
    total = sum(r["count"] for r in seen)
    index = {x: k for k, x in enumerate(langs)}
    width = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), width + 1), dtype=np.int64)
        for pdf in batches:
            pdf = pdf[pdf["lang"].isin(index)]
            owner = pdf["lang"].map(index).to_numpy(dtype=np.int64)
            for b in blocks(pdf["text"].tolist(), max(sizes)):
                lang = np.repeat(owner[b.docs], b.size)
                for n in sizes:
                    sums += np.bincount(lang * (width + 1) + b.buckets(n, bits), minlength=sums.size).reshape(sums.shape)
        lang, bucket = np.nonzero(sums[:, :width])
        yield pd.DataFrame({"k": lang.astype("int32"), "b": bucket.astype("int32"), "n": sums[lang, bucket]})

    chance = F.create_map(*(F.lit(x) for r in seen for x in (r["lang"], max(max_docs / total, least / r["count"]))))
    sample = rows.filter(unit_hash("doc_id", seed=3) < F.try_element_at(chance, F.col("lang"))).select("lang", "text")
    found = sample.mapInPandas(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(langs), width), alpha)
    counts[found["k"], found["b"]] += found["n"]
    log_prob = np.zeros((len(langs), width + 1), dtype=np.float32)
    log_prob[:, :width] = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    prior = np.array([next(r["count"] for r in seen if r["lang"] == x) for x in langs], dtype=float)
    return LanguageModel(langs, log_prob, np.log(prior / prior.sum()), bits, tuple(sizes))


def predictor(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A column struct(lang_pred, score) of ``text``, whatever other columns the rows have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: max_langs x 2**bits floats

    @F.pandas_udf(SCHEMA)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())

    return predict(F.col(text))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Repeated rows are each scored; an empty table gives none."""
    return docs.select("doc_id", held_out().alias("held_out"), predictor(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows, all their columns unchanged, whose text has a language that the model finds with at least ``min_score``."""
    p = predictor(docs, model)
    return docs.filter((p["lang_pred"] != "und") & (p["score"] >= min_score))
