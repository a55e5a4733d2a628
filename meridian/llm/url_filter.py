"""URL filtering by rules and, where no rule fits, by gradient-boosted trees on lexical features.

The URLs that rules decide are the labelled ones. Trees are boosted on a bounded sample of them, on histograms of
features, and applied on the executors to every URL that no rule decides."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the contract of the query: (host, path, verdict).
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to
    ``?``, ``#`` or the end. Both are empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. A rule fits its host and all subdomains, if the path
    starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "query_length", "fragment", "hyphens", "last_segment", "top_rate", "top_count", "domain_rate", "domain_count", "ending_rate", "segment_rate", "secure")


def _parts(url: str | None) -> tuple[str, str, str, str]:
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else url
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path, query, fragment


def _suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    labels = host.split(".")
    last = path.rstrip("/").rpartition("/")[2]
    ending = "." + last.rpartition(".")[2] if "." in last else "/" if path.endswith("/") else ""
    return "t:" + labels[-1], "d:" + ".".join(labels[-2:]), "e:" + ending, "s:" + path.split("/")[1] if path.count("/") > 1 else "s:"


@dataclass
class Lexicon:
    """How often the sample has a suffix, and the smoothed share of blocked URLs among them."""

    known: dict[str, tuple[float, float]]
    prior: float

    @classmethod
    def fit(cls, urls: list[str | None], y: np.ndarray, smooth: float = 10.0) -> Lexicon:
        n, bad = Counter(), Counter()
        for url, label in zip(urls, y.tolist(), strict=True):
            for s in _suffixes(*_parts(url)[:2]):
                n[s] += 1
                bad[s] += label
        prior = float(y.mean()) if len(y) else 0.0
        return cls({s: (math.log1p(k), (bad[s] + smooth * prior) / (k + smooth)) for s, k in n.items()}, prior)

    @classmethod
    def features_out_of_fold(cls, urls: list[str | None], y: np.ndarray, folds: int = 5) -> np.ndarray:
        """Features of labelled URLs, each from a lexicon that knows no label of its own fold: what the trees are fitted on
        must not tell them the answer. Equal URLs share a fold."""
        fold = np.array([zlib.crc32((u or "").encode("utf-8", "surrogatepass")) % folds for u in urls], dtype=int)
        out = np.zeros((len(urls), len(FEATURES)), dtype=np.float32)
        for k in range(folds):
            rest, mine = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            out[mine] = cls.fit([urls[i] for i in rest], y[rest]).features([urls[i] for i in mine])
        return out

    def features(self, urls: list[str | None]) -> np.ndarray:
        out = np.zeros((len(urls), len(FEATURES)), dtype=np.float32)
        none = (0.0, self.prior)
        for k, url in enumerate(urls):
            host, path, query, fragment = _parts(url)
            url = url or ""
            n = max(1, len(url))
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
            top, domain, ending, segment = (self.known.get(s, none) for s in _suffixes(host, path))
            out[k] = (len(url), len(host), len(path), host.count(".") + 1, path.count("/"), sum(map(str.isdigit, url)) / n, entropy, query.count("&") + 1 if query else 0, len(query), len(fragment), url.count("-"), len(path.rpartition("/")[2]), top[1], top[0], domain[1], domain[0], ending[1], segment[1], url.startswith("https"))
        return out


@dataclass
class Trees:
    """Complete binary trees of one depth: features and thresholds of inner nodes in heap order, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on quantile histograms. Deterministic."""
    n, d = x.shape
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(at == node)
                best = (1e-6, 0, np.inf)
                if len(mine) > 1:
                    whole = g[mine].sum() ** 2 / (h[mine].sum() + l2)
                    for j in range(d):
                        if not len(cuts[j]):
                            continue
                        b = binned[mine, j]
                        gl = np.cumsum(np.bincount(b, weights=g[mine], minlength=len(cuts[j]) + 1))
                        hl = np.cumsum(np.bincount(b, weights=h[mine], minlength=len(cuts[j]) + 1))
                        gain = gl[:-1] ** 2 / (hl[:-1] + l2) + (gl[-1] - gl[:-1]) ** 2 / (hl[-1] - hl[:-1] + l2) - whole
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), j, float(cuts[j][k]))
                feature[t, node], threshold[t, node] = best[1], best[2]
                at[mine] = 2 * node + 1 + (x[mine, best[1]] > best[2])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + l2)
        margin += value[t][leaf]
    return Trees(feature, threshold, value, base)


@dataclass
class UrlModel:
    lexicon: Lexicon
    trees: Trees

    def block_probability(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.trees.margin(self.lexicon.features(urls)), -40, 40)))


def train(labelled: DataFrame, max_urls: int = 20_000, max_length: int = 10_000) -> UrlModel:
    """Fit on at most ``max_urls`` distinct rows of ``labelled`` (url, verdict), the first by a hash of the URL, of URLs
    up to ``max_length`` characters. However often a URL occurs, it is drawn once. Without rows, or with one verdict
    only, the model gives their share of blocked."""
    rows = labelled.filter(F.col("url").isNotNull() & (F.length("url") <= max_length)).select("url", "verdict")
    distinct = rows.agg(F.approx_count_distinct("url")).first()[0]
    drawn = rows.withColumn("h", unit_hash("url", seed=4)).filter(F.col("h") < 1.2 * max_urls / max(1, distinct)).distinct()
    sample = drawn.orderBy("h", "url", "verdict").limit(max_urls).toPandas().sort_values(["url", "verdict"])
    urls, y = sample["url"].tolist(), (sample["verdict"] == "block").to_numpy(dtype=float)
    lexicon = Lexicon.fit(urls, y)
    if len(urls) < 2:
        return UrlModel(lexicon, Trees(np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 1)), -1.0))
    return UrlModel(lexicon, boost(Lexicon.features_out_of_fold(urls, y), y))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, model: UrlModel | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, block_probability (null where a rule decides). Without ``model``
    one is trained on the URLs that rules decide. A null URL has empty host and path and is judged by the model;
    repeated rows are judged each; an empty table gives no rows."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "by_rule": verdict})
    model = model or train(rows.filter("rule is not null").select("url", F.col("by_rule").alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded: 4 suffixes of max_urls URLs, and the trees

    @F.pandas_udf("double")
    def probability(urls: pd.Series, ruled: pd.Series) -> pd.Series:
        """Of the URLs that no rule decides."""
        out = np.full(len(urls), np.nan)
        todo = np.flatnonzero(~ruled.to_numpy(dtype=bool))
        out[todo] = shared.value.block_probability(urls.iloc[todo].tolist())
        return pd.Series(out)

    rows = rows.withColumn("p", probability(F.col("url"), F.col("rule").isNotNull()))
    by_model = F.when(F.col("p") >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), F.when(F.col("rule").isNull(), F.col("p")).alias("block_probability"))
