"""Language ID, toxicity, sharding, exact dedup and URL filter on small tables and against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.llm import exact_dedup, langid, sharding, text, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None) for i, t, *rest in rows for lang in [rest[0] if rest else None]], DOC)


HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "Straße Ünïcode 日本語 🎉"), (6, "word " * 5000), (7, "x" * 40000), (1, None), (4, "a"), (None, "null id"), (None, None), (8, "\x0b\x0c a\r\nb")]


def held(i) -> bool:
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0


def test_blocks_cover_every_ngram_once():
    texts = ["abc", "", "hello world " * 50, "İx"]
    for block in (7, 64, 1 << 19):
        got: dict = {}
        for b in text.blocks(texts, 3, block):
            for n in (1, 2, 3):
                at = b.buckets(n, 12)
                for d, h in zip(np.repeat(b.docs, b.size), at, strict=True):
                    if h < 1 << 12:
                        got[int(d), n, int(h)] = got.get((int(d), n, int(h)), 0) + 1
        for d, t in enumerate(texts):
            for n in (1, 2, 3):
                assert sum(v for k, v in got.items() if k[:2] == (d, n)) == max(0, len(t) + 2 - n + 1)
        if block == 7:
            first = got
        assert got == first


def test_language_model_equals_plain_bayes(spark):
    rows = [(k, f"{w} {w[::-1]} {k}", lang) for k in range(60) for lang, w in (("aa", "banana kiwi"), ("bb", "schnell heute"))]
    d = docs(spark, [(2 * k + (lang == "bb"), t, lang) for k, t, lang in rows])
    model = langid.train(d, bits=12)
    assert model.langs == ["aa", "bb"]
    counts = {x: np.full(1 << 12, 0.5) for x in model.langs}
    for k, t, lang in rows:
        if not held(2 * k + (lang == "bb")):
            for b in text.blocks([t], 3):
                for n in (1, 2, 3):
                    at = b.buckets(n, 12)
                    np.add.at(counts[lang], at[at < 1 << 12], 1)
    for k, x in enumerate(model.langs):
        assert np.allclose(model.log_prob[k][:-1], np.log(counts[x] / counts[x].sum()), atol=1e-5)
    got = {r["doc_id"]: r for r in langid.identify(d, model).collect()}
    assert all((r["lang_pred"] == "bb") == bool(i % 2) and 0.5 < r["score"] <= 1 and r["held_out"] == held(i) for i, r in got.items())


def test_language_of_hard_texts(spark):
    d = docs(spark, [(k, "der die das", "de") for k in range(20)]).unionByName(docs(spark, HARD))
    out = langid.identify(docs(spark, HARD).withColumns({"lang_pred": F.lit("x"), "score": F.lit(9), "held_out": F.lit(1)}), langid.train(d)).collect()
    assert len(out) == len(HARD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] == "de" for r in out if r["doc_id"] in (4, 5))
    empty = spark.createDataFrame([], DOC)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert langid.identify(docs(spark, HARD), langid.train(empty)).select("lang_pred").distinct().collect()[0][0] == "und"
    kept = langid.keep_identified(d, langid.train(d))
    assert kept.columns == d.columns and kept.filter("doc_id in (1, 2, 3) and text is null").isEmpty()


def test_language_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.identify(d, langid.train(d)).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.97


def test_noisy_or_gradient():
    rng = np.random.default_rng(0)
    doc_of = np.repeat(np.arange(40), 3)
    feature, sent = rng.integers(0, 5, 120), np.arange(120)
    y = np.array([int((feature[doc_of == d] == 2).any()) for d in range(40)])
    w, b = toxicity.noisy_or_fit(doc_of[sent], sent, feature, 5, y, np.ones(40), doc_of, rounds=800)
    p = 1 / (1 + np.exp(-(w[feature] + b)))
    score = 1 - np.array([np.prod(1 - p[doc_of == d]) for d in range(40)])
    assert ((score > 0.5) == y).all() and w.argmax() == 2


def test_toxicity_scores_and_locates(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows, labels = [], []
    for k in range(400):
        sents = [" ".join(rng.choice(words, 6)) + "." for _ in range(8)]
        if k % 5 == 0:
            sents[3] = "you are a grumblefoot indeed."
        rows.append((k, " ".join(sents)))
        labels.append((k, 1, int(k % 5 == 0)))
    d = docs(spark, rows)
    lab = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    out = {r["doc_id"]: r for r in toxicity.detect(d.withColumn("score", F.lit(1)), model).collect()}
    for k, t in rows:
        r = out[k]
        assert r["predicted"] == int(k % 5 == 0) and r["n_sentences"] == 8 and 0 <= r["score"] <= 1
        if k % 5 == 0:
            assert "grumblefoot" in t[r["top_start"] : r["top_end"]]
    spans = toxicity.locate(d, model).collect()
    assert {r["doc_id"] for r in spans} == {k for k, _ in rows if k % 5 == 0} and all("grumblefoot" in r["sentence"] and dict(rows)[r["doc_id"]][r["start"] : r["end"]] == r["sentence"] for r in spans)
    clean = toxicity.keep_clean(d, model)
    assert clean.columns == d.columns and clean.count() == 320
    hard = toxicity.detect(docs(spark, HARD), model).collect()
    assert len(hard) == len(HARD) and all(0 <= r["score"] < 0.5 for r in hard)
    # Noisy-or over sentences, by hand.
    doc, a, z, p, holds = next(iter(model.sentences([rows[0][1]])))
    empty = 1 / (1 + np.exp(-model.bias))
    assert out[0]["score"] == pytest.approx(1 - (1 - empty) * np.prod(1 - p[holds]), abs=1e-9)
    again = model.predict([rows[1][1], rows[1][1] + " " + rows[1][1] * 50])["score"]
    assert again[1] < 0.5


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, HARD)
    out = toxicity.detect(d, toxicity.train(d, none)).collect()
    assert len(out) == len(HARD) and all(r["predicted"] == 0 for r in out)
    one = spark.createDataFrame([(4, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.detect(d, toxicity.train(d, one)).count() == len(HARD)
    empty = spark.createDataFrame([], DOC)
    assert toxicity.detect(empty, toxicity.train(empty, one)).count() == 0


def _score(key: int, shard: int, weight: float, spark) -> float:
    h = spark.range(1).select(F.xxhash64(F.lit(key).cast("long"), F.lit(shard))).first()[0]
    return -weight / math.log(((h & (2**64 - 1)) >> 11) * 2.0**-53 + 2.0**-54)


def test_rendezvous_against_brute_force(spark):
    w = (1.0, 2.0, 0.5)
    d = spark.createDataFrame([(k,) for k in range(12)], "doc_id long")
    for r in sharding.assign(d, "doc_id", w).collect():
        s = [_score(r["doc_id"], i, x, spark) for i, x in enumerate((*w, sum(w) / 3))]
        assert r["shard"] == int(np.argmax(s[:3])) and r["grown_shard"] == int(np.argmax(s))


def test_rendezvous_balance_and_growth(spark):
    d = spark.range(20000).withColumnRenamed("id", "doc_id")
    out = sharding.assign(d, "doc_id", (1.0, 1.0, 2.0)).toPandas()
    share = out["shard"].value_counts(normalize=True)
    assert share[2] == pytest.approx(0.5, abs=0.02) and share[0] == pytest.approx(0.25, abs=0.02)
    moved = out[out["shard"] != out["grown_shard"]]
    assert (moved["grown_shard"] == 3).all() and len(moved) / len(out) == pytest.approx(0.25, abs=0.02)
    four = sharding.assign(d, "doc_id", (1.0, 1.0, 2.0, 4 / 3)).toPandas()
    assert (four["shard"] == out["grown_shard"]).all()
    with pytest.raises(ValueError):
        sharding.assign(d, "doc_id", ())


def test_shards_have_gapless_slots(spark):
    d = docs(spark, HARD).withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "size": F.lit(1)})
    out = sharding.shard_documents(d).toPandas()
    assert len(out) == len(HARD) and out["shard"].between(0, 39).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in HARD)
    assert sorted(zip(out["size"], out["text_crc32"], strict=True)) == want
    assert sharding.shard_documents(spark.createDataFrame([], DOC)).count() == 0
    many = sharding.with_slots(sharding.assign(spark.range(5000).withColumnRenamed("id", "doc_id"), "doc_id", (1.0, 1.0)), "shard", "doc_id", 5000, rows_per_task=300).toPandas()
    for _, g in many.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


def test_exact_dedup_against_brute_force(spark):
    rows = [*HARD, (20, "a b c"), (21, "abc"), (22, "a  b  c"), (19, "a  b  c"), (30, "é"), (31, "é")]
    out = exact_dedup.deduplicate(docs(spark, rows).withColumn("digest", F.lit("x")), exact_dedup.DigestIndex(spark)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str) == brute_exact(rows)
    assert {r["doc_id"] for r in out if r["kept"] and r["doc_id"] in (19, 20, 21, 22)} == {19}
    kept = exact_dedup.keep_first(docs(spark, rows), exact_dedup.DigestIndex(spark))
    assert kept.columns == docs(spark, rows).columns and kept.filter("doc_id = 4").count() == 1


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    a = exact_dedup.deduplicate(docs(spark, [(5, "one"), (6, "two"), (7, "o ne")]), index).toPandas().set_index("doc_id")
    assert a["kept"].to_dict() == {5: False, 6: True, 7: True}
    b = exact_dedup.deduplicate(docs(spark, [(1, "one"), (2, "three"), (3, "thr ee")]), index).toPandas().set_index("doc_id")
    assert b["kept"].to_dict() == {1: False, 2: False, 3: True}
    assert b.loc[1, "keep_id"] == 7 and b.loc[1, "group_size"] == 3 and b.loc[2, "group_size"] == 2
    assert index.table().count() == 3 and index.table().select("digest").distinct().count() == 3
    assert exact_dedup.deduplicate(spark.createDataFrame([], DOC), index).count() == 0
    plan = index.table().select("digest").hint("merge").join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_digest_index_counts_all_batches_and_repeats_one(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    run = lambda rows, batch: {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.deduplicate(docs(spark, rows), index, batch).collect()}
    assert run([(1, "same"), (2, "sa me")], "a") == {1: (2, 2, False), 2: (2, 2, True)}
    assert run([(3, "same")], "b") == {3: (2, 3, False)}
    assert run([(4, "same"), (5, "new")], "c") == {4: (2, 4, False), 5: (5, 1, True)}
    # A batch whose result was lost is run again and says the same, whether or not others came after it.
    assert run([(4, "same"), (5, "new")], "c") == {4: (2, 4, False), 5: (5, 1, True)}
    assert run([(1, "same"), (2, "sa me")], "a") == {1: (2, 4, False), 2: (2, 4, True)}
    assert run([(6, "new"), (7, "same")], "d") == {6: (5, 2, False), 7: (2, 5, False)}
    small = index.compact()
    assert small.buckets == 4 and small.batches().count() == 2 and {r["n"] for r in small.table().collect()} == {2, 5}
    out = exact_dedup.deduplicate(docs(spark, [(8, "same"), (9, "x")]), small).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(8, 2, 6, False), (9, 9, 1, True)}
    with pytest.raises(ValueError, match="letters"):
        exact_dedup.deduplicate(docs(spark, [(1, "x")]), index, "a/b")


def test_ids_with_several_texts_lose_none_and_keep_no_copy(spark):
    rows = [(1, "aaa"), (1, "bbb"), (2, "bbb "), (3, "aaa"), (None, "n"), (None, "m"), (None, " n"), (0, "m")]
    d = docs(spark, rows).withColumns({"h": F.lit(1), "n": F.lit(2), "__i": F.lit(3), "keep_id": F.lit("x")})
    out = exact_dedup.keep_first(d.drop("__i"), exact_dedup.DigestIndex(spark))
    assert sorted((r["text"] for r in out.collect())) == [" n", "aaa", "bbb ", "m"]
    assert out.columns == d.drop("__i").columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(None, " n"), (1, "aaa"), (2, "bbb "), (0, "m")}
    kept = exact_dedup.deduplicate(d, exact_dedup.DigestIndex(spark)).filter("kept").collect()
    assert len(kept) == 4


URLS = [
    (1, "http://A.Example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "https://x.org/p?q#f", "x.org", "/p", "org/", "allow"),
    (3, "https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    (4, "https://notexample.org/en/17", "notexample.org", "/en/17", "org/", "allow"),
    (5, "https://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
    (6, "https://x.org", "x.org", "", None, None),
    (7, "https://x.org?y=/z", "x.org", "", None, None),
    (8, "no scheme", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "a://b://c/d", "b:", "//c/d", None, None),
    (11, "https://com/fr/", "com", "/fr/", "com/fr/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u, *_ in URLS], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, _, host, path, rule, verdict in URLS:
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boosted_urls_on_held_out_labels(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(1500):
        bad = k % 3 == 0
        host = f"{'cheap-' if bad and rng.random() < 0.9 else ''}site{rng.integers(50)}.{rng.choice(['net', 'info'])}"
        rows.append((f"http://{host}/{rng.integers(10**6)}" + (f"?a={rng.integers(99)}&b=1&c=2" if bad else ""), "block" if bad else "allow"))
    fit = spark.createDataFrame(rows[:1200], "url string, verdict string")
    p = url_filter.train(fit).block_probability([u for u, _ in rows[1200:]])
    assert np.mean((p >= 0.5) == [v == "block" for _, v in rows[1200:]]) > 0.97
    flat = url_filter.train(fit.filter("verdict = 'allow'")).block_probability(["http://x.net/1", None])
    assert (flat < 0.5).all()


def test_features_do_not_tell_the_label_they_are_fitted_on():
    urls = [f"http://only{k}.net/x" for k in range(200)]
    y = np.arange(200) % 2.0
    at = url_filter.FEATURES.index("domain_rate")
    seen = url_filter.Lexicon.fit(urls, y).features(urls)[:, at]
    held = url_filter.Lexicon.features_out_of_fold(urls, y)[:, at]
    assert np.corrcoef(seen, y)[0, 1] > 0.9 and abs(np.corrcoef(held, y)[0, 1]) < 0.3


def test_lexical_features_of_one_url():
    url = "https://Ab-c.Example.com/x/y-1.html?a=1&b=2#frag"
    x = dict(zip(url_filter.FEATURES, url_filter.Lexicon({}, 0.25).features([url])[0].tolist(), strict=True))
    n = len(url)
    entropy = -sum(url.count(c) / n * math.log2(url.count(c) / n) for c in set(url))
    want = {"length": n, "host_length": 16, "path_length": 11, "labels": 3, "depth": 2, "digit_ratio": 3 / n, "entropy": entropy, "parameters": 2, "query_length": 7, "fragment": 4, "hyphens": 2, "last_segment": 8, "top_rate": 0.25, "top_count": 0, "secure": 1}
    assert all(x[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_long_and_repeated_urls_are_judged_each(spark):
    rows = [(k, f"http://s{k % 5}.org/{'p' if k % 2 else 'q'}") for k in range(50)] + [(90, "http://x.net/" + "a" * 30_000), (91, "http://x.net/b"), (91, "http://x.net/b")]
    rows += [(60 + k, f"http://s{k}.com/de/x") for k in range(20)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumns({"p": F.lit(1), "rule": F.lit("x")})).collect()
    assert len(out) == len(rows) and all((r["rule"] is None) == (r["block_probability"] is not None) for r in out)
    assert len({(r["verdict"], r["block_probability"]) for r in out if r["page_id"] == 91}) == 1


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(1)
    text_of = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    rows = [(k, text_of("abcdefg"), "aa") for k in range(3000)] + [(5000 + k, text_of("uvwxyz"), "zz") for k in range(20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=100, least=10)
    out = model.predict([text_of("uvwxyz") for _ in range(20)] + [text_of("abcdefg")])
    assert out["lang_pred"].tolist() == ["zz"] * 20 + ["aa"] and model.log_prior[model.langs.index("zz")] < np.log(0.02)


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    rows = [(k, f"plain words of text {k}" if k % 2 else f"vile awful slurs {k}") for k in range(200)] + [(4, f"copy {j}") for j in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"y": F.lit(1), "n": F.lit(2)})
    lab = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(200)], "doc_id long, toxic int")
    one = toxicity.train(d.drop("y", "n"), lab)
    assert toxicity.train(d.drop("y"), lab).bucket.tolist() == one.bucket.tolist() and len(one.bucket)
    assert len(toxicity.detect(d, one).collect()) == 700
    assert len(toxicity.train(d, lab, max_pairs=0).bucket) == 0


def test_slots_of_many_rows_without_id(spark):
    rows = [(None, f"text {k}") for k in range(3000)] + [(k, "x") for k in range(1000)]
    placed = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.crc32("text")), "doc_id", (1.0, 1.0, 1.0))
    out = sharding.with_slots(placed, "shard", "doc_id", 4000, rows_per_task=200, also=("c",)).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert len(out) == 4000


def test_trees_follow_their_splits():
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 20)
    y = (x[:, 0] >= 2).astype(float)
    t = url_filter.boost(x, y, trees=20)
    assert ((t.margin(x) > 0) == (y == 1)).all()


def test_toxicity_sample_is_the_same_in_any_layout(spark):
    rows = [(k, f"plain words of text {k}" if k % 2 else f"vile awful slurs {k}") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, k % 2 == 0) for k in range(400)], "doc_id long, toxic boolean")
    models = []
    for parts in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            m = toxicity.train(d, lab, max_docs=60)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        models.append((m.bucket.tolist(), m.weight.tolist(), m.bias))
    assert models[0] == models[1] == models[2]


def test_a_frequent_url_is_drawn_once(spark, monkeypatch):
    """A URL that holds most rows, and whose hash is in the sample, adds one row to what reaches the driver."""
    import pandas as pd

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 < 2, F.lit("http://hot.example/1")).otherwise(F.concat(F.lit("http://x"), F.col("id"), F.lit(".net/a"))).alias("url"))
    rows = rows.withColumn("verdict", F.when(F.crc32("url") % 2 == 0, "block").otherwise("allow"))
    seen = []
    monkeypatch.setattr(url_filter.Lexicon, "fit", classmethod(lambda cls, urls, y, fit=url_filter.Lexicon.fit.__func__: seen.append(list(urls)) or fit(cls, urls, y)))
    url_filter.train(rows, max_urls=1000)
    assert 900 <= len(seen[0]) <= 1000 and pd.Series(seen[0]).is_unique
