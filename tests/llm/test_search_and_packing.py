"""Nearest neighbours, WARC, SentencePiece, packing, near-dedup and the pipeline against brute force."""

from __future__ import annotations

import collections
import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridian.llm import ann, components, near_dedup, packing, sentencepiece_lattice, warc
from meridian.llm.common import join_groups, likely_in

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "Straße Ünïcode 日本語 🎉 <|endoftext|> x"), (6, "word " * 3000), (7, "x" * 5000), (1, None), (4, "a"), (None, "null id here you see"), (None, None), (8, "\x0b\x0c a\r\n\x1cb  \x1f")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)


def brute_nearest(ids, x, k):
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % 20 == 0:
            s = np.cumsum(x * v, axis=1)[:, -1]
            o = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def test_exact_search_with_factor_one(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)) * rng.random((900, 1))
    x[100:400] = x[100]  # many ties
    rows = [(k, [float(v) for v in x[k]]) for k in range(900)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [1.0]), (None, [1.0] * 8), (1100, [])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int")
    want = brute_nearest(np.arange(900), x, 20)
    for factor, shard_rows in ((1.0, 128), (1.0, 8192)):
        got = collections.defaultdict(list)
        for r in ann.nearest(df, factor=factor, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert dict(got) == want


def test_recall_of_the_production_factor(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, factor=1.0).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df).collect()}
    assert len(exact & found) / len(exact) >= 0.95
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.filter("vec_id < 5"))
    assert few.count() == 4


def test_vectors_are_searched_among_those_of_their_length(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.normal(size=3 if k % 3 else 5).tolist() for k in range(120)}
    x |= {200: [1.0], 201: [float("nan"), 1.0, 2.0], 202: [0.0, 0.0, 0.0], 203: [], 204: None, 205: [1.0, None, 2.0]}
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>").withColumns({"dims": F.lit("x"), "shard": F.lit(1), "v": F.lit(2)})
    out = ann.nearest(df, k=3, factor=1.0, shard_rows=20).collect()
    ok = {k: v for k, v in x.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    want = set()
    for q in (k for k in ok if k % 20 == 0):
        best = sorted((-float(np.cumsum(np.multiply(ok[q], ok[k]))[-1]), k) for k in ok if k != q and len(ok[k]) == len(ok[q]))[:3]
        want |= {(q, r + 1, k) for r, (_, k) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in out} == want and 200 not in {r["query_id"] for r in out}


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(9):
        runs = [sorted((int(v), i) for v in rng.integers(0, 50, rng.integers(0, 30))) for i in range(k)]
        assert [v for v, _ in warc.LoserTree([iter(r) for r in runs])] == sorted(v for r in runs for v, _ in r)


def test_warc_round_trip(spark, tmp_path):
    big, small = "é" * 60, "x" * 99
    rows = [(9, "http://b.org/1", big), (3, "http://a.org/1", big), (5, None, small), (6, "http://a.org/1", small), (1, "bad url\r\nX: y", "WARC/1.1\r\n\r\n" * 20), (7, "u", None), (8, "u", ""), (3, "http://a.org/1", big), (None, "http://c.org", big)]
    pages = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    out = warc.archive_pages(pages, folder, max_broadcast=0).collect()
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = 3 if p == big.encode() else None
        refers = first if first is not None and i != first else None
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted([tuple(r)[:5] for r in out], key=str) == sorted(want, key=str)
    order = sorted(out, key=lambda r: (r["index_part"], r["index_pos"]))
    keys = [(r["url_key"], r["ts"]) for r in order]
    assert keys == sorted(keys)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert data.count(b"WARC-Type: revisit") == 2
    again = warc.archive_pages(pages).collect()
    assert sorted([tuple(r)[:5] for r in again], key=str) == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, 0, "u", b"abc", "d", None)[:-5])


def test_merged_index_is_in_global_order(spark):
    rows = [(f"r{k % 7}", k // 7, f"key{(k * 31) % 11:02d}", k, k, "f", 0, 1) for k in range(500)]
    rows = [(r, s, *rest) for name in sorted({x[0] for x in rows}) for s, (r, _, *rest) in enumerate(sorted((x for x in rows if x[0] == name), key=lambda x: x[2:5]))]
    df = spark.createDataFrame(rows, warc.INDEX)
    got = warc.merge_index(df, rows_per_range=60).orderBy("part", "pos").collect()
    assert [(r["url_key"], r["ts"]) for r in got] == sorted((x[2], x[3]) for x in rows) and len({r["part"] for r in got}) > 3


MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(spark, sf, library):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t for _, t in HARD if t]
    lat = sentencepiece_lattice.lattice(MODEL)
    for t, (ids, _) in zip(texts, lat.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lat = sentencepiece_lattice.lattice(MODEL)
    ids, _ = lat.encode([text])[0]
    if "\x00" not in text:
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text)
    if "▁" not in text:
        assert lat.decode(ids) == text


def test_unigram_is_the_best_path():
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -3.5, "ba": -2.2, "▁ab": -7.0, "aa": -3.9}
    data = field(1, field(1, b"<unk>") + b"\x18\x02")
    for p, s in pieces.items():
        data += field(1, field(1, p.encode()) + b"\x15" + np.array(s, "<f4").tobytes())
    data += field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00")
    lat = sentencepiece_lattice.Lattice(sentencepiece_lattice.Model(data))
    rng = np.random.default_rng(0)
    words = ["▁" + "".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(60)]

    def best(w):
        if not w:
            return 0.0
        return max((pieces[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces), default=-1e9)

    got = lat.encode_words(list(set(words)))
    for w in words:
        ids, score = got[w]
        assert score == pytest.approx(best(w), abs=1e-5) and "".join(lat.m.pieces[k] for k in np.frombuffer(ids, "<u4")) == w
    alone = sentencepiece_lattice.Lattice(lat.m)
    for w in set(words):
        alone.encode_words([w])
    assert lat.states < alone.states


def test_encoded_tables(spark):
    d = docs(spark, HARD).withColumn("ids", F.lit(1))
    enc = sentencepiece_lattice.encode(d, MODEL)
    back = sentencepiece_lattice.decode(enc, MODEL).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in back], key=str) == sorted([(i, t or "") for i, t in HARD], key=str)
    dig = sentencepiece_lattice.encode_digest(d, MODEL).collect()
    assert all(r["round_trip"] for r in dig) and all(r["n_pieces"] == 0 and r["ids_crc32"] == 0 for r in dig if r["doc_id"] in (1, 2))


def check_packing(rows, out, window=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for i in {i for i, _ in rows}:
        mine = [t for j, t in rows if j == i]
        pieces = sorted(by[i], key=lambda r: (r["doc_tokens"], r["start"]))
        for t in sorted(mine, key=lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            at = 0
            while at < len(ids):
                k = next(k for k, r in enumerate(pieces) if r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()))
                at += pieces.pop(k)["length"]
        assert not pieces
    seq = collections.defaultdict(list)
    for r in out:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= window
    return 1 - sum(n for s in seq.values() for _, n in s) / (window * len(seq))


def test_packing_of_hard_texts(spark):
    out = packing.pack(docs(spark, HARD).withColumn("shard", F.lit(0)), packing.Packing.public()).collect()
    check_packing(HARD, out)
    assert packing.pack(spark.createDataFrame([], DOC), packing.Packing.public()).count() == 0


def test_packing_of_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    assert check_packing(rows, packing.pack(d, packing.Packing.public()).collect()) < 0.03


def test_neighbours_share_words():
    p = packing.Packing("", "", "", query_terms=8)
    bag = lambda *ids: np.concatenate((np.array(sorted(ids)), np.ones(len(ids)))).astype("<u4").tobytes()
    bags = [bag(1, 2, 3), bag(1, 2, 9), bag(7, 8), bag(7, 8, 9), bag(20)]
    index = packing.InvertedIndex(bags, p)
    found, score = index.neighbours(0)
    assert set(found.tolist()) == {0, 1} and (score > 0).all()
    seq, off = packing.pack_shard(np.array([600, 300, 500, 400, 100]), index, 1024)
    assert seq[0] == seq[1] and seq[2] == seq[3] and off[1] == 600
    assert len(index.neighbours(4)[0]) == 0


@pytest.mark.parametrize("cells", [0, 200, 10**6])
def test_neighbours_equal_bm25(cells):
    rng = np.random.default_rng(2)
    p = packing.Packing("", "", "")
    docs_ = [collections.Counter(rng.zipf(1.3, 40).clip(max=300).tolist()) for _ in range(60)]
    bags = [np.array([*sorted(c), *(c[k] for k in sorted(c))], "<u4").tobytes() for c in docs_]
    index = packing.InvertedIndex(bags, p, cells)
    df = collections.Counter(t for c in docs_ for t in c)
    mean = sum(sum(c.values()) for c in docs_) / 60
    for seed in range(60):
        want = {}
        for k, c in enumerate(docs_):
            both = [t for t in docs_[seed] if t in c and df[t] > 1]
            norm = p.k1 * (1 - p.b + p.b * sum(c.values()) / mean)
            if both:
                want[k] = sum(np.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (p.k1 + 1) / (c[t] + norm) for t in both)
        found, score = index.neighbours(seed)
        assert found.tolist() == sorted(want) and np.allclose(score, [want[k] for k in sorted(want)], rtol=1e-5)


@pytest.mark.parametrize("cells", [0, 200, 10**6])
def test_neighbours_below_a_number_are_those_of_all(cells):
    rng = np.random.default_rng(3)
    bags = [np.array([*sorted(c), *(c[k] for k in sorted(c))], "<u4").tobytes() for c in (collections.Counter(rng.zipf(1.3, 40).clip(max=300).tolist()) for _ in range(60))]
    index = packing.InvertedIndex(bags, packing.Packing("", "", ""), cells)
    for seed, below in [(0, 0), (3, 1), (7, 30), (59, 60)]:
        (found, score), (some, part) = index.neighbours(seed), index.neighbours(seed, below)
        assert some.tolist() == found[found < below].tolist() and part.tolist() == score[found < below].tolist()


def test_shards_read_only_tails_that_fit():
    rng = np.random.default_rng(4)
    bags = [np.array([*sorted(c), *(c[k] for k in sorted(c))], "<u4").tobytes() for c in (collections.Counter(rng.zipf(1.3, 40).clip(max=300).tolist()) for _ in range(200))]
    tails = np.sort(rng.integers(0, 1025, 200))
    index, asked = packing.InvertedIndex(bags, packing.Packing("", "", "")), []

    class Whole:
        def neighbours(self, seed, below):
            asked.append((tails[seed], below))
            return index.neighbours(seed)

    whole, bounded = packing.pack_shard(tails, Whole(), 1024), packing.pack_shard(tails, index, 1024)
    assert all((x == y).all() for x, y in zip(whole, bounded, strict=True))
    assert asked and all(below == (tails <= 1024 - n).sum() for n, below in asked)


def test_dealing_starts_no_other_python_workers(spark, monkeypatch):
    p = packing.Packing.public(shard_docs=100)
    tokens = packing.tokenize(docs(spark, [(k, f"word{k} other{k % 7} text") for k in range(300)]), p)
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *a, **b: pytest.fail("rows through RDD workers"))
    assert packing.deal(tokens, 300, p).count() == 300


def test_like_documents_share_a_shard(spark):
    rng = np.random.default_rng(8)
    words = [[f"{chr(97 + t)}{w}x" for w in range(40)] for t in range(16)]
    rows = [(k, " ".join(rng.choice(words[k % 16], 60))) for k in range(640)] + [(700 + k, "same words again") for k in range(200)]
    p = packing.Packing.public(shard_docs=100)
    dealt = packing.deal(packing.tokenize(docs(spark, rows), p), len(rows), p).select("doc_id", "shard").collect()
    of = {r["doc_id"]: r["shard"] for r in dealt}
    size = collections.Counter(of.values())
    assert len(of) == len(rows) and max(size.values()) <= 150
    mates = [(i, j) for i in range(640) for j in range(i % 16, i, 16)]
    assert np.mean([of[i] == of[j] for i, j in mates]) > 0.5
    check_packing(rows, packing.pack(docs(spark, rows), p).collect())


def test_repeated_rows_keep_the_bound_of_a_shard(spark):
    rows = [(1, "one row that is there again and again")] * 850 + [(k, f"word{k} other{k % 7} text") for k in range(2, 52)]
    p = packing.Packing.public(shard_docs=100)
    dealt = packing.deal(packing.tokenize(docs(spark, rows).repartition(3), p), len(rows), p)
    assert dealt.count() == 900 and max(r["count"] for r in dealt.groupBy("shard").count().collect()) <= 150
    check_packing(rows, packing.pack(docs(spark, rows), p).collect())


def test_an_index_is_bounded_by_its_postings(spark):
    rows = [(k, " ".join(f"t{j * 7 + k}" for j in range(30 + k % 5))) for k in range(60)]
    small = packing.pack(docs(spark, rows), packing.Packing.public(shard_postings=200)).collect()
    whole = packing.pack(docs(spark, rows), packing.Packing.public()).collect()
    check_packing(rows, small)
    assert len({r["sequence_id"] for r in small}) > len({r["sequence_id"] for r in whole})


def brute_near(rows, words, percent):
    def sh(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    s = {i: sh(t) for i, t in rows if i is not None}
    sets = components.UnionFind()
    inv = collections.defaultdict(list)
    for i, x in s.items():
        hits = collections.Counter(j for y in x for j in inv[y])
        for j, n in hits.items():
            if 100 * n >= percent * (len(x) + len(s[j]) - n):
                sets.union(i, j)
        for y in x:
            inv[y].append(i)
    return {i: (len(x), sets.find(i)) for i, x in s.items()}


@pytest.mark.parametrize("block", [1000, 3])
def test_near_dedup_against_brute_force(spark, sf, block):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 120)]
    for k in range(60):  # one large group of near copies, each of them like many but not all others
        w = list(base)
        for j in rng.integers(0, 120, 3):
            w[j] = f"z{rng.integers(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, "A b"), (20_001, "a B"), (20_002, "a b c")]
    out = near_dedup.near_duplicates(docs(spark, rows), near_dedup.Forest(words=4, block_classes=block)).collect()
    want = brute_near(rows, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_dedup_finds_pairs_hidden_in_a_large_like_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]

    def change(w, n):
        w = list(w)
        for j in rng.choice(200, n, replace=False):
            w[j] = f"z{rng.integers(10**9)}"
        return w

    variants = [change(base, 5) for _ in range(200)]  # similar by about 0.66, so not linked
    partners = [change(w, 5) for w in variants[:40]]  # by about 0.82 to their variant
    rows = [(k, " ".join(w)) for k, w in enumerate(variants + partners)]
    want = brute_near(rows, 4, 80)
    assert len({c for _, c in want.values()}) > 190
    # Few and shallow orders: candidates chain all into one component, but miss pairs.
    f = near_dedup.Forest(words=4, trees=4, min_depth=1, max_depth=1, block_classes=3)
    out = near_dedup.near_duplicates(docs(spark, rows), f).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_near_dedup_loses_no_pair_in_a_component_beyond_a_block(spark):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(160)]

    def change(w, places):
        w = list(w)
        for j in places:
            w[j] = f"z{rng.integers(10**12)}"
        return w

    rows, pairs, ids = [], [], rng.permutation(2400).tolist()
    for k in range(1200):  # unlike pairs share 0.66 to 0.78 of their shingles
        mine = change(base, 5 * rng.choice(np.arange(1, 31), 5, replace=False))
        a, b = ids[2 * k : 2 * k + 2]
        rows += [(a, " ".join(change(mine, [2]))), (b, " ".join(change(mine, [157])))]
        pairs.append((min(a, b), max(a, b)))
    s = {i: near_dedup.shingles(t, 4) for i, t in rows}
    assert all(near_dedup.similar(s[a], s[b], 80) for a, b in pairs)
    some = rng.integers(0, 2400, (3000, 2)).tolist()
    assert not any(near_dedup.similar(s[a], s[b], 80) for a, b in some if (min(a, b), max(a, b)) not in set(pairs) and a != b)
    out = near_dedup.near_duplicates(docs(spark, rows), near_dedup.Forest(words=4)).collect()
    want = {i: a for a, b in pairs for i in (a, b)}
    assert {r["doc_id"]: r["component_id"] for r in out} == want


@pytest.mark.parametrize("block", [1000, 1])
def test_near_dedup_joins_the_texts_of_one_id(spark, block):
    rng = np.random.default_rng(4)
    a, b, c = ([f"{x}{k}" for k in rng.integers(0, 10**6, 60)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    f = near_dedup.Forest(words=4, block_classes=block)
    for x, y in ((a, b), (b, a)):
        rows = [(1, " ".join(x)), (1, " ".join(y)), (2, near(y)), (3, near(x)), (4, " ".join(c)), (5, None)]
        out = near_dedup.near_duplicates(docs(spark, rows), f).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
        assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs(spark, rows), f).collect()) == [1, 1, 4, 5]
    # An id that is the smallest of neither class joins both; another stands for very many texts.
    many = [(9, " ".join([*c[:50], f"v{k}", *c[51:]])) for k in range(40)] + [(9, " ".join(f"u{k}x{j}" for j in range(30))) for k in range(40)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (7, " ".join(a)), (7, " ".join(b)), (8, near(a)), *many, (10, " ".join(f"u3x{j}" for j in range(30)))]
    out = near_dedup.near_duplicates(docs(spark, rows), f).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 1), (7, 1), (8, 1), (9, 9), (10, 9)} and len(out) == len(rows)


def test_depth_follows_the_region():
    f = near_dedup.Forest(min_depth=1, max_depth=3, depth=4, region=2)
    key = np.array([[1, 1, 1, 1], [1, 1, 1, 2], [1, 1, 2, 1], [1, 2, 1, 1], [2, 1, 1, 1], [2, 2, 1, 1], [3, 1, 1, 1]], np.uint32)
    a, b = near_dedup._pairs(np.zeros(7, np.int32), key, np.arange(7), f, 0)
    # Four share one value and three of them two, so only the pair with three in common is taken; two share one value.
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (4, 5)]
    a, b = near_dedup._pairs(np.array([0, 0, 0, 0, 0, 1, 1]), key, np.arange(7), f, 1)
    assert (4, 5) not in set(zip(a.tolist(), b.tolist(), strict=True))


def test_near_dedup_of_hard_texts(spark):
    f = near_dedup.Forest()
    out = near_dedup.near_duplicates(docs(spark, HARD).withColumns({"cls": F.lit(1), "rep": F.lit(2)}), f).collect()
    assert len(out) == len(HARD) and all(r["kept"] for r in out)
    assert {r["n_shingles"] for r in out if r["doc_id"] in (1, 2, 3)} == {0} and next(r for r in out if r["doc_id"] == 4)["n_shingles"] == 1
    kept = near_dedup.keep_one(docs(spark, HARD), f)
    assert kept.columns == docs(spark, HARD).columns and kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id is null").count() == 2
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOC), f).count() == 0


def test_similar_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert near_dedup.similar(a, np.arange(80, dtype=np.uint64), 80) and not near_dedup.similar(a, np.arange(79, dtype=np.uint64), 80)
    assert near_dedup.shingles("A b\tc d  e", 4).tolist() == near_dedup.shingles("a B C D E", 4).tolist()
    assert len(near_dedup.shingles("a b c", 4)) == 1 and len(near_dedup.shingles("a a a a a a", 4)) == 1


def test_connected_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)] + [(2000, k) for k in range(2001, 2050)]
    sets = components.UnionFind()
    for a, b in edges:
        sets.union(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_join_splits_heavy_keys(spark):
    rows = spark.createDataFrame([(k, 1 if k < 500 else k) for k in range(1500)], "id long, key long")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "n").withColumn("twice", F.col("key") * 2)
    out = join_groups(rows, groups.filter("key <> 700"), "key", "n", 1500, share=0.1)
    assert {(r["id"], r["twice"]) for r in out.collect()} == {(r["id"], 2 * r["key"]) for r in rows.collect() if r["key"] != 700}
    left = join_groups(rows, groups.filter("key <> 700"), "key", "n", 1500, "left", share=0.1)
    assert left.count() == 1500 and left.filter("twice is null").count() == 1 and left.columns == ["key", "id", "twice"]


def test_bitmap_keeps_all_members(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    ids = spark.range(0, 10_000, 97).withColumnRenamed("id", "m")
    got = {r["k"] for r in likely_in(df, "k", ids, "m").collect()}
    assert {r["m"] for r in ids.collect()} <= got and len(got) < 200


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    d = spark.read.parquet(f"{sf}/documents.parquet")
    now = d
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, sf).collect(), d.schema)
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == d.columns and after.items() <= before.items()
        if name == "exact_dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
            assert sorted({norm(t) for t in before.values()}) == sorted(norm(t) for t in after.values())
        if name == "near_dedup":
            want = brute_near(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in want.items() if c == i}
    check_packing(list(after.items()), C.STAGES[-1][1](spark, now, sf).collect())
    ids = {r["doc_id"] for r in C.run(spark, sf).select("doc_id").distinct().collect()}
    assert ids == set(after)


def test_pipeline_of_hard_tables(spark, sf, tmp_path):
    """Null, empty, repeated and very long texts, null ids, and columns whose names the operators use themselves."""
    import corpus_pipeline as C

    d = spark.read.parquet(f"{sf}/documents.parquet")
    clean = d.filter("length(text) between 500 and 3000").orderBy("doc_id").select("doc_id", "text", "lang").limit(60).collect()
    body = " ".join(r["text"] for r in clean if r["lang"] == clean[0]["lang"])
    rows = [(900_000 + k, t, None, "hard", None) for k, t in enumerate((None, "", " \t\n", body * 6))]
    rows += [(None, clean[0]["text"], None, None, None), (clean[1]["doc_id"], clean[1]["text"], None, None, None), (clean[2]["doc_id"], clean[3]["text"], None, None, None)]
    extra = spark.createDataFrame(rows, d.schema)
    names = ("cls", "rep", "shard", "score", "norm", "component", "kept", "__h")
    base = str(tmp_path / "in")
    d.unionByName(extra).withColumns({n: F.lit("x") for n in names}).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    out = C.run(spark, base).collect()
    plain = {r["doc_id"] for r in C.run(spark, sf).select("doc_id").distinct().collect()}
    ids = {r["doc_id"] for r in out}
    assert not ids & {900_000, 900_001, 900_002} and 900_003 in ids  # without a letter there is no language; a long text stays
    assert ids - {900_003, None} <= plain | {clean[2]["doc_id"]} and len(plain - ids) <= 2
    pieces = collections.Counter((r["doc_id"], r["start"]) for r in out if r["doc_id"] not in (None, clean[2]["doc_id"]))
    assert max(pieces.values()) == 1  # a repeated row is packed once
    empty = str(tmp_path / "none")
    d.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert C.run(spark, empty).count() == 0
