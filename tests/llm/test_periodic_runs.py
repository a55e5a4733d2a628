"""Periodic runs against a direct search by period."""

from __future__ import annotations

import hashlib
import random
import zlib

from meridian.llm import periodic_runs as pr
from meridian.llm.queries import op11_periodic_runs


def brute(w, shortest=12):
    """For each distance, maximal stretches of equal words that far apart; kept if no shorter period fits."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(shortest, 2 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    top = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *top, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_random_sequences():
    rnd = random.Random(1)
    for k in range(1500):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 60))]
        if k % 2:
            u, v = ([rnd.randrange(4) for _ in range(rnd.randint(1, 8))] for _ in range(2))
            w = w[:10] + (u * 20)[: rnd.randint(5, 60)] + w[10:20] + (v * 20)[:30] + (u * 9)[:20]
        assert pr.runs(w) == brute(w)
        assert sorted(pr.automaton_runs(w, 2), key=lambda r: (r[0], r[2])) == brute(w, 2)


def test_fibonacci_and_equal_words():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert pr.runs(b) == brute(b)
    assert pr.runs([7] * 5000) == [(0, 5000, 1)]


def test_stretches_hold_every_run_and_little_else():
    rnd = random.Random(4)
    w = [rnd.randrange(10**6) for _ in range(4000)]
    w[1000:1040] = w[3000:3040]  # the same passage twice, far apart: no run
    w[2000:2100] = (w[2000:2025] * 4)[:100]
    number = {x: k for k, x in enumerate(dict.fromkeys(w))}
    assert pr.stretches(pr.np.array([number[x] for x in w])) == [(2000, 2100)]
    assert pr.runs(w) == [(2000, 100, 25)]


def test_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"] or "") < 8000}
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, sf).collect()}
    assert len(docs) > 100 and sum(got[k][0] > 0 for k in docs) > 5
    for key, text in docs.items():
        assert got[key] == expected(key, text)


def test_long_text_in_one_row():
    w = [str(k % 1009) for k in range(60_000)]
    assert pr.runs(w) == [(0, 60_000, 1009)]


def test_edges(spark):
    rows = [(1, "a b " * 8), (1, "a b " * 8), (2, None), (3, ""), (4, " \t\x0b\n"), (None, "x " * 30), (5, "é\x1c é\x1c " * 9), (6, "one two"), (10, "y " * 11)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, length int")
    got = sorted(map(tuple, pr.runs_digest(docs).collect()), key=str)
    assert got == sorted([(i, *expected(i, t or "")) for i, t in rows], key=str)
    assert pr.runs_digest(docs.limit(0)).count() == 0
    spans = {tuple(r) for r in pr.find_runs(docs).collect()}
    assert spans == {(1, 0, 16, 2), (None, 0, 30, 1), (5, 0, 18, 1)}
    short = {(r["doc_id"], r["text"], r["length"]) for r in pr.collapse(docs).collect()}
    assert short == {(1, "a b", 7), (2, None, 7), (3, "", 7), (4, " \t\x0b\n", 7), (None, "x", 7), (5, "é\x1c", 7), (6, "one two", 7), (10, "y " * 11, 7)}
