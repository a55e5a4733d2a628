"""BPE by a bounded-lookahead transducer against the tokenizers library and a plain merge loop."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meridian.llm import bpe_transducer as bpe
from meridian.llm.queries import op12_bpe_transducer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(PATH)


def ids_of(encoder, text):
    return [k for some in encoder.ids(text) for k in some]


def test_whole_table_gives_what_the_library_gives(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op12_bpe_transducer(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for key, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[key])[1:] == want


def test_random_characters_of_many_scripts(encoder, library):
    rnd = random.Random(5)
    spans = [(32, 127), (32, 127), (0xA0, 0x250), (0x300, 0x370), (0x390, 0x3D0), (0x590, 0x700), (0x900, 0xA00), (0x1100, 0x1200), (0x2000, 0x2030), (0x1C80, 0x1C90), (0xA7C0, 0xA7F0), (0x16FF0, 0x16FF2), (0x1F600, 0x1F610)]
    for _ in range(3000):
        text = "".join(chr(rnd.randrange(*rnd.choice(spans))) for _ in range(rnd.randint(0, 40)))
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", " \n\t ", "ΟΔΥΣΣΕΥΣ İstanbul", "don't'll 's", "a\x1cb\x85c", "x<|endoftext|>y<|startoftext|><|endoftext|", "é ́a", "日本語テキスト", "\U0001d15eÅﬁ", "1234567890", "</w> the</w>"],
)
def test_edges(encoder, library, text):
    assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_long_words_stream_through_one_window(encoder, library):
    rnd = random.Random(2)
    words = ["a" * 30_000, "ha" * 20_000, "!" * 5_000, "".join(rnd.choice("abehinstr") for _ in range(40_000)), "ö" * 9_000]
    run = bpe.Transducer(encoder.m)
    for w in words:
        got = [k for some in run.word(w.encode()) for k in some]
        assert got == library.encode(w, add_special_tokens=False).ids
    assert run.most <= 4 * encoder.m.lookahead + 128


def test_slices_do_not_change_ids(encoder, library):
    text = " ".join(["déjà vu é", "it's", "naïve"] * 2000)
    small = bpe.Encoder(encoder.m)
    small.SLICE = 50
    assert ids_of(small, text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_the_least_for_a_small_list():
    """A chain: ab waits for bc, which waits for cd; with the last right part two symbols more decide all."""
    letters = {s: k for k, s in enumerate([*bpe.byte_symbols(), *(s + "</w>" for s in bpe.byte_symbols())])}
    merges = ["c d", "b c", "a b"]
    vocab = letters | {m.replace(" ", ""): len(letters) + k for k, m in enumerate(merges)}
    spec = {"normalizer": bpe.NORMALIZER, "decoder": None, "added_tokens": [], "model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"},
            "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": bpe.WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False}]}}
    model = bpe.Model(spec)
    assert model.lookahead == 3
    names = {k: t for t, k in vocab.items()}
    spell = lambda w: [names[k] for some in bpe.Transducer(model).word(w) for k in some]
    assert spell(b"abcde") == ["ab", "cd", "e</w>"] and spell(b"abce") == ["a", "bc", "e</w>"]
    rnd = random.Random(3)
    for _ in range(200):
        w = bytes(rnd.choice(b"abcd") for _ in range(300))
        whole = bpe.Transducer(model)
        assert spell(w) == [names[k] for k in whole._merge([model.plain[b] for b in w[:-1]] + [model.final[w[-1]]])]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError, match="no earlier merge"):
        letters = {s: k for k, s in enumerate([*bpe.byte_symbols(), *(s + "</w>" for s in bpe.byte_symbols())])}
        vocab = letters | {"ab": 600, "abc": 601}
        pre = {"pretokenizers": [{"type": "Split", "pattern": {"Regex": bpe.WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False}]}
        bpe.Model({"normalizer": bpe.NORMALIZER, "decoder": None, "added_tokens": [], "pre_tokenizer": pre, "model": {"vocab": vocab, "merges": ["ab c", "a b"], "end_of_word_suffix": "</w>"}})


def test_decoder_is_incremental(encoder, library):
    ids = ids_of(encoder, "Grüße 日本 <|endoftext|> naïve 😀")
    for form, want in (("library", library.decode(ids, skip_special_tokens=False)), ("text", "grüße 日本 <|endoftext|>naïve 😀 ")):
        machine = bpe.Decoder(encoder.m, form)
        assert "".join(machine.feed([k]) for k in ids) + machine.finish() == want
    machine = bpe.Decoder(encoder.m, "text")
    assert machine.feed([encoder.m.plain[0xE6]]) + machine.finish() == "�"
    assert bpe.Decoder(encoder.m).feed([10**6, ids[0]]) == library.decode([10**6, ids[0]], skip_special_tokens=False)


def test_round_trip_and_edges_of_the_table(spark):
    rows = [(1, "Hello World", "x"), (1, "Hello World", "x"), (2, None, "y"), (None, "a", None), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.encode_digest(docs, PATH).collect()) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode_digest(docs.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH, "text").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == [(0, "a "), (1, "hello world "), (1, "hello world "), (2, ""), (3, "")]
