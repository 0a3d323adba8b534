import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provlake.llm import bpe, packing, tokens

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def encode(library, text):
    return library.encode(text, add_special_tokens=False).ids


def held(ids):
    return np.array(ids, "<u4").tobytes()


def test_every_character_of_the_fast_range(library):
    """Where a text is cut must agree with the library beside any character that is not sent to it whole."""
    texts = [a + chr(c) + b for c in range(0x250) for a in ("", "a", " ", "1", ".", "_", "\n", "'") for b in ("", "b", " ", "2", "!", "_", "'s", "\n", "  x")]
    want = [held(encode(library, t)) for t in texts]
    assert bpe.pieces(NAME, True).batch(texts) == want
    assert bpe.ranked(NAME).ranks is not None and [bpe.ranked(NAME).ids(t) for t in texts] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé'st _\n\t\r 19²½.,!-\xa0\x85\x1c漢­̈🙂 ") | st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_any_text(library, texts):
    known = bpe.pieces(NAME, True)
    assert known.batch(texts) == [held(encode(library, t)) for t in texts] == [bpe.ranked(NAME).ids(t) for t in texts]
    assert bpe.pieces(NAME, False).batch(texts) == [len(encode(library, t)) for t in texts]


def test_special_strings(library):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext", "x <|endoftext|> <|endoftext|>"]
    assert [bpe.ranked(NAME).ids(t) for t in texts] == [held(encode(library, t)) for t in texts]
    assert bpe.pieces(NAME, False).batch(texts) == [len(encode(library, t)) for t in texts]


def test_proven_tokens(library):
    proven = bpe.pieces(NAME, False).proven
    assert len(proven) > 40_000 and set(proven.values()) == {1}
    assert all(len(encode(library, t)) == 1 for t in random.Random(1).sample(sorted(proven), 500))


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000 + "x", "".join(random.Random(2).choices("abcdefghij", k=200_000)), " \t" * 1_500_000 + "x", "." * 200_000])
def test_very_long_runs(library, text):
    assert bpe.ranked(NAME).ids(text) == held(encode(library, text))


def test_ranks_only_where_proven(library):
    """A vocabulary that the proof does not hold for goes to the library: here, one with a string that no merge makes."""
    made = json.loads(library.to_str())
    made["model"]["vocab"]["zqzqzq"] = len(made["model"]["vocab"]) + 1
    assert bpe.Ranked(public_tokenizers.path(NAME))._prove() is not None
    changed = bpe.Ranked(public_tokenizers.path(NAME))
    changed.tokenizer = Tokenizer.from_str(json.dumps(made))
    assert changed._prove() is None
    other = bpe.Ranked(public_tokenizers.path("word_bpe_49k.json"))
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranks is None and other.ids("some words, 12") == held(encode(want, "some words, 12"))


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    known = bpe.Pieces(public_tokenizers.path(NAME), True)
    texts = [f"qzx{k} vv{k}" for k in range(50)]
    for part in (texts[:25], texts[25:], texts[:25]):
        assert known.batch(part) == [held(encode(library, t)) for t in part]


def test_counts(spark, library):
    texts = ["", None, "The cat sat on the mat.", "naïve çè été 漢字", "a" * 5000]
    got = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit=5).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        n = len(encode(library, t or ""))
        assert tuple(r)[1:] == (len((t or "").encode()), n, n > 5)


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120))
def test_equals_best_fit_decreasing(lengths):
    """The packing from the histogram fills as many bins to the same levels as piece by piece."""
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, bins = packing.best_fit(histogram, 20)
    filled, places = [0] * bins, {}
    for size, a, b, first, each, fill in runs:
        for j in range(b - a):
            k = first + j // each
            assert filled[k] == fill + j % each * size
            filled[k] += size
            places[size] = places.get(size, 0) + 1
    assert places == histogram and sorted(20 - x for x in filled) == plain_best_fit(lengths, 20)


def test_few_rows_describe_a_large_packing():
    rnd = random.Random(2)
    runs, _ = packing.best_fit({n: rnd.randint(1, 10**9) for n in range(1, 2049)}, 2048)
    assert len(runs) < 6 * 2048


@pytest.mark.parametrize("with_ids", [False, True])
def test_pack(spark, library, with_ids):
    rnd = random.Random(4)
    words = "the of and cat zxq naïve 漢字 don't 1234".split()
    texts = [" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 40, 90, 300]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = packing.pack(df, capacity=64, with_ids=with_ids, buckets=3).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    for k, t in enumerate(texts):
        ids, parts = [*encode(library, t), 0], sorted(by_doc[k], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts))) and sum(p["length"] for p in parts) == len(ids)
        assert all(p["length"] == 64 for p in parts[1:]) and (len(ids) > 64 or len(parts) == 1)
        for p in parts:
            own = held(ids[p["start"] : p["start"] + p["length"]])
            assert zlib.crc32(own) == p["ids_crc32"] and (not with_ids or bytes(p["ids"]) == own)
    for parts in by_bin.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    assert len(by_bin) == len(plain_best_fit([r["length"] for r in rows], 64))
