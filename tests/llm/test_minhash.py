import random
import re

import numpy as np
import pytest

from provlake.llm import components, minhash, shingles


def brute_sets(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def corpus(seed):
    """Chains of near copies around the threshold, exact copies, shared passages, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = ["", None, "one", "ONE", "one two three four five", "one  two\tthree four\nfive", "É é"]
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([6, 12, 80, 200]))]
        if rnd.random() < 0.4:
            base += passage
        texts += [" ".join(base)] * rnd.randint(1, 3)
        for _ in range(rnd.randint(0, 8)):  # each a change of the one before: ends of a chain need not be alike
            for _ in range(rnd.randint(1, max(1, len(base) // 60))):
                base[rnd.randrange(len(base))] = word()
            texts.append(" ".join(base).title() if rnd.random() < 0.3 else " ".join(base))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, tile", [(1, 256), (2, 256), (3, 2)])
def test_against_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(minhash, "TILE", tile)  # 2: every mixed bucket is cut into many tiles
    texts = corpus(seed)
    sets = brute_sets(texts)
    links = [(a, b) for a in range(len(texts)) for b in range(a) if (i := len(sets[a] & sets[b])) and 100 * i >= 85 * len(sets[a] | sets[b])]
    want = brute_components(len(texts), links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert all(got[k]["kept"] == (want[k] == k) for k in got)


def test_mixed_bucket_is_worked_off_in_tiles(spark, monkeypatch):
    """Two chains that meet only in their middle: stars over the least member alone would leave them apart."""
    monkeypatch.setattr(minhash, "TILE", 3)
    base = [f"w{k}" for k in range(100)]
    variants = []
    for step in range(0, 40, 2):
        base[step] = f"x{step}"
        variants.append(" ".join(base))
    order = list(range(len(variants)))
    random.Random(9).shuffle(order)
    df = spark.createDataFrame([(k, variants[v]) for k, v in enumerate(order)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {0}


def test_unlike_members_of_a_bucket_send_no_texts(spark, monkeypatch):
    """Signatures that agree in one band only: the bucket is mixed, and no text goes to its tiles."""
    rnd = np.random.default_rng(2)
    seen = []
    plain = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: seen.append((name, out := plain(df, name))) or out)
    common = [f"c{k}" for k in range(30)]
    texts = [" ".join([*common, *(f"u{d}w{rnd.integers(1 << 30)}" for _ in range(30))]) for d in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == set(range(120))
    tables = dict(seen)
    assert tables["members"].count() > 0 and tables["agreeing"].count() == 0


def test_rows_that_repeat_an_id_apart(spark):
    x, y, z = ([f"{c}{k}" for k in range(60)] for c in "xyz")
    near = " ".join([*x[:59], "other"])
    rows = [(5, " ".join(x)), (5, " ".join(y)), (7, near), (3, " ".join(z)), (3, " ".join(z).upper()), (-4, " ".join(y) + " more"), (9, ""), (9, None), (None, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text_hash"]): (r["component_id"], r["kept"], r["least"]) for r in minhash.near_duplicates(df, apart=True).collect()}
    hashes = [r[0] for r in df.select(__import__("pyspark").sql.functions.xxhash64("text")).collect()]
    want = [(5, True, True), (-4, False, False), (5, False, False), (3, True, True), (3, True, True), (-4, True, True), (9, True, True), (9, True, True), (None, True, True)]
    assert [got[i, h] for (i, _), h in zip(rows, hashes)] == want
    assert {r["component_id"] for r in minhash.near_duplicates(df).where("doc_id = 7").collect()} == {-4}  # one node for each id


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, 2000, dtype=np.uint64)
    a, b = minhash.signature(x[:1500], 110), minhash.signature(x[500:], 110)
    assert abs((a == b).mean() - 0.5) < 0.2 and (minhash.signature(x, 110) == minhash.signature(x[::-1], 110)).all()
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** minhash.ROWS) ** minhash.bands(percent) < 1e-5
    assert minhash.bands(85) == 22 and minhash.bands(100) == 1


def test_shingles_against_words():
    for t in ["a b c d e f", "A b C d E f", "a\x0bb\x0cc", "é É", "  ", "a b c d e a b c d e a b c d e"]:
        assert len(shingles.shingle_set(t)) == len(brute_sets([t])[0])
    assert (shingles.shingle_set("A B c") == shingles.shingle_set("a\tb  C\n")).all()
    a, b = shingles.shingle_set("a b c d e f g h"), shingles.shingle_set("a b c d e f g x")
    assert shingles.shared(a, b) == 3 and shingles.shared(a, a[:0]) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    n = 300
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(200)] + [(0, k) for k in range(200, 260)] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame([*links, (None, 5), (5, None), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = brute_components(n, links)
    assert all(got.get(k, k) == want[k] for k in range(n))
