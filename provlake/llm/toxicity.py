"""Operator 3: toxicity by a weighted lexicon.

Method: texts are folded (case, compatibility forms, zero-width and combining marks, homoglyphs, digit and symbol
substitutions inside words) and searched by Aho-Corasick; hits inside exception phrases do not count; the sum of the
hits' weights and its ratio to the length in words give the score through a logistic curve.

The lexicon is a list of insults, and terms learned from labelled rows: beginnings and inner parts of words that are far
more frequent in toxic documents than in clean ones (lower confidence bound of the log ratio of their rates, in which a
document's repetitions count by their logarithm). Every such part that enough toxic documents hold is a candidate, and
every candidate whose bound is high enough is a term, but for those that contain or are contained in a better one.
Learning uses a bounded sample of the labelled rows, `max_labelled`, in the order of a hash; every document is scored, in
time in proportion to its length.

A null or empty text scores as one without hits. A label or a doc_id that is null is not learned from. Rows that repeat
an id are each learned from, with the greater label, and each scored. Without labels of both kinds the weights fall back
to the list and a fixed curve. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.runtime import ship, bounded_batches, written

MAX_LABELLED = 20_000
#: Lengths of the inner parts of words, and of the beginnings, that are counted.
SIZES = (4, 5, 6, 7, 8)
STARTS = (3, 4, 5, 6, 7, 8)
#: A candidate is in so large a share of the toxic documents, and in so many, at least.
LEAST_SHARE, LEAST_DOCUMENTS = 0.01, 4
LEAST_WEIGHT = 2.0
PRIOR_WEIGHT = 2.5

# Insults as whole words, and phrases in which they insult nobody.
INSULTS = """idiot idiots moron morons stupid trash clown loser losers pathetic scum worthless disgusting imbecile
dumbass jackass asshole bastard bitch retard degenerate filth vermin subhuman cretin dimwit halfwit numbskull nitwit
scumbag sleazebag douchebag dickhead shithead bullshit motherfucker wanker twat slut whore""".split()
EXCEPTIONS = """trash can|trash bin|trash bag|trash talk|take out the trash|clown fish|clown car|class clown|pond scum
sore loser|loser bracket|losers bracket|stupid question|no stupid questions|idiot proof|idiot light|worthless check""".replace("\n", "|").split("|")
# Letters that look like Latin ones.
LOOKALIKES = str.maketrans("авеԁһіјӏкмнорԛѕтуԝхґёїαβεηικνορτυχωϲɡɑƅ", "abedhijikmhopqstywxreiabenikvoptuxwcgab")
SUBSTITUTES = str.maketrans("013456789@$!|+", "oieasgtbgasiit")

_MARKS = re.compile("[­̀-ͯ​-‏⁠-⁤︀-️﻿]")
_FOREIGN = re.compile("[Ͱ-ԯɑɡƅ]")
_INSIDE = re.compile(r"(?<=[^\W\d_])[0-9@$!|+]+(?=[^\W\d_])|(?<![^\W_])[0-9@$]+(?=[^\W\d_])|(?<=[^\W\d_])[0-9]+(?![^\W_])")
_WORDS = re.compile(r"[^\W\d_]+")
_GAPS = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Words of folded letters, one space before, between and after them."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(LOOKALIKES)
    text = _INSIDE.sub(lambda m: m[0].translate(SUBSTITUTES), text)
    return " " + _GAPS.sub(" ", text).strip() + " "


@dataclass(frozen=True)
class Model:
    """terms: what to find in the folded text, with its weight; curve: intercept, slopes of log(1 + sum) and log(1 + sum for 100 words)."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


_BUILT: dict[str, object] = {}


def _automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    key = hashlib.sha256(json.dumps([terms, exceptions]).encode()).hexdigest()
    if key not in _BUILT:
        found = ahocorasick.Automaton()
        for term, weight in terms:
            # A digit 1 may have stood for l as well as for i.
            for form in {term, term.replace("l", "i")} if term[0] == term[-1] == " " else {term}:
                found.add_word(form, (len(form), weight))
        for phrase in exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        found.make_automaton()
        if len(_BUILT) > 4:
            _BUILT.clear()
        _BUILT[key] = found
    return _BUILT[key]


def features(text: str | None, automaton) -> tuple[float, float]:
    """Sum of the weights of the hits outside exception phrases, and words."""
    folded = fold(text or "")
    hits, spans = [], []
    for end, (size, weight) in automaton.iter(folded) if len(folded) > 2 else ():
        (hits if weight else spans).append((end + 1 - size, end + 1, weight))
    if spans:
        hits = _outside(hits, spans)
    return sum(h[2] for h in hits), folded.count(" ") - 1 if len(folded) > 2 else 0


def _outside(hits: list[tuple], spans: list[tuple]) -> list[tuple]:
    """The hits that lie in no span. Both come in the order of their ends, so one pass from the last will do."""
    out, least, k = [], np.inf, len(spans) - 1
    for hit in reversed(hits):
        while k >= 0 and spans[k][1] >= hit[1]:
            least = min(least, spans[k][0])
            k -= 1
        if least > hit[0]:
            out.append(hit)
    return out[::-1]


def _curve(total: np.ndarray, words: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    z = curve[0] + curve[1] * np.log1p(total) + curve[2] * np.log1p(100 * total / np.maximum(words, 1))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _grams(text: str | None, among: frozenset[str] | None = None) -> dict[str, int]:
    """How often each part of a word occurs in the text; a beginning has a space before it. among: only these."""
    out: dict[str, int] = {}
    for w, n in Counter(_WORDS.findall(fold(text or ""))).items():
        parts = {w[k : k + size] for size in SIZES for k in range(len(w) - size + 1)}
        parts.update(" " + w[:size] for size in STARTS if len(w) >= size)
        for part in parts if among is None else parts & among:
            out[part] = out.get(part, 0) + n
    return out


def _count(batches: Iterator[pd.DataFrame], among: frozenset[str] | None = None) -> Iterator[pd.DataFrame]:
    """(gram, documents, hits) of each batch. A document's occurrences count by their logarithm, so that no junk that
    repeats one word decides."""
    for batch in batches:
        documents: Counter = Counter()
        hits: dict[str, float] = {}
        for text in batch["text"]:
            got = _grams(text, among)
            documents.update(got.keys())
            for gram, n in got.items():
                hits[gram] = hits.get(gram, 0.0) + (1.0 if n == 1 else math.log2(1 + n))
        names = list(documents)
        yield pd.DataFrame({"gram": names, "documents": [documents[g] for g in names], "hits": [hits[g] for g in names]}).astype(
            {"gram": object, "documents": "int64", "hits": "float64"}
        )


def _counted(rows: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
    # Sums of rounded hits do not depend on the order of the rows.
    found = rows.select("text").mapInPandas(lambda b: _count(b, among), "gram string, documents long, hits double")
    return found.groupBy("gram").agg(F.sum("documents").alias("documents"), F.sum(F.round(F.col("hits") * 1024).cast("long")).alias("hits"))


def chosen_terms(pos: dict[str, tuple[int, float]], neg: dict[str, float], words: tuple[int, int]) -> dict[str, float]:
    """Terms and weights from the candidates' (documents, hits) in toxic rows, their hits in clean ones and both sides'
    words."""
    weights = {}
    for gram, (_, a) in pos.items():
        b = neg.get(gram, 0.0)
        ratio = math.log((a + 0.5) / (words[0] + 1)) - math.log((b + 0.5) / (words[1] + 1))
        if (low := ratio - 1.645 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))) >= LEAST_WEIGHT:
            weights[gram] = round(low, 4)
    kept: dict[str, float] = {}
    held: set[str] = set()  # every part of the terms kept
    for gram in sorted(weights, key=lambda g: (-round(pos[g][1] * weights[g], 3), -len(g), g)):
        parts = {gram[a:b] for a in range(len(gram)) for b in range(a + 1, len(gram) + 1)}
        if gram not in held and not parts & kept.keys():
            kept[gram] = weights[gram]
            held |= parts
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are not negative."""
    w = np.array([-2.0, 0.5, 0.5])
    ridge = np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """The model from labelled rows whose crc32 of the id as text leaves a remainder by 5 (the others are held out)."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # bounded, so it may be broadcast
    sample = written(
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id").select("text", "y"),
        "labelled",
    )
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    base = {f" {w} ": PRIOR_WEIGHT for w in INSULTS}
    if not pos or not neg:
        return Model(tuple(sorted(base.items())), tuple(EXCEPTIONS), (-3.0, 1.0, 1.0))

    least = max(LEAST_DOCUMENTS, int(LEAST_SHARE * pos))
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).cast("long")
    sides = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.sum(n_words).alias("n")).collect()}
    # Bounded, as the sample is.
    rows = _counted(sample.where("y = 1")).where(F.col("documents") >= least).collect()
    often = {r["gram"]: (r["documents"], r["hits"] / 1024) for r in rows}
    among = frozenset(often)
    clean = {r["gram"]: r["hits"] / 1024 for r in _counted(sample.where("y = 0"), among).collect()}
    terms = tuple(sorted((base | chosen_terms(often, clean, (sides[1], sides[0]))).items()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _automaton(terms, tuple(EXCEPTIONS))
        for batch in batches:
            yield pd.DataFrame(
                [(*features(t, found), y) for t, y in zip(batch["text"], batch["y"])],
                columns=["total", "words", "y"],
            ).astype("float64")

    rows = np.array(sample.mapInPandas(measure, "total double, words double, y double").collect())  # at most max_labelled rows of three numbers
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows[:, 0]), np.log1p(100 * rows[:, 0] / np.maximum(rows[:, 1], 1))])
    order = np.lexsort((*x.T, rows[:, 2]))  # sums in one order whatever the order of the rows
    return Model(terms, tuple(EXCEPTIONS), _logistic(x[order], rows[order, 2]))


def score(text: Column, model: Model) -> Column:
    """A number from 0 to 1 for each text; higher: label 1 is likelier."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = _automaton(model.terms, model.exceptions)
        for texts in batches:
            got = np.array([features(t, found) for t in texts], dtype=float).reshape(-1, 2)
            yield pd.Series(_curve(got[:, 0], got[:, 1], model.curve))

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    model = learn(docs, labels, id_col, text_col)
    held = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0, F.lit(True))
    out = docs.select(docs[id_col].alias(id_col), held.alias("held_out"), score(docs[text_col], model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
