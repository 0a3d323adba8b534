"""Operator 4: approximate nearest neighbours by collision counting.

Method: each of many single projections keeps its values in a sorted array. A window centred on the query's own value
grows by virtual rehashing (radius R, cR, c^2 R, ...); each vector inside it collides once for that projection. A vector
whose collisions reach the threshold is verified by its exact distance. A query is done when its k-th nearest verified
vector lies within R.

The window reaches R to either side, so a vector at distance R collides with probability p = 0.68 (a standard normal
within one deviation); the threshold lies MARGIN binomial deviations below p * PROJECTIONS. Projections come in blocks of
orthogonal directions, which makes a vector's number of collisions follow its distance more closely than independent ones
would, so recall is higher than the binomial says: 0.99 to 1.0 on the test tables (tests/llm/test_vectors.py), where
the share of vectors verified is 15 % of 2,000 and 7 % of 8,000. The vectors of those tables have no structure: the
tenth neighbour is at 1.17 where the mean vector is at 1.41. That is why so many projections are needed.

Vectors that are null or zero, hold null or non-finite components, or have another length than most take no part, nor do
rows with a null id. Fewer candidates than k are all returned. Ties go to the smaller id. Rows that repeat an id are
candidates each; none of them is an answer to the query of that id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm import vectors

PROJECTIONS = 192
#: The chance that a standard normal number lies within 1 of its mean: the collision rate at distance R.
RATE = 0.6826894921
MARGIN = 1.25
THRESHOLD = int(PROJECTIONS * RATE - MARGIN * (PROJECTIONS * RATE * (1 - RATE)) ** 0.5)
GROWTH = 1.05
#: Rows of a shard from whose distances the first radius is taken.
SAMPLE = 64


def lines(dim: int) -> np.ndarray:
    """The directions, as columns: random orthogonal bases, scaled so that a projection of a difference of length 1 has
    variance 1."""
    rnd = np.random.default_rng(dim)
    bases = [np.linalg.qr(rnd.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(bases, axis=1)[:, :PROJECTIONS] * np.sqrt(dim)


def make_index(ids: np.ndarray, rows: np.ndarray) -> bytes:
    """The vectors and, for each projection, their numbers in the order of its values."""
    order = np.argsort(rows @ lines(rows.shape[1]), axis=0, kind="stable").T
    return vectors.packed(ids=ids, rows=rows, order=order.astype(np.uint16 if len(ids) <= 1 << 16 else np.int32))


def _first_radius(rows: np.ndarray) -> float:
    """Half the median distance to the nearest other vector, among some of the shard."""
    some = rows[:: max(1, len(rows) // SAMPLE)][:SAMPLE]
    squares = (rows**2).sum(axis=1) + (some**2).sum(axis=1)[:, None] - 2 * some @ rows.T
    apart = np.sqrt(np.maximum(squares, 0))
    apart[apart < 1e-6 * np.sqrt((rows**2).sum(axis=1).max())] = np.inf
    nearest = apart.min(axis=1)
    nearest = nearest[np.isfinite(nearest)]
    return 0.5 * float(np.median(nearest)) if len(nearest) else 1.0


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts and hold sizes numbers."""
    keep = sizes > 0
    starts, sizes = starts[keep], sizes[keep]
    if not len(sizes):
        return np.zeros(0, np.int32)
    out = np.ones(int(sizes.sum()), np.int32)
    out[0] = starts[0]
    out[np.cumsum(sizes)[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out, dtype=np.int32)


def search_shard(held: dict[str, np.ndarray], qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[pd.DataFrame, int]:
    """(query_id, vec_id, score) of each query's k nearest found in the shard, and how many vectors were verified."""
    ids, rows, order = held["ids"], held["rows"], held["order"]
    n, directions = len(ids), lines(rows.shape[1])
    sorted_ = np.take_along_axis((rows @ directions).T, order.astype(np.int64), axis=1)
    flat = order.ravel()
    base = np.arange(PROJECTIONS) * n
    centres = queries @ directions
    radius, verified = _first_radius(rows), 0
    wanted = np.array([min(k, int((ids != q).sum())) for q in qids])
    active = np.flatnonzero(wanted)
    counts = {i: np.zeros(n, np.int16) for i in active}
    seen = {i: ids == qids[i] for i in active}
    near_ids = {i: np.zeros(0, np.int64) for i in active}
    near = {i: np.zeros(0) for i in active}
    lows = highs = None
    while len(active):
        low = np.stack([s.searchsorted(c - radius, "left") for s, c in zip(sorted_, centres[active].T)], axis=1)
        high = np.stack([s.searchsorted(c + radius, "right") for s, c in zip(sorted_, centres[active].T)], axis=1)
        if lows is None:
            lows = highs = low
        left = []
        for row, i in enumerate(active):
            # Of each sorted array, only what the window has gained.
            starts = np.concatenate((base + low[row], base + highs[row]))
            sizes = np.concatenate((lows[row] - low[row], high[row] - highs[row]))
            counts[i] += np.bincount(flat[_ranges(starts, sizes)], minlength=n).astype(np.int16)
            fresh = np.flatnonzero((counts[i] >= THRESHOLD) & ~seen[i])
            if len(fresh):
                seen[i][fresh] = True
                verified += len(fresh)
                distance = np.sqrt(((rows[fresh] - queries[i]) ** 2).sum(axis=1))
                all_ids, all_ = np.append(near_ids[i], ids[fresh]), np.append(near[i], distance)
                top = vectors.best(all_ids, all_, k)
                near_ids[i], near[i] = all_ids[top], all_[top]
            done = len(near[i]) >= wanted[i] and near[i][-1] <= radius
            if not done and (high[row] - low[row]).min() < n:
                left.append(row)
            else:
                del counts[i], seen[i]
        active, lows, highs = active[left], low[left], high[left]
        radius *= GROWTH
    at = np.concatenate([np.full(len(near[i]), qids[i]) for i in near]) if near else np.zeros(0)
    found = np.concatenate([near_ids[i] for i in near]) if near else np.zeros(0)
    scores = np.concatenate([near[i] for i in near]) if near else np.zeros(0)
    return pd.DataFrame({"query_id": at.astype(np.int64), "vec_id": found.astype(np.int64), "score": scores.astype(float)}), verified


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance, double) of each query's k nearest found; is_query: a condition on `id`."""
    rows = vectors.clean(df, id_col, vec_col, zeros=False)
    return vectors.search(
        rows,
        is_query,
        k,
        make_index,
        lambda held, qids, queries: search_shard(held, qids, queries, k)[0],
        "query_id long, vec_id long, score double",
        [F.asc("score"), F.asc("vec_id")],
    )
