"""Nearest vectors by collision-counting hashing.

Vectors of length one are projected on `m` random directions; per direction a sorted array of
projections is kept. A query opens a window of half width w * R / 2 around its own projection in every
array and counts, per vector, the arrays whose window holds it. Vectors with at least `l` collisions
are verified by cosine on the original vectors. R grows by steps (virtual rehashing: the arrays stay,
only windows widen) until it covers the distance of the k-th best vector known, so farther vectors
can't matter.

Vectors are dealt by hash into shards of about 4 sqrt(rows), each with its own sorted arrays, and
queries into groups of bounded size; every group meets every shard once, and a shard returns at most
k rows a query. A bounded sample gives each query a first bound on its k-th distance; without one
(fewer than k vectors of that length in the sample) windows open fully, which is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.session import written

RATIO = 2.0  # of two distances that the collision counts tell apart
MISS = 1 / math.e  # chance, per the method's bound, that a vector in reach collects too few collisions
STEPS = 2  # window levels below the bound, half octaves
SAMPLE = 1024  # vectors, chosen by hash, that give first bounds on distances; none of them decides a result
SHARD_ROWS = 16_384  # at most
GROUP_QUERIES = 8_192
SEED = 23


def _inside(x: float) -> float:
    """Share of a standard normal variable within x of zero."""
    return math.erf(x / math.sqrt(2))


def plan(n: int, ratio: float = RATIO) -> tuple[int, int, float]:
    """(m, l, w) for n vectors: directions, collisions that make a candidate, window width at R = 1."""
    w = math.sqrt(8 * ratio * ratio * math.log(ratio) / (ratio * ratio - 1))
    near, far = _inside(w / 2), _inside(w / (2 * ratio))
    false = min(0.5, 100 / max(n, 1))
    a, b = math.sqrt(math.log(2 / false)), math.sqrt(math.log(1 / MISS))
    m = math.ceil((a + b) ** 2 / (2 * (near - far) ** 2))
    alpha = (a / b * near + far) / (1 + a / b)
    return m, math.floor(alpha * m), w


def directions(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, m))


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class Shard:
    """Vectors of one length with a sorted array of their projections per direction."""

    def __init__(self, rows: np.ndarray, m: int):
        self.rows, self.lengths = rows, lengths(rows)
        projected = ((rows / self.lengths[:, None]) @ directions(rows.shape[1], m)).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        # places in the sorted arrays: a window holds a vector if its place lies between the window's ends
        self.place = np.empty(order.shape, np.uint16 if len(rows) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, order, np.arange(len(rows), dtype=self.place.dtype)[None], axis=1)

    def cosines(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Row by row in double precision, so equal vectors have equal scores wherever they lie."""
        return (self.rows[places] * query).sum(axis=1) / (self.lengths[places] * math.sqrt((query * query).sum()))

    def search(self, queries: np.ndarray, bounds: np.ndarray, own: np.ndarray, ids: np.ndarray,
               k: int, least: int, width: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (places, scores) of at most k best, nearest first, ties to the smaller id. `own` is
        the query's own place or -1, `bounds` a distance within which k vectors are known to lie."""
        m, n = self.place.shape
        counted = np.uint8 if m < 1 << 8 else np.uint16
        centre = ((queries / lengths(queries)[:, None]) @ directions(queries.shape[1], m)).T
        windows = []
        for step in range(STEPS, -1, -1):
            reach = bounds * 2.0 ** (-step / 2)
            low, high = (np.stack([np.searchsorted(a, c + sign * width / 2 * reach, side) for a, c in zip(self.sorted, centre)], axis=1)
                         for sign, side in ((-1, "left"), (1, "right")))
            windows.append((reach, low.astype(self.place.dtype)[:, :, None], (high - low).astype(self.place.dtype)[:, :, None], (high - low).sum(axis=1)))
        found = []
        for q in range(len(queries)):
            seen, places, scores = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0)
            if own[q] >= 0:
                seen[own[q]] = True
            for reach, low, held, hits in windows:
                if hits[q] < least:
                    continue
                # unsigned: a place before the window's start wraps round and lies beyond its length
                collisions = np.add.reduce((self.place - low[q] < held[q]).view(np.uint8), axis=0, dtype=counted)
                fresh = np.flatnonzero((collisions >= least) & ~seen)
                if len(fresh):
                    seen[fresh] = True
                    places = np.concatenate((places, fresh))
                    scores = np.concatenate((scores, self.cosines(fresh, queries[q])))
                    best = _best(scores, ids[places], places, k)
                    places, scores = places[best], scores[best]
                if len(places) == k and scores[-1] >= 1 - reach[q] ** 2 / 2:
                    break  # distance of the k-th best is within reach
            found.append((places, scores))
        return found


def _best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The k first in order of falling score, id and place, of many."""
    k = min(k, len(scores))
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((places[near], ids[near], -scores[near]))[:k]]


def usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return flat.astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where `is_query` its k nearest other rows by cosine.

    Nearest first, ties to the smaller vec_id; all rows if there are fewer. Null, zero and partly null or
    non-finite vectors and rows without a vec_id take no part; vectors of other lengths aren't compared.
    Every row is itself: one that repeats a vec_id is a candidate for the other, and as a query it gives
    rows of its own. Other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding",
        F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    table = written(rows, "collision-rows")  # row numbers are settled here
    counts = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(1, math.ceil(counts.n / min(SHARD_ROWS, 4 * math.isqrt(counts.n) + 1)))
    groups = max(1, math.ceil(counts.q / GROUP_QUERIES))
    m, least, width = plan(counts.n)
    sample: dict[int, list] = {}
    for row in table.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "embedding").toLocalIterator():
        sample.setdefault(len(row.embedding), []).append((row.row, row.embedding))
    known = {dim: (np.array([r for r, _ in own]), np.array([v for _, v in own], float)) for dim, own in sample.items()}
    spread = lambda name, count: F.pmod(F.xxhash64(F.lit(name), "row"), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    asking = table.where("asks").select("dim", "row", "vec_id", "embedding", spread("group", groups).alias("grp"), every(shards).alias("shard"))
    held = table.select("dim", "row", "vec_id", "embedding", spread("shard", shards).alias("shard"), every(groups).alias("grp"))
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def bounds(dim: int, rows_: np.ndarray, x: np.ndarray) -> np.ndarray:
        names, y = known.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        reach = np.full(len(x), np.inf)
        if len(names) > k:
            close = (x / lengths(x)[:, None]) @ (y / lengths(y)[:, None]).T
            close[rows_[:, None] == names[None]] = -2
            fifth = -np.partition(-close, k - 1, axis=1)[:, k - 1]
            reach = np.sqrt(np.maximum(2 - 2 * fifth, 0)) + 1e-6
        return reach

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = _rows(left.column("embedding"), dim), _rows(right.column("embedding"), dim)
        asked, names = left.column("row").to_numpy(), left.column("vec_id").to_numpy()
        row, ids = right.column("row").to_numpy(), right.column("vec_id").to_numpy()
        by = np.lexsort((row, ids))
        y, row, ids = y[by], row[by], ids[by]
        at = {r: i for i, r in enumerate(row.tolist())}
        own = np.array([at.get(r, -1) for r in asked.tolist()])
        found = Shard(y, m).search(x, bounds(dim, asked, x), own, ids, k, least, width)
        size = [len(p) for p, _ in found]
        places = np.concatenate([p for p, _ in found]).astype(np.int64)
        return pa.table([np.repeat(asked, size), np.repeat(names, size), row[places], ids[places], np.concatenate([s for _, s in found])], schema=schema)

    keys = ("dim", "grp", "shard")
    met = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
        meet, "query_row long, query_id long, row long, vec_id long, score double")
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
