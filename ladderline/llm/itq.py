"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Vectors are scaled to length one, centred, reduced to their principal axes and rotated so that the
signs of their coordinates are balanced codes that lose as little as possible (iterative
quantisation); mean, axes and rotation are learned on a bounded, hash-chosen sample. Every vector is
indexed. A code is cut into tables of 16 bits; two codes meet where a part of one lies within one
bit of the same part of the other, so all codes within 7 of 64 bits meet, and nearly all links do.
Meeting codes are compared by cosine on the original vectors in double precision.

Equal vectors of one label are one class with a count. Classes with one code are packed into blocks
of bounded size, and pairs of blocks are compared as matrices, so a dense group is never one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import components
from ladderline.session import written

BITS = 64
TABLES = 4
PART = BITS // TABLES
MAX_DISTANCE = 20  # differing bits beyond which no pair is compared; far above what a link shows
SAMPLE = 8192  # vectors that the rotation is learned on
ROTATIONS = 50
COSINE = 0.98
BLOCK = 128  # classes per packed block, on average


def learn(x: np.ndarray, bits: int = BITS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) so that code bits are the signs of (unit vector - mean) @ projection.

    Vectors of fewer dimensions than bits get several rotations, learned from different starts, so that
    every bit of a code is used.
    """
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(axis=0)
    centred = x - mean
    width = min(bits, x.shape[1])
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :width]
    v = centred @ axes
    found = []
    for start in range(-(-bits // width)):
        rotation = np.linalg.qr(np.random.default_rng(seed + start).normal(size=(width, width)))[0]
        for _ in range(ROTATIONS):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        found.append(axes @ rotation)
    return mean, np.concatenate(found, axis=1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Signed 64-bit codes of the rows of `x`."""
    d = len(mean)
    x = x[:, :d] if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    bits = (x / np.where(norm > 0, norm, 1) - mean) @ projection >= 0
    full = np.zeros((len(x), 64), np.uint8)
    full[:, :bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<i8").ravel()


def _matrix(column: pa.ListArray) -> list[np.ndarray] | np.ndarray:
    """Rows of a list column, as one matrix where all have one length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    return np.split(flat, np.cumsum(sizes)[:-1])


def _usable() -> Column:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & whole & F.exists("embedding", lambda x: x != 0))


def _coded(classes: DataFrame) -> DataFrame:
    chosen = classes.select("embedding", "cid").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").toArrow()
    rows = [np.asarray(v, float) for v in chosen.column(0).to_pylist()]
    lengths = [len(r) for r in rows]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if rows else 1
    mean, projection = learn(np.array([r for r in rows if len(r) == d])) if rows else (np.zeros(1), np.zeros((1, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            found = codes(x, mean, projection) if isinstance(x, np.ndarray) else [int(codes(r[None], mean, projection)[0]) for r in x]
            yield batch.append_column("code", pa.array(found, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, kinds + ", code long")


def _part(code: Column, t: int) -> Column:
    return F.shiftrightunsigned(code, t * PART).bitwiseAND(F.lit((1 << PART) - 1))


def code_pairs(found: DataFrame) -> DataFrame:
    """label, a, b, na, nb: codes a < b that meet in a table, each pair once, with their block counts.

    `found` has distinct (label, code) and `blocks`. A pair counts in the first table it meets in.
    """
    code = F.col("code")
    parts = F.array(*[F.struct(F.lit(t).alias("t"), _part(code, t).alias("part")) for t in range(TABLES)])
    index = found.select("label", code.alias("b"), F.col("blocks").alias("nb"), F.inline(parts))
    flips = F.array(*[F.lit(m).cast("long") for m in [0] + [1 << i for i in range(PART)]])
    probes = (found.select("label", code.alias("a"), F.col("blocks").alias("na"), F.inline(parts))
              .select("label", "a", "na", "t", F.explode(F.transform(flips, lambda m: F.col("part").bitwiseXOR(m))).alias("part")))
    both = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for t in range(TABLES - 1):
        earlier = earlier | ((F.col("t") > t) & (F.bit_count(_part(both, t)) <= 1))
    met = probes.join(index, ["label", "t", "part"]).where("a < b")
    return met.where(~earlier & (F.bit_count(both) <= MAX_DISTANCE)).select("label", "a", "b", "na", "nb")


def _compared(pairs: DataFrame, cosine: float) -> DataFrame:
    """node, links, other for every class of the pairs of blocks that links: how many vectors of the other
    block it links with, and one class that it is connected to."""
    kinds = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def block(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        lengths = np.sqrt(np.einsum("ij,ij->i", own, own))[:, None] * np.sqrt(np.einsum("ij,ij->i", other, other))[None]
        return own @ other.T / lengths >= cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, links, others = [], [], []
            same = batch.column("same").to_pylist()
            ids = [batch.column(f"{s}_ids") for s in "ab"]
            counts = [batch.column(f"{s}_n") for s in "ab"]
            data = [batch.column(f"{s}_x") for s in "ab"]
            single = np.array([len(a) == 1 and len(b) == 1 for a, b in zip(*ids)], bool)
            x, y = (_matrix(d) for d in data)
            plain = isinstance(x, np.ndarray) and isinstance(y, np.ndarray) and x.shape[1:] == y.shape[1:]
            if plain and single.all():
                # rows of one vector each, the usual case, all at once
                dot = np.einsum("ij,ij->i", x, y)
                ok = dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= cosine
                u, v = (c.flatten().to_numpy()[ok] for c in ids)
                n, m = (c.flatten().to_numpy()[ok] for c in counts)
                yield _links(np.concatenate((u, v)), np.concatenate((m, n)), np.concatenate((v, u)), kinds)
                continue
            for k in range(batch.num_rows):
                u, v = (np.array(c[k].as_py(), np.int64) for c in ids)
                n, m = (np.array(c[k].as_py(), np.int64) for c in counts)
                own, other = np.asarray(x[k], float).reshape(len(u), -1), np.asarray(y[k], float).reshape(len(v), -1)
                if own.shape[1] != other.shape[1]:
                    continue
                linked = block(own, other)
                if same[k]:
                    np.fill_diagonal(linked, False)
                for i in np.flatnonzero(linked.any(axis=1)).tolist():
                    nodes.append(u[i])
                    links.append(m[linked[i]].sum())
                    others.append(v[linked[i]].min())
                # the other side's classes; edges to all classes that share a partner follow from both directions
                for j in [] if same[k] else np.flatnonzero(linked.any(axis=0)).tolist():
                    nodes.append(v[j])
                    links.append(n[linked[:, j]].sum())
                    others.append(u[linked[:, j]].min())
                # least partners alone can miss a bridge: add, per pair of rows, what joins their components
                for i, j in _bridges(linked):
                    nodes.append(u[i])
                    links.append(0)
                    others.append(v[j])
            if nodes:
                yield _links(nodes, links, others, kinds)

    return pairs.mapInArrow(run, "node long, links long, other long")


def _links(nodes, links, others, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (nodes, links, others)], schema=kinds)


def _bridges(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the bipartite graph of `linked`: at most rows + columns edges."""
    rows, columns = linked.shape
    seen_row, seen_column = np.zeros(rows, bool), np.zeros(columns, bool)
    for start in range(rows):
        if seen_row[start]:
            continue
        seen_row[start] = True
        stack = [start]
        while stack:
            i = stack.pop()
            fresh = np.flatnonzero(linked[i] & ~seen_column)
            seen_column[fresh] = True
            for j in fresh.tolist():
                yield i, j
                more = np.flatnonzero(linked[:, j] & ~seen_row)
                seen_row[more] = True
                for r in more.tolist():
                    yield r, j
                    stack.append(r)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id, kept for every row of `vectors`.

    Only rows with equal labels are compared. Null labels, null ids, null or zero vectors and vectors
    with null or non-finite components link with nothing: no links, their own component. So do
    vectors of different lengths with each other. Rows of equal vectors and labels link. Rows that
    repeat a vec_id are vectors of their own for n_links and one node for component_id. kept is false
    for a null id. Other columns are ignored. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    good = rows.where(_usable())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"))
    coded = written(_coded(written(classes, "itq-classes")), "itq-codes")
    per_code = written(coded.groupBy("label", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.count(F.lit(1)).alias("m")), "itq-distinct")
    blocked = coded.join(per_code, ["label", "code"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    packed = blocked.groupBy("label", "code", "block").agg(F.collect_list(F.struct("cid", "n", "embedding")).alias("members")).select(
        "label", "code", "block", F.col("members.cid").alias("ids"), F.col("members.n").alias("n"), F.flatten("members.embedding").alias("x"))
    packed = written(packed, "itq-blocks")
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    across = code_pairs(per_code).withColumn("i", span("na")).withColumn("j", span("nb")).withColumn("same", F.lit(False))
    within = (per_code.where("m > 1").select("label", F.col("code").alias("a"), F.col("code").alias("b"), F.col("blocks").alias("na"), F.col("blocks").alias("nb"))
              .withColumn("i", span("na")).withColumn("j", F.explode(F.sequence("i", F.col("nb") - 1))).withColumn("same", F.col("i") == F.col("j")))
    side = lambda s, place: packed.select(
        F.col("label"), F.col("code").alias(s), F.col("block").alias(place), F.col("ids").alias(f"{s}_ids"), F.col("n").alias(f"{s}_n"), F.col("x").alias(f"{s}_x"))
    pairs = across.unionByName(within).join(side("a", "i"), ["label", "a", "i"]).join(side("b", "j"), ["label", "b", "j"]).select(
        "same", "a_ids", "a_n", "a_x", "b_ids", "b_n", "b_x")
    links = written(_compared(pairs, cosine), "itq-links")
    degrees = links.groupBy("node").agg(F.sum("links").alias("degree"))
    roots = components(links.select(F.col("node").alias("u"), F.col("other").alias("v")), "itq-round")
    known = (coded.select("label", "embedding", "cid", "n").join(degrees, F.col("cid") == degrees["node"], "left").drop("node")
             .join(roots, F.col("cid") == roots["node"], "left")
             .select("label", "embedding", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("linked"), F.coalesce("root", "cid").alias("component")))
    result = good.join(known, ["label", "embedding"]).select("vec_id", F.col("linked").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
