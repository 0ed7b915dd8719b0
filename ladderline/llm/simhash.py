"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within two bits have a common neighbour at one bit from both, so every distinct
fingerprint emits itself and its 64 one-bit variants, and fingerprints meet on equal variants. A
variant has at most 65 fingerprints within one bit, which bounds every group whatever the data;
which of them are present fits into a bit mask that an aggregation can build.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import components, digest, unused
from ladderline.session import written

SHINGLE = 3
SEED = 42
RADIUS = 2  # differing bits that still link; variants reach half of it
_MASKS = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Majority bits of the hashes of all word shingles, as a signed 64-bit integer."""
    found = (text or b"").lower().split()  # bytes.lower() changes A-Z only
    if not found:
        return 0
    joined = b" ".join(found)
    n = max(1, len(found) - SHINGLE + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        block = np.array(hashes[at:at + _CHUNK], np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, the columns `more` and the fingerprint `fp` of every row; the text stays where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that connect all within RADIUS bits; `distinct` has `fp`."""
    flips = F.array(*[F.lit(m) for m in _MASKS])
    variants = distinct.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.groupBy("variant").agg(
        F.bit_or(F.col("fp").bitwiseXOR(F.col("variant"))).alias("bits"),
        F.max(F.col("fp") == F.col("variant")).alias("itself"))
    shared = met.where(F.bit_count("bits") + F.col("itself").cast("int") > 1)
    present = F.filter(flips, lambda m: F.when(m == 0, F.col("itself")).otherwise(F.col("bits").bitwiseAND(m) != 0))
    members = shared.select(F.transform(present, lambda m: F.col("variant").bitwiseXOR(m)).alias("members"))
    pairs = members.select(F.explode("members").alias("u"), F.array_min("members").alias("v"))
    return pairs.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS))


def _classes(found: DataFrame) -> DataFrame:
    """fp, root (one fingerprint of the component) and component_id for the distinct fingerprints of `found`."""
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(links(distinct), "simhash-round")
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included) for every row.

    Null text and text without words have fingerprint zero and link like any other. Equal
    fingerprints are one node. Rows with a null doc_id take part; a component of only such rows has
    a null component_id. Repeated rows give repeated results. Other columns are ignored. An empty
    table gives no rows.
    """
    found = written(fingerprints(docs), "simhash-fp")
    return found.join(_classes(found), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of `docs` for every component, same columns: a row of its smallest doc_id.

    Rows, not doc_ids, are chosen, by doc_id and a 128-bit hash of the text: rows that share a doc_id
    or have none stay side by side where their texts aren't linked. A row with a null doc_id stays
    only where no numbered document has a linked fingerprint. Of several rows with the smallest
    doc_id, or of only unnumbered ones, the least hash decides; null text counts as empty.
    """
    found = written(fingerprints(docs, digest("text").alias("digest")), "simhash-fp")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    chosen = found.join(_classes(found), "fp").groupBy("root").agg(least)
    kept = chosen.select(F.col("least.doc_id").alias("_kept"), F.col("least.digest").alias("_digest"))
    # a text has one fingerprint, so doc_id and hash belong to one component
    own, number = unused(docs, "digest"), unused(docs, "number")
    rows = docs.withColumn(own, digest("text")).withColumn(number, F.col("doc_id").cast("long"))
    same = F.col(number).eqNullSafe(F.col("_kept")) & (F.col(own) == F.col("_digest"))
    return rows.join(kept, same, "left_semi").dropDuplicates([number, own]).select(*docs.columns)
