"""Words, shared-folder helpers and connected components for the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.session import discard, new_path, written

SPACES = r"[\x20\x09-\x0D]+"
# bytes.split() without arguments cuts at exactly these six bytes


def words(text: str | Column) -> Column:
    """Maximal runs without space, tab, newline, vertical tab, form feed or return; none for null."""
    filled = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(filled == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(filled, SPACES))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that it reads several times, worked out once: a lambda's argument is a value."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digest(text: str) -> Column:
    """128-bit hash of a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_letters() -> dict[str, int]:
    """The byte-level letters: printable Latin-1 stands for itself, other bytes for 256 and up in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, so that extra columns can't clash with ours."""
    return f"_{stem}_{uuid.uuid4().hex[:12]}"


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema, limit_rows: int = 4096,
                  limit_bytes: int = 16 << 20, weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= limit_rows or weight >= limit_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (u, v): a row (node, root) for every node that isn't
    the smallest of its component.

    Alternating large-star and small-star steps: every node learns its smallest neighbour by an
    aggregation, which combines before the shuffle, and passes it on by an equi-join with one row
    per node, so a node with very many neighbours is split by the skew join. Each round is written
    to the shared folder. The loop ends when a round changes nothing.
    """
    spark = edges.sparkSession
    path = new_path(spark, label)
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, mark = _round(pairs, path)
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        following = new_path(spark, label)
        before = mark
        current, mark = _round(small, following)
        discard(spark, path)
        path = following
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def _round(pairs: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    table = written(pairs, "", path)
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return table, tuple(row)
