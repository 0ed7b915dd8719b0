"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.session import side, written

# monotonically_increasing_id keeps the row's place within its partition in the low 33 bits.
_PLACE_BITS = 33
BUCKET_ROWS = 1_000_000


def with_ordinal(df: DataFrame, order: list, name: str, label: str = "ordinal") -> DataFrame:
    """Number all rows 1..n in `order`, which must be a total order.

    The range-partitioned sort is written once; a row's number is its place in its partition plus
    the sizes of the partitions before it. Only the partition sizes meet in one window. The sort
    evaluates `df` twice, to sample and to sort: give it a written table when that is dear.
    """
    slot = f"_{name}_slot"
    part = F.shiftright(F.col(slot), _PLACE_BITS)
    place = F.col(slot).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    kept = written(df.orderBy(*order).withColumn(slot, F.monotonically_increasing_id()), label)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition of the sort, hence bounded by the shuffle partition setting
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + place + F.lit(1))
        .drop("_part", "_before", slot)
    )


def with_block_ordinal(df: DataFrame, order: list[str], name: str, label: str = "blocks", place: str | None = None) -> DataFrame:
    """Number rows 1..n by `order` of their blocks, then by their place in the block.

    A block is a part of a file that one task reads, and `order` has the columns that order blocks
    totally. A count per block gives every block its first number; there is no global sort. `df` is
    evaluated once, to be written.

    Without `place`, `df` is a narrow scan with `file` and `block` in the order it was read in: rows of
    a block lie together as written, and only counts are shuffled. With it, rows may come in any order
    and are numbered within their block by `place`.
    """
    slot = f"_{name}_slot"
    kept = written(df.withColumn(slot, F.monotonically_increasing_id()), label)
    part = F.shiftright(F.col(slot), _PLACE_BITS)
    keys = list(dict.fromkeys(order if place else ["file", "block", *order]))
    grouped = kept.groupBy(*keys) if place else kept.groupBy(part.alias("_part"), *keys)
    blocks = grouped.agg(F.count(F.lit(1)).alias("_n"), F.min(slot).alias("_first"))
    # a row per block of a file: some 100 MB of text each
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(before), F.lit(0))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    named = [F.col(k).alias(f"_of_{k}") for k in keys]
    if place:
        offsets, inside = blocks.select(*named, ahead.alias("_shift")), F.row_number().over(W.partitionBy(*keys).orderBy(place))
        rows = kept.withColumn("_inside", inside)
    else:
        offsets = blocks.select("_part", *named, (ahead - F.col("_first") + F.lit(1)).alias("_shift"))
        rows, same = kept.withColumn("_own", part).withColumn("_inside", F.col(slot)), (F.col("_own") == F.col("_part")) & same
    made = ["_own", "_part", "_inside", "_shift", slot, *[f"_of_{k}" for k in keys]]
    return rows.join(side(offsets, label), same).withColumn(name, F.col("_inside") + F.col("_shift")).drop(*made)


def with_time_ordinal(df: DataFrame, name: str, label: str = "instants", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Number rows 1..n by (ts, src_rank, ord), which must be a total order, with ord unique per src_rank.

    Rows are counted by instant; an instant of more than `bucket_rows` rows is counted by stretches of
    `bucket_rows` ords of a source. Counts before a bucket plus the place inside give the number. `df`
    is evaluated once, to be written; each row is shuffled once, to its bucket.
    """
    kept = written(df, label)
    heavy = kept.groupBy("ts").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows).select(F.col("ts").alias("_ts"))
    marked = kept.join(side(heavy, label), F.col("ts").eqNullSafe(F.col("_ts")), "left")
    whole = F.col("_ts").isNull()
    bucketed = marked.withColumns({
        "_rank": F.when(~whole, F.col("src_rank")), "_stretch": F.when(~whole, F.floor(F.col("ord") / F.lit(bucket_rows)).cast("long"))}).drop("_ts")
    keys = ["ts", "_rank", "_stretch"]
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sums = prefix_sums(counts, keys, "_n", "_before", label).select(*[F.col(k).alias(f"_of{k}") for k in keys], "_before")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    inside = W.partitionBy(*keys).orderBy("src_rank", "ord")
    return (bucketed.withColumn("_place", F.row_number().over(inside)).join(side(sums, label), same)
            .withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name))


def prefix_sums(df: DataFrame, order: list, value: str, name: str, label: str = "prefix") -> DataFrame:
    """`name`: the sum of `value` over all rows before a row in `order`, which must be a total order.

    A range-partitioned sort, written once; sums inside its partitions, and over the partitions' totals.
    """
    slot = f"_{name}_slot"
    kept = written(df.orderBy(*order).withColumn(slot, F.monotonically_increasing_id()), label).withColumn(
        "_part", F.shiftright(F.col(slot), _PLACE_BITS))
    totals = kept.groupBy("_part").agg(F.sum(value).alias("_total"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    own = W.partitionBy("_part").orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
    # one offset per partition of the sort
    return (kept.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col(name) + F.col("_earlier")).drop("_part", "_earlier", slot))
