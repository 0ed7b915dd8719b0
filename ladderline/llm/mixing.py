"""Mixing sources to target weights at exact budgets.

Every document gets a hash-random key. Within its source the keys are cut into about sqrt(rows) equal
ranges, which a hash fills evenly; ranges are sorted for running sums, and a second, equally small
sum over the range totals gives every document the words before it in its source. A source's budget
is then a comparison per row, with whole epochs in front. No source is one group, whatever its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.llm.common import unused, words
from ladderline.operators.ordinal import prefix_sums, with_ordinal
from ladderline.session import shuffle_partitions, side, written

SEED = "mix-1"
MAX_EPOCHS = 3
STRETCH = 100_000  # copies of a row that one task numbers
BUCKET_ROWS = 1_000  # rows of one doc_id, source and size that are numbered together, on average
WEIGHTS = (1, 2, 3)
_KEY_HEX = 15  # 60 bits of the key
_HALF = 30


def _key(doc_id: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, _KEY_HEX), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, rows, target for `sizes` (source, size, copies).

    Sources in code point order, null last, weigh `weights` in turn and share all sizes. A target
    stops at `max_epochs` times its source; what is left over is shared anew by weight. With sources
    in order of size per weight, the level at which the others share follows from two running sums.
    """
    totals = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
    # one row per source from here on; sources may be many, so both orders are range-partitioned sorts
    placed = with_ordinal(written(totals, "mix-sources"), [F.col("source").isNull(), "source"], "place", "mix-sources")
    cycle = F.array(*[F.lit(w) for w in weights])
    weight = F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"]
    by_cap = prefix_sums(ranked, order, "cap", "caps", "mix-caps")
    levelled = written(prefix_sums(by_cap, order, "weight", "weights", "mix-weights"), "mix-levels")
    whole = levelled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole.size or 0) - F.col("caps")) / (F.lit(whole.weight or 0) - F.col("weights"))
    # the first source in this order that doesn't reach its cap sets the level for all after it
    settled = levelled.withColumn("level", level).where(F.col("cap") > F.col("level") * F.col("weight")).agg(
        F.min(F.struct(F.col("cap") / F.col("weight"), F.col("level"))).alias("first")).first().first
    cap = F.col("cap").cast("double")
    share = F.least(cap, F.lit(settled.level) * F.col("weight")) if settled else cap
    return levelled.select("source", "source_size", "rows", share.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `docs`.

    `size` is the number of words, 0 for null text. `taken` counts repeats: whole epochs first, then
    the hash order up to the budget, whose last document gives only its first words. Rows with equal
    doc_id, source and size are interchangeable and keep their number. Null sources form one source,
    null doc_ids are ordinary values. Only sizes travel, never texts. An empty table gives no rows.
    """
    sizes = docs.select(F.col("doc_id"), F.col("source"), F.size(words("text")).cast("long").alias("size"))
    grouped = written(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    budget = targets(grouped, weights, max_epochs)
    ranges = F.ceil(F.sqrt("rows")).cast("long")
    keyed = (
        grouped.join(budget, grouped["source"].eqNullSafe(budget["source"])).drop(budget["source"])
        .withColumn("key", _key("doc_id"))
        .withColumn("range", F.shiftright(F.shiftright("key", _HALF) * ranges, _HALF))
    )
    before = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = written(keyed.withColumn(
        "inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0))), "mix-ranges")
    sums = inside.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("range_size"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_source"), F.col("range").alias("_range"),
                          F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("_offset"))
    placed = inside.join(
        offsets, inside["source"].eqNullSafe(offsets["_source"]) & (inside["range"] == offsets["_range"]))
    # copies are numbered in stretches of bounded size, dealt anew, so that no task expands all of a row's
    stretches = placed.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {STRETCH}"))))
    many = stretches.where(F.col("copies") > STRETCH).repartition(
        shuffle_partitions(docs.sparkSession), "doc_id", "source", "size", "stretch")
    start, end = F.col("stretch") * STRETCH, F.least((F.col("stretch") + 1) * STRETCH, F.col("copies")) - 1
    rows = (stretches.where(F.col("copies") <= STRETCH).unionByName(many)
            .withColumn("copy", F.explode(F.sequence(start, end))).drop("stretch"))
    position = F.col("_offset") + F.col("inside") + F.col("copy") * F.col("size")
    allowed = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), allowed - epochs * F.col("source_size") - position))
    taken = (epochs * F.col("size") + part).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "copy", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture itself: rows of `docs` once per epoch taken, the one at the cut shortened; same columns.

    Each row is taken as often as `mix` says of one row of its doc_id, source and size. Rows that share
    all three, for instance rows without a doc_id, are numbered by their text's hash in ranges of about
    a thousand, and each takes the number of one copy.
    """
    taken, size, copy, hashed, bucket = (unused(docs, x) for x in ("taken", "size", "copy", "hash", "bucket"))
    plan = written(mix(docs, weights, max_epochs).select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.col("copy").alias("_copy"), "copies", F.col("taken").alias(taken)), "mix-plan")
    named = docs.withColumn(size, F.size(words("text")).cast("long"))
    of = {"_doc": "doc_id", "_source": "source", "_size": size}
    same = F.lit(True)
    for key, name in of.items():
        same = same & F.col(name).eqNullSafe(F.col(key))
    several = side(plan.where("_copy = 0 AND copies > 1").select(*of, "copies"), "mix-several")
    alone = named.join(several, same, "left_anti").withColumn(copy, F.lit(0).cast("long"))
    shared = written(named.join(several, same).withColumn(hashed, F.xxhash64("text", F.monotonically_increasing_id()))
                     .withColumn(bucket, F.pmod(F.col(hashed), F.ceil(F.col("copies") / F.lit(BUCKET_ROWS))))
                     .select(*docs.columns, size, hashed, bucket), "mix-shared")
    of_bucket = shared.groupBy(*[F.col(name).alias(key) for key, name in of.items()], F.col(bucket).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*of).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = of_bucket.select(*of, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*of.values(), bucket).orderBy(hashed)
    numbered = (shared.withColumn(copy, F.row_number().over(inside) - 1).join(starts, same & (F.col(bucket) == F.col("_bucket")))
                .withColumn(copy, F.col(copy) + F.col("_start")))
    every = alone.select(*docs.columns, size, copy).unionByName(numbered.select(*docs.columns, size, copy))
    joined = every.join(plan.where(F.col(taken) > 0).drop("copies"), same & (F.col(copy) == F.col("_copy")))
    full, rest = F.expr(f"`{taken}` div `{size}`"), F.expr(f"`{taken}` % `{size}`")
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), full.cast("int")),
                      F.when(rest > 0, F.array(rest)).otherwise(F.expr("cast(array() as array<bigint>)")))
    piece = unused(docs, "piece")
    one = joined.withColumn(piece, F.explode(pieces))
    # the text up to the end of its rest-th word
    cut = F.array_join(F.slice(words("text"), F.lit(1), F.greatest(F.col(piece), F.lit(1)).cast("int")), " ")
    shaped = one.withColumn("text", F.when(F.col(piece) < 0, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        shaped = shaped.withColumn("n_chars", F.when(F.col(piece) < 0, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return shaped.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15] AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT level FROM l WHERE cap > level * weight ORDER BY cap::DOUBLE / weight, level LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, (SELECT level FROM m) * weight), cap::DOUBLE) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         CAST(floor(t.target) AS BIGINT) AS allowed
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN allowed // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, allowed - epochs * source_size - pos)) AS BIGINT) AS taken
FROM e
"""
