"""Agreement with an external ranking.

The external ranking is a short published list. Everything after the join with it has at most as
many rows as that list, so its windows and broadcasts are bounded by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.functions import labels, parse
from ladderline.operators.ordinal import with_ordinal
from ladderline.operators.summary import side_by_side

TOP = 10


def _table(spark: SparkSession, rows: list, names: list[str]) -> DataFrame:
    values = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows])
    return spark.range(1).select(F.inline(values))


def external_ranking(spark: SparkSession) -> DataFrame:
    return _table(spark, fv.EXTERNAL_RANKING, ["ref_team", "ref_elo", "ref_rank"])


def external_names(spark: SparkSession) -> DataFrame:
    return _table(spark, list(fv.EXTERNAL_NAMES.items()), ["team", "ref_team"])


def matched(ranked: DataFrame, ranking: DataFrame, names: DataFrame) -> DataFrame:
    """External entries that have a rating, with `local_rank` among themselves.

    Two teams may map to one external name; the worse ranked one counts. Unmapped teams match under
    their own name.
    """
    named = ranked.select("team", "rating", "rank").join(
        names.select("team", F.col("ref_team").alias("mapped")), "team", "left")
    named = named.withColumn("ref_team", F.coalesce(F.nullif("mapped", F.lit("")), "team"))
    found = named.join(ranking, "ref_team").groupBy("ref_team", "ref_elo", "ref_rank").agg(
        F.max("rank").alias("rank"), F.max_by("rating", "rank").alias("rating"))
    best_first = W.orderBy(F.desc("rating"), "ref_rank")
    return found.withColumn("local_rank", F.row_number().over(best_first).cast("long"))


def compare(found: DataFrame, ranking: DataFrame) -> DataFrame:
    """The whole external ranking with what was matched; NULL where nothing was."""
    mine = found.select("ref_team", "local_rank", "rating")
    change = F.col("local_rank") - F.col("ref_rank")
    return ranking.join(mine, "ref_team", "left").select(
        "ref_team", F.col("ref_rank").cast("long").alias("ref_rank"), F.col("ref_elo").cast("long").alias("ref_elo"),
        "local_rank", parse.half_up(F.col("rating")).alias("rating"), change.alias("rank_diff"))


def assign_ranks(df: DataFrame, value: str, position: str, name: str, ascending: bool = True) -> DataFrame:
    """Ordinal ranks of `value`, equal values by `position`. For tables of any size."""
    order = F.asc(value) if ascending else F.desc(value)
    return with_ordinal(df, [order, position], name, "assign-ranks")


def spearman(found: DataFrame) -> DataFrame:
    """Rank correlation of rating and external rating over the matched entries; 0 below two."""
    x = F.row_number().over(W.orderBy("rating", "ref_rank"))
    y = F.row_number().over(W.orderBy("ref_elo", "ref_rank"))
    d = (F.col("x") - F.col("y")).cast("double")
    n = F.count(F.lit(1)).cast("double")
    rho = F.lit(1.0) - F.lit(6.0) * F.sum(d * d) / (n * (n * n - F.lit(1.0)))
    return found.select(x.alias("x"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.when(n > 1, rho).otherwise(0.0).alias("spearman"))


def rank_error(found: DataFrame) -> DataFrame:
    """Mean absolute difference of local and external rank; 0 when nothing matched."""
    return found.agg(F.coalesce(
        F.avg(F.abs(F.col("local_rank") - F.col("ref_rank"))), F.lit(0.0)).alias("mean_abs_rank_error"))


def top_overlap(found: DataFrame, n: int = TOP) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if((F.col("local_rank") <= n) & (F.col("ref_rank") <= n)).alias("overlap"))


def before_after(old: DataFrame, new: DataFrame, ranking: DataFrame, key_teams: list[str]) -> DataFrame:
    """Local ranks of two runs side by side; an unmatched rank is 0, a positive change is better."""
    before = old.select("ref_team", F.col("local_rank").alias("o"))
    after = new.select("ref_team", F.col("local_rank").alias("n"))
    return (
        ranking.join(before, "ref_team", "left").join(after, "ref_team", "left")
        .select("ref_team", F.coalesce("o", F.lit(0)).alias("old_rank"), F.coalesce("n", F.lit(0)).alias("new_rank"),
                F.col("ref_rank").cast("long").alias("ref_rank"))
        .withColumn("change", F.col("old_rank") - F.col("new_rank"))
        .withColumn("change_label", labels.signed(F.col("change")))
        .withColumn("key_team", F.col("ref_team").isin(key_teams))
    )


def spearman_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    before = spearman(old).select(F.col("spearman").alias("old_spearman"))
    after = spearman(new).select(F.col("spearman").alias("new_spearman"))
    return side_by_side(before, after).withColumn(
        "change", F.col("new_spearman") - F.col("old_spearman"))


def movements(old_ranked: DataFrame, new_ranked: DataFrame) -> DataFrame:
    """Global rank before and after with IMPROVED / dropped / unchanged; an absent rank is 0."""
    before = old_ranked.select("team", F.col("rank").alias("o"))
    after = new_ranked.select("team", F.col("rank").alias("n"))
    both = before.join(after, "team", "full").select(
        "team", F.coalesce("o", F.lit(0)).alias("old_rank"), F.coalesce("n", F.lit(0)).alias("new_rank"))
    return both.withColumn("movement", labels.movement(F.col("old_rank"), F.col("new_rank")))


def rating_difference(ranked: DataFrame, ranking: DataFrame, names: DataFrame) -> DataFrame:
    """Per mapped team its distance to the external rating, using the global rank."""
    found = ranked.join(names, "team").join(ranking, "ref_team")
    return found.where((F.coalesce("ref_elo", F.lit(0)) != 0) & (F.coalesce("ref_rank", F.lit(0)) != 0)).select(
        "team", "ref_team", (parse.half_up(F.col("rating")) - F.col("ref_elo")).alias("rating_diff"),
        (F.col("rank") - F.col("ref_rank")).alias("rank_diff"))
