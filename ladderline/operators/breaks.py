"""Season breaks: pauses of at least `season_gap_days` across all leagues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import parse
from ladderline.operators.perspective import team_names


def bucket(ts: Column, config: RatingConfig) -> Column:
    """Half-gap time bucket. No gap fits inside one bucket, so a break always starts a bucket."""
    return F.floor(F.unix_millis(ts) / F.lit(config.gap_ms // 2)).cast("long")


def bucket_spans(matches: DataFrame, config: RatingConfig, earlier: tuple | None = None) -> DataFrame:
    """One row per non-empty bucket: bucket, first_ts, last_ts, prev_ts, is_break, break_no.

    The window runs over buckets, not matches: a century of 60-day gaps is 1,200 rows. `earlier` is
    (instant, break number) of the last match before all of `matches`.
    """
    before, passed = earlier or (None, 0)
    spans = (
        matches.where(F.col("ts").isNotNull())
        .groupBy(bucket(F.col("ts"), config).alias("bucket"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    in_time = W.orderBy("bucket")
    gap = F.unix_millis("first_ts") - F.unix_millis("prev_ts")
    return (
        spans.withColumn("prev_ts", F.coalesce(F.lag("last_ts").over(in_time), F.lit(before).cast("timestamp")))
        .withColumn("is_break", F.coalesce(gap >= F.lit(config.gap_ms), F.lit(False)))
        .withColumn("break_no", (F.lit(passed) + F.sum(F.col("is_break").cast("int")).over(in_time)).cast("int"))
    )


def with_break_no(matches: DataFrame, config: RatingConfig, spans: DataFrame | None = None) -> DataFrame:
    """Attach how many breaks lie at or before each match."""
    spans = bucket_spans(matches, config) if spans is None else spans
    # bounded by the covered time span, see bucket_spans
    numbers = F.broadcast(spans.select("bucket", "break_no"))
    return (
        matches.withColumn("bucket", bucket(F.col("ts"), config)).join(numbers, "bucket").drop("bucket")
    )


def dated_breaks(matches: DataFrame, spans: DataFrame) -> dict[int, tuple[str, int]]:
    """break_no -> (day text of the match that ends the pause, its instant in microseconds).

    Collected: there is at most one break per gap length of the covered time span.
    """
    numbers = {r["us"]: r["break_no"] for r in spans.where("is_break")
               .select(F.unix_micros("first_ts").alias("us"), "break_no").collect()}
    if not numbers:
        return {}
    instants = [F.expr(f"timestamp_micros({us})") for us in numbers]
    days = (
        matches.where(F.col("ts").isin(*instants))
        .groupBy(F.unix_micros("ts").alias("us"))
        .agg(F.min_by("date", F.struct("src_rank", "ord")).alias("date"))
        .select("us", parse.day_of(F.col("date")).alias("day"))
        .collect()
    )
    return {numbers[r["us"]]: (r["day"], r["us"]) for r in days}


def season_breaks(matches: DataFrame, config: RatingConfig) -> DataFrame:
    """Report per break: the days around it, its length in whole days and the teams seen before."""
    spans = bucket_spans(matches, config)
    debuts = (
        team_names(matches)
        .groupBy("team").agg(F.min(bucket(F.col("ts"), config)).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("debuts"))
    )
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    gap_days = (F.unix_millis("first_ts") - F.unix_millis("prev_ts")) / F.lit(86_400_000)
    return (
        spans.join(debuts, "bucket", "left")
        .withColumn("teams_seen", F.coalesce(F.sum("debuts").over(earlier), F.lit(0)))
        .where("is_break")
        .select(
            F.col("break_no").cast("long").alias("break_no"),
            F.date_format("prev_ts", "yyyy-MM-dd").alias("prev_date"),
            F.date_format("first_ts", "yyyy-MM-dd").alias("date"),
            parse.half_up(gap_days).alias("gap_days"),
            "teams_seen",
        )
    )
