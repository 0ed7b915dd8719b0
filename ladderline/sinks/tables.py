"""The match table sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.schema import MATCH_ORDER, MATCHES


def write_matches(matches: DataFrame, path: str) -> None:
    """Replace the match table at `path`, laid out by season.

    Rebalancing gives a task few seasons, splits a large season over many tasks by its measured size
    and merges small ones.
    """
    (
        matches.select(*MATCHES.fieldNames())
        .hint("rebalance", F.col("season"))
        .sortWithinPartitions("season", *MATCH_ORDER)
        .write.mode("overwrite").partitionBy("season").parquet(path)
    )


def write_match_json(matches: DataFrame, path: str) -> None:
    """The match list as JSON lines in match order; files are in the order of their names."""
    matches.orderBy(*MATCH_ORDER).select(
        "id", "date", "league", "season", F.col("home").alias("homeTeam"), F.col("away").alias("awayTeam"),
        F.col("hg").alias("homeGoals"), F.col("ag").alias("awayGoals"), "matchday").write.mode("overwrite").json(path)
