"""Each match seen from both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.functions import labels, parse


def team_names(matches: DataFrame) -> DataFrame:
    """team, ts and the rest of the order key, one row per side."""
    return matches.select(
        F.explode(F.array(
            F.struct(F.col("home").alias("team"), F.lit(0).alias("side")),
            F.struct(F.col("away").alias("team"), F.lit(1).alias("side")),
        )).alias("s"),
        "league", "ts", "src_rank", "ord",
    ).select("s.team", "s.side", "league", "ts", "src_rank", "ord")


def team_matches(matches: DataFrame) -> DataFrame:
    """One row per team and match; side 0 is home and comes first within a match."""
    def seen(team, opponent, own, other, side):
        return F.struct(
            F.col(team).alias("team"), F.col(opponent).alias("opponent"),
            F.col(own).alias("goals"), F.col(other).alias("opp_goals"), F.lit(side).alias("side"))

    sides = F.explode(F.array(seen("home", "away", "hg", "ag", 0), seen("away", "home", "ag", "hg", 1)))
    return (
        matches.select("id", "ts", "src_rank", "ord", "date", "league", sides.alias("s"))
        .select("id", "ts", "src_rank", "ord", "date", "league", "s.*")
        .withColumn("day", parse.day_of(F.col("date")))
        .withColumn("home_away", F.when(F.col("side") == 0, "H").otherwise("A"))
        .withColumn("score", F.concat_ws("-", F.col("goals").cast("string"), F.col("opp_goals").cast("string")))
        .withColumn("result", labels.result(F.col("goals"), F.col("opp_goals")))
    )
