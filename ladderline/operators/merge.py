"""Merging two match sources and deriving the team registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.functions import parse, rating
from ladderline.operators.extremes import order_number
from ladderline.operators.ordinal import with_time_ordinal
from ladderline.operators.perspective import team_names
from ladderline.schema import MATCH_ORDER


def _keyed(matches: DataFrame) -> DataFrame:
    return matches.withColumn("day", parse.day_of(F.col("date")))


def uncovered(historical: DataFrame, preferred: DataFrame) -> DataFrame:
    """Historical matches that the preferred source does not have for the same day and teams.

    Repeats within either source stay.
    """
    keys = _keyed(preferred).select("day", "home", "away")
    return _keyed(historical).join(keys, ["day", "home", "away"], "left_anti").select(historical.columns)


def merged(historical: DataFrame, preferred: DataFrame) -> DataFrame:
    """One match table; at equal instants historical rows come first."""
    return (
        uncovered(historical, preferred).withColumn("src_rank", F.lit(0))
        .unionByName(preferred.withColumn("src_rank", F.lit(1)))
    )


def chronological(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*MATCH_ORDER)


def numbered(matches: DataFrame, name: str) -> DataFrame:
    """Matches with their place in chronological order."""
    return with_time_ordinal(matches, name, "chronological")


def dedup_stats(historical: DataFrame, preferred: DataFrame) -> DataFrame:
    """source, rows, kept, removed.

    Each source is read once and counted by day and teams; a full join of the counts says which
    historical rows are covered.
    """
    keys = ["day", "home", "away"]
    counted = lambda df, n: _keyed(df).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    own = counted(historical, "h")
    other = counted(preferred, "p").select(*[F.col(k).alias(f"_{k}") for k in keys], "p")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    none = F.lit(0).cast("long")
    both = own.join(other, same, "full").agg(
        F.coalesce(F.sum("h"), none).alias("h"), F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("h"))), none).alias("kept"),
        F.coalesce(F.sum("p"), none).alias("p"))
    line = lambda name, rows, kept: F.struct(F.lit(name).alias("source"), F.col(rows).alias("rows"), F.col(kept).alias("kept"))
    return both.select(F.explode(F.array(line("historical", "h", "kept"), line("api", "p", "p"))).alias("x")).where("x.rows > 0").select(
        "x.*", (F.col("x.rows") - F.col("x.kept")).alias("removed"))


def country(league: Column | str) -> Column:
    return rating.lookup(fv.LEAGUE_COUNTRY, league, "string")


def registry(matches: DataFrame) -> DataFrame:
    """team, league of its first match, country, matches played, and the order of first appearance."""
    # by team and league first: the order of a match is one number, so this hashes, and few rows are left
    leagues = team_names(matches).groupBy("team", "league").agg(
        F.min(order_number("side")).alias("at"), F.count(F.lit(1)).alias("n"))
    return (
        leagues.groupBy("team").agg(F.min(F.struct("at", "league")).alias("f"), F.sum("n").alias("matches_played"))
        .select("team", "f.league", country("f.league").alias("country"), "matches_played",
                F.col("f.at").alias("first_seen"))
    )
