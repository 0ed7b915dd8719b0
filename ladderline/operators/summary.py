"""Counts and ranges over the match table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.functions import parse
from ladderline.operators.perspective import team_names


def league_season_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("league", "season").agg(F.count(F.lit(1)).alias("n"))


def league_totals(matches: DataFrame) -> DataFrame:
    """Per known league its total and its seasons as '2015: 380, 2016: 380'; 0 for absent leagues."""
    part = F.concat_ws(": ", F.substring("season", 1, 4), F.col("n").cast("string"))
    totals = league_season_counts(matches).groupBy("league").agg(
        F.sum("n").alias("total"),
        # one entry per season of the league
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("season", part.alias("part")))), lambda x: x["part"]),
            ", ").alias("parts"))
    spark = matches.sparkSession
    known = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in fv.LEAGUE_COUNTRY]))
                                  .alias("league_pos", "league"))
    return known.join(totals, "league", "left").select(
        F.col("league_pos").cast("long").alias("league_pos"), "league",
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("parts", F.lit("")).alias("parts"))


def date_range(matches: DataFrame) -> DataFrame:
    """First and last day by instant, and the same as years."""
    return (
        matches.agg(F.min_by("date", "ts").alias("a"), F.max_by("date", "ts").alias("b"))
        .where(F.col("a").isNotNull())
        .select(
            parse.day_of(F.col("a")).alias("first_day"), parse.day_of(F.col("b")).alias("last_day"),
            F.concat_ws("-", F.substring("a", 1, 4), F.substring("b", 1, 4)).alias("years"))
    )


def distinct_teams(matches: DataFrame) -> DataFrame:
    return team_names(matches).agg(F.countDistinct("team").alias("teams"))


def side_by_side(*tables: DataFrame) -> DataFrame:
    """The columns of tables of at most one row each as one row, without joins."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
