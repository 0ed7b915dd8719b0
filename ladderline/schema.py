"""Schemas of the tables that pass between jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per match. (ts, src_rank, ord) is the total order every operator relies on: Spark rows
# have no input order, so the order in which equal instants were read is part of the data.
MATCHES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("date", T.StringType()),
    T.StructField("league", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("home", T.StringType()),
    T.StructField("away", T.StringType()),
    T.StructField("hg", T.IntegerType()),
    T.StructField("ag", T.IntegerType()),
    T.StructField("matchday", T.IntegerType()),
    T.StructField("src_rank", T.IntegerType()),
    T.StructField("ord", T.LongType()),
])
MATCH_ORDER = ["ts", "src_rank", "ord"]

REGISTRY = T.StructType([
    T.StructField("team", T.StringType()),
    T.StructField("league", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("matches_played", T.LongType()),
])

# What the fold knows about a team after its last processed row.
TEAM_STATE = T.StructType([
    T.StructField("rating", T.DoubleType()),
    T.StructField("seq", T.LongType()),
    T.StructField("break_no", T.IntegerType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("wins", T.LongType()),
    T.StructField("draws", T.LongType()),
    T.StructField("losses", T.LongType()),
    T.StructField("last_date", T.StringType()),
    T.StructField("first_ts", T.TimestampType()),
    T.StructField("first_src_rank", T.IntegerType()),
    T.StructField("first_ord", T.LongType()),
    T.StructField("first_side", T.IntegerType()),
])

# Long output of the fold. event is 'match', 'regress' or 'state'; side is 0 home, 1 away.
RATING_EVENTS = T.StructType([
    T.StructField("team", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("match_id", T.LongType()),
    T.StructField("side", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_rank", T.IntegerType()),
    T.StructField("ord", T.LongType()),
    T.StructField("rating_before", T.DoubleType()),
    T.StructField("rating_after", T.DoubleType()),
    T.StructField("state", TEAM_STATE),
])

HISTORY_ENTRY = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("rating", T.DoubleType()),
])


def empty(spark, schema):
    return spark.createDataFrame([], schema)
