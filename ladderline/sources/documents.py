"""JSON documents of ratings, daily ratings and the registry.

A document is an object; a large one is written as several documents of the same form, one per file
(see sinks/documents.py) with a manifest beside them. Every file is read as one document, however it is laid out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline.schema import HISTORY_ENTRY, REGISTRY, empty
from ladderline.sinks.documents import MANIFEST, figures
from ladderline.sources.tables import exists

TEAM_ENTRY = T.StructType([
    T.StructField("team", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("matches", T.LongType()),
    T.StructField("wins", T.LongType()),
    T.StructField("draws", T.LongType()),
    T.StructField("losses", T.LongType()),
    T.StructField("lastUpdated", T.StringType()),
    T.StructField("ratingHistory", T.ArrayType(HISTORY_ENTRY)),
])
CONFIG_ENTRY = T.StructType([
    T.StructField("initialRating", T.DoubleType()),
    T.StructField("kFactor", T.DoubleType()),
    T.StructField("homeAdvantage", T.DoubleType()),
    T.StructField("goalMarginFactor", T.BooleanType()),
    T.StructField("leagueStrength", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("leagueBaseline", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("seasonRegression", T.DoubleType()),
])
# firstRank and firstEntry place a part of a split document; a whole document lacks them.
RATINGS_DOCUMENT = T.StructType([
    T.StructField("config", CONFIG_ENTRY),
    T.StructField("computedAt", T.StringType()),
    T.StructField("matchesProcessed", T.LongType()),
    T.StructField("firstRank", T.LongType()),
    T.StructField("firstEntry", T.LongType()),
    T.StructField("teams", T.ArrayType(TEAM_ENTRY)),
])
REGISTRY_ENTRY = T.StructType([
    T.StructField("league", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("matchesPlayed", T.LongType()),
])


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """The documents below `path`; raises where a manifest lies beside them that doesn't fit them."""
    texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    if exists(spark, f"{path}/{MANIFEST}"):
        told = spark.read.schema("documents long, hashes string").json(f"{path}/{MANIFEST}").collect()
        found = figures(texts).first()
        if len(told) != 1 or tuple(told[0]) != tuple(found):
            raise RuntimeError(f"{path} holds {found.documents} documents that are not the {told[0].documents if told else 'unknown'} written")
    return texts


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """team, league, country, matches_played; no rows when absent."""
    if not exists(spark, path):
        return empty(spark, REGISTRY)
    kind = T.MapType(T.StringType(), REGISTRY_ENTRY)
    return (
        _texts(spark, path).select(F.explode(F.from_json("value", kind)).alias("team", "e"))
        .select("team", "e.league", "e.country", F.col("e.matchesPlayed").alias("matches_played")))


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    return _texts(spark, path).select(F.from_json("value", RATINGS_DOCUMENT).alias("d")).select("d.*")


def read_ratings(spark: SparkSession, path: str, run: bool = False) -> DataFrame:
    """Ranked teams; a team's place in the document is its rank. `run` adds what its document says of the run."""
    about = ["computedAt", "matchesProcessed"] if run else []
    first_rank = F.coalesce("firstRank", F.lit(1))
    return (
        _ratings(spark, path).where(F.coalesce("firstEntry", F.lit(1)) == 1)
        .select(*about, first_rank.alias("first_rank"), F.posexplode("teams").alias("pos", "t"))
        .select((F.col("first_rank") + F.col("pos")).alias("rank"), "t.team", "t.rating", "t.matches", "t.wins",
                "t.draws", "t.losses", F.col("t.lastUpdated").alias("last_updated"), *about))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """team, seq, date, rating."""
    return (
        _ratings(spark, path)
        .select(F.coalesce("firstEntry", F.lit(1)).alias("first"), F.explode("teams").alias("t"))
        .select("first", "t.team", F.posexplode("t.ratingHistory").alias("pos", "h"))
        .select("team", (F.col("first") + F.col("pos")).alias("seq"), "h.date", "h.rating"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """config, computedAt and matchesProcessed of the run."""
    return _ratings(spark, path).where(
        (F.coalesce("firstRank", F.lit(1)) == 1) & (F.coalesce("firstEntry", F.lit(1)) == 1)
    ).select("config", "computedAt", "matchesProcessed")


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """team, date, rating."""
    kind = T.MapType(T.StringType(), T.ArrayType(HISTORY_ENTRY))
    return (
        _texts(spark, path).select(F.explode(F.from_json("value", kind)).alias("team", "days"))
        .select("team", F.inline("days")))
