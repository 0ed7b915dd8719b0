"""Match payloads: documents with a `matches` array; the path carries `<league>_<year>`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline.functions import parse
from ladderline.operators.ordinal import with_block_ordinal
from ladderline.sources.season_csv import league_position

_TEAM = T.StructType([T.StructField("name", T.StringType())])
_GOALS = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("away", T.IntegerType())])
PAYLOAD = T.StructType([T.StructField("matches", T.ArrayType(T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("utcDate", T.StringType()),
    T.StructField("matchday", T.IntegerType()),
    T.StructField("homeTeam", _TEAM),
    T.StructField("awayTeam", _TEAM),
    T.StructField("score", T.StructType([T.StructField("fullTime", _GOALS)])),
])))])
MIN_BYTES = 100
# the last such name on the path: the file's own, else the nearest folder's
_NAME = r"(?s).*(?<![A-Za-z0-9])([A-Z]+[0-9]*)_([0-9]{4})(?![0-9])"


def payload_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per match entry. `multi_line=False` reads files holding one document per line."""
    docs = (
        spark.read.schema(PAYLOAD).option("multiLine", multi_line).option("recursiveFileLookup", "true").json(path)
        .select("matches", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        .where(F.col("size") > MIN_BYTES)
    )
    return docs.where(F.regexp_extract("file", _NAME, 1) != "").select(
        F.regexp_extract("file", _NAME, 1).alias("league"),
        F.regexp_extract("file", _NAME, 2).cast("int").alias("year"),
        "file", "block", "place", F.posexplode("matches").alias("pos", "m"))


def projected(entries: DataFrame) -> DataFrame:
    """Entries with a full-time score; missing names are 'Unknown', a missing matchday is 0."""
    unknown = F.lit("Unknown")
    score = F.col("m.score.fullTime")
    return (
        entries.where(score["home"].isNotNull() & score["away"].isNotNull())
        .select(
            "league", "year", "file", "block", "place", "pos",
            F.col("m.id").alias("id"), F.col("m.utcDate").alias("date"),
            parse.season_from_year(F.col("year")).alias("season"),
            F.coalesce("m.homeTeam.name", unknown).alias("home"),
            F.coalesce("m.awayTeam.name", unknown).alias("away"),
            score["home"].alias("hg"), score["away"].alias("ag"),
            F.coalesce("m.matchday", F.lit(0)).alias("matchday"))
        .withColumn("ts", parse.instant(F.col("date")))
        .where(F.col("ts").isNotNull())
    )


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """file, reason, entries: payloads without a league and year in their name, and dropped entries."""
    docs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = F.regexp_extract("path", _NAME, 1) != ""
    whole = docs.select(F.col("path").alias("file"), F.when(F.col("length") <= MIN_BYTES, "too short").when(
        ~named, "no league and year in the name").alias("reason"), F.lit(0).cast("long").alias("entries"))
    score = F.col("m.score.fullTime")
    why = F.when(score["home"].isNull() | score["away"].isNull() | score.isNull(), "no full-time score").when(
        parse.instant(F.col("m.utcDate")).isNull(), "unreadable date")
    dropped = payload_rows(spark, path).select("file", why.alias("reason")).groupBy("file", "reason").agg(
        F.count(F.lit(1)).alias("entries"))
    return whole.unionByName(dropped).where("reason IS NOT NULL")


def read(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Payloads as a match table, ordered by league, season and place in the documents."""
    numbered = with_block_ordinal(
        projected(payload_rows(spark, path, multi_line)).withColumn("league_pos", league_position("league")),
        ["league_pos", "league", "year", "file", "block"], "ord", "api-order")
    return numbered.select("id", "ts", "date", "league", "season", "home", "away", "hg", "ag", "matchday",
                           F.lit(1).alias("src_rank"), "ord")
