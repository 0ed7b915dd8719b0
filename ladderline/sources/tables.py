"""Match tables, name maps and optional inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline import fixed_values as fv
from ladderline.functions import parse
from ladderline.operators.ordinal import with_block_ordinal
from ladderline.schema import MATCHES, empty

NAME_MAP = T.StructType([T.StructField("raw", T.StringType()), T.StructField("canonical", T.StringType())])
_MATCH_JSON = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("league", T.StringType()),
    T.StructField("season", T.StringType()),
    T.StructField("homeTeam", T.StringType()),
    T.StructField("awayTeam", T.StringType()),
    T.StructField("homeGoals", T.IntegerType()),
    T.StructField("awayGoals", T.IntegerType()),
    T.StructField("matchday", T.IntegerType()),
])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at `path`, on any file system the session can reach."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def optional(spark: SparkSession, path: str, reader, schema) -> DataFrame:
    """`reader(spark, path)`, or no rows when the path is absent."""
    return reader(spark, path) if exists(spark, path) else empty(spark, schema)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The match table as written by the match sink; it must exist."""
    # the season comes back from the folder names
    return spark.read.schema(MATCHES).parquet(path).select(*MATCHES.fieldNames())


def read_match_json(spark: SparkSession, path: str, src_rank: int = 0, multi_line: bool = True) -> DataFrame:
    """A JSON match list, whole or one match per line; `ord` is the place in the list."""
    raw = (
        spark.read.schema(_MATCH_JSON).option("multiLine", multi_line).json(path)
        .select("*", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"))
    )
    return with_block_ordinal(raw, ["file", "block"], "ord", "match-list").select(
        "id", parse.instant(F.col("date")).alias("ts"), "date", "league", "season",
        F.col("homeTeam").alias("home"), F.col("awayTeam").alias("away"),
        F.col("homeGoals").alias("hg"), F.col("awayGoals").alias("ag"), "matchday",
        F.lit(src_rank).alias("src_rank"), "ord")


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object raw name -> canonical name; no rows when the file is absent."""
    def reader(session, p):
        return (
            session.read.option("recursiveFileLookup", "true").text(p, wholetext=True)
            .select(F.explode(F.from_json("value", "map<string,string>")).alias("raw", "canonical")))

    return optional(spark, path, reader, NAME_MAP)


def default_name_map(spark: SparkSession) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(r).alias("raw"), F.lit(c).alias("canonical"))
                      for r, c in fv.CLUB_NAMES.items()])
    return spark.range(1).select(F.inline(pairs))
