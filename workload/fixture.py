"""Matches derived from the given tables: one per order, regions as leagues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline.functions import parse
from ladderline.session import prepare

SLOTS = 6  # teams per nation
LEAGUES = ["PL", "PD", "BL1", "SA", "FL1"]


# Schemas of the tables read, so that opening them starts no job.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey long, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation with its place in the region and all nation names of the region; 25 rows at every scale."""
    members = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return (
        table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(members.alias("m"))
        .select("n_regionkey", F.transform("m", lambda x: x["n_name"]).alias("names"), F.posexplode("m").alias("npos", "x"))
        .select("n_regionkey", "names", "npos", "x.n_nationkey", F.col("x.n_name").alias("home_nation"))
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    # June and July move on top of April and May: a gap of 62 days every summer, and no order is left out
    summer = F.month("o_orderdate").isin(6, 7)
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(
        summer, F.col("o_orderdate") - F.expr("INTERVAL 61 DAYS")).otherwise(F.col("o_orderdate")))
    base = (
        orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nations(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("n_regionkey").alias("rk"), "names", "home_nation",
            (F.size("names") * SLOTS).alias("teams"),
            (F.col("npos") * SLOTS + F.expr("o_custkey div 25") % SLOTS).alias("hidx"),
            F.floor("o_totalprice").cast("long").alias("p"),
        )
        .withColumn("aidx", (F.col("hidx") + 1 + F.col("id") % (F.col("teams") - 1)) % F.col("teams"))
    )
    away_nation = F.element_at("names", (F.expr(f"aidx div {SLOTS}") + 1).cast("int"))
    year = F.when(F.month("ts") >= 8, F.year("ts")).otherwise(F.year("ts") - 1)
    return base.select(
        "id", "ts",
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("date"),
        F.element_at(F.array(*[F.lit(x) for x in LEAGUES]), F.col("rk") + 1).alias("league"),
        parse.season_from_year(year).alias("season"),
        F.concat_ws("-", "home_nation", (F.col("hidx") % SLOTS).cast("string")).alias("home"),
        F.concat_ws("-", away_nation, (F.col("aidx") % SLOTS).cast("string")).alias("away"),
        (F.col("p") % 5).cast("int").alias("hg"),
        ((F.expr("p div 7") + F.col("id")) % 4).cast("int").alias("ag"),
        F.lit(0).alias("matchday"),
        F.lit(0).alias("src_rank"),
        F.col("id").alias("ord"),
    )


def player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches between customers: one league and one pool of very many teams."""
    customers = table(spark, sf_dir, "customer").count()
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"))
    other = (F.col("c") + 1 + (F.col("id") * 7919) % (customers - 1)) % customers
    return matches(spark, sf_dir).join(keys, "id").withColumns({
        "home": F.concat(F.lit("c"), F.col("c").cast("string")),
        "away": F.concat(F.lit("c"), other.cast("string")),
        "league": F.lit("PL"),
    }).drop("c")
