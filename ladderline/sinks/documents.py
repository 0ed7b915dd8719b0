"""JSON document sinks.

The documents are objects over all teams. Written as one value they would have to pass through one
task, so they are cut into parts of bounded size: at most `PART_TEAMS` teams and, for histories,
`PART_ENTRIES` entries per team. Each part is a document of the same form in a file of its own; with
few teams and short histories there is exactly one, the whole document.

Beside the parts lies a manifest: how many documents there are and a sum over their hashes. Readers
hold it against what they find, so that a lost, repeated or altered part is an error, not fewer teams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions.rating import literal_map
from ladderline.operators.ordinal import with_ordinal

PART_TEAMS = 200
PART_ENTRIES = 5_000


MANIFEST = "_manifest"  # a name that readers of the folder skip


def figures(texts: DataFrame) -> DataFrame:
    """One row: documents, and the sum of their hashes."""
    value = F.rtrim("value", F.lit("\n"))
    return texts.where(value != "").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(
        F.sum(F.xxhash64(value).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hashes"))


def _part(ordinal: str, size: int) -> Column:
    return F.floor((F.col(ordinal) - F.lit(1)) / F.lit(size)).cast("long")


def _object(entries: Column) -> Column:
    """A JSON object from (place, key, value) structs in place order."""
    ordered = F.array_sort(entries)
    return F.to_json(F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"], e["value"]))))


def _write(documents: DataFrame, path: str) -> None:
    """One document per file, at every size."""
    documents.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    spark = documents.sparkSession
    # what was written, not what would be written now
    figures(spark.read.text(path, wholetext=True)).coalesce(1).write.json(f"{path}/{MANIFEST}")


def write_registry(registry: DataFrame, path: str, part_teams: int = PART_TEAMS) -> None:
    """Object team -> {league, country, matchesPlayed} in order of first appearance."""
    placed = with_ordinal(registry, ["first_seen"], "place", "registry-order")
    entry = F.struct("place", F.col("team").alias("key"), F.struct(
        "league", "country", F.col("matches_played").alias("matchesPlayed")).alias("value"))
    documents = placed.groupBy(_part("place", part_teams).alias("part")).agg(
        _object(F.collect_list(entry)).alias("value"))
    _write(documents, path)


def write_daily(ranked: DataFrame, daily: DataFrame, path: str, part_teams: int = PART_TEAMS,
                part_entries: int = PART_ENTRIES) -> None:
    """Object team -> [{date, rating}], teams in rank order, days ascending.

    Days are cut by stretches of months of no more than `part_entries` days, at least one month. The
    month is read off the text: a kept date such as 31 February is no calendar day.
    """
    month = F.substring("date", 1, 4).cast("int") * 12 + F.substring("date", 6, 2).cast("int")
    day_part = F.floor(month / F.lit(max(1, part_entries // 31))).cast("long")
    per_team = (
        daily.join(ranked.select("team", "rank"), "team")
        .groupBy("team", "rank", day_part.alias("stretch"))
        .agg(F.array_sort(F.collect_list(F.struct("date", "rating"))).alias("days"))
    )
    entry = F.struct(F.col("rank").alias("place"), F.col("team").alias("key"), F.col("days").alias("value"))
    documents = per_team.groupBy(_part("rank", part_teams).alias("part"), "stretch").agg(
        _object(F.collect_list(entry)).alias("value"))
    _write(documents, path)


def config_struct(config: RatingConfig) -> Column:
    return F.struct(
        F.lit(config.initial_rating).alias("initialRating"), F.lit(config.k_factor).alias("kFactor"),
        F.lit(config.home_advantage).alias("homeAdvantage"), F.lit(config.goal_margin).alias("goalMarginFactor"),
        literal_map(config.league_strength).alias("leagueStrength"),
        literal_map(config.league_baseline).alias("leagueBaseline"),
        F.lit(config.season_regression).alias("seasonRegression"))


def write_ratings(ranked: DataFrame, events: DataFrame, matches_processed: int, computed_at: str,
                  config: RatingConfig, path: str, part_teams: int = PART_TEAMS,
                  part_entries: int = PART_ENTRIES) -> None:
    """{config, computedAt, matchesProcessed, teams[]} with teams in rank order."""
    pages = (
        events.withColumn("page", _part("seq", part_entries))
        .groupBy("team", "page")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "date", F.col("rating_after").alias("rating")))).alias("h"))
        .select("team", "page", F.transform(
            "h", lambda e: F.struct(e["date"].alias("date"), e["rating"].alias("rating"))).alias("ratingHistory"))
    )
    # every team has a first page, with or without events
    first = ranked.withColumn("page", F.lit(0).cast("long"))
    more = pages.where(F.col("page") > 0).select("team", "page").join(ranked, "team")
    rows = first.unionByName(more).join(pages, ["team", "page"], "left")
    entry = F.struct(
        "rank", F.struct(
            "team", "rating", "matches", "wins", "draws", "losses",
            F.coalesce("last_updated", F.lit("")).alias("lastUpdated"),
            F.coalesce("ratingHistory", F.expr("array()")).alias("ratingHistory")).alias("t"))
    documents = (
        rows.withColumn("part", _part("rank", part_teams)).groupBy("part", "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select("part", "page", F.to_json(F.struct(
            config_struct(config).alias("config"), F.lit(computed_at).alias("computedAt"),
            F.lit(matches_processed).cast("long").alias("matchesProcessed"),
            F.element_at("e", 1)["rank"].alias("firstRank"),
            (F.col("page") * F.lit(part_entries) + F.lit(1)).alias("firstEntry"),
            F.transform("e", lambda x: x["t"]).alias("teams"))).alias("value"))
    )
    _write(documents, path)
