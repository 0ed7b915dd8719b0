"""Rankings over final team records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.functions import parse, rating
from ladderline.operators.fold import FIRST_SEEN
from ladderline.operators.merge import country
from ladderline.operators.ordinal import with_ordinal
from ladderline.operators.summary import side_by_side
from ladderline.session import written

TOP = 20


def rating_order() -> list:
    return [F.desc("rating"), *FIRST_SEEN]


def ranked(states: DataFrame) -> DataFrame:
    """Final records with `rank`: rating descending, equal ratings by first appearance."""
    # the sort reads its input twice, to sample and to sort; the records come out of a fold
    return with_ordinal(written(states, "states"), rating_order(), "rank", "ranked")


def with_registry(teams: DataFrame, registry: DataFrame) -> DataFrame:
    """Ratings with league and country; unregistered teams keep '?'."""
    known = registry.select("team", F.col("league").alias("reg_league"), F.col("country").alias("reg_country"))
    joined = teams.join(known, "team", "left")
    missing = F.lit("?")
    return (
        joined.withColumn("registered", F.col("reg_league").isNotNull())
        .withColumn("league", F.coalesce(F.nullif("reg_league", F.lit("")), missing))
        .withColumn("country", F.coalesce(
            F.nullif("reg_country", F.lit("")), country("reg_league"), missing))
        .drop("reg_league", "reg_country")
    )


def league_names(teams: DataFrame, registry: DataFrame) -> DataFrame:
    """The three ways a league is shown: country code or '???', league label, team-page country."""
    known = registry.select("team", F.col("league").alias("l"), F.col("country").alias("c"))
    label = rating.lookup(fv.LEAGUE_LABEL, "l", "string")
    return teams.join(known, "team", "left").select(
        "team",
        F.when(F.col("l").isNull(), "???").otherwise(F.coalesce(country("l"), "l")).alias("short"),
        F.when(F.col("l").isNull(), "Unknown").otherwise(F.coalesce(label, "l")).alias("label"),
        F.coalesce("c", F.lit("???")).alias("country"),
    )


def display(ranked_teams: DataFrame, registry: DataFrame) -> DataFrame:
    """The printed ranking."""
    short = league_names(ranked_teams, registry).select("team", F.col("short").alias("league"))
    return ranked_teams.join(short, "team").select(
        "rank", "team", "league", parse.half_up(F.col("rating")).alias("rating"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("wins", "draws", "losses")]).alias("wdl"),
        parse.day_of(F.col("last_updated")).alias("updated"),
    )


def of_league(teams: DataFrame, league: str) -> DataFrame:
    """Teams whose country plays in `league`; 'ALL' keeps everyone."""
    if league == "ALL":
        return teams
    country_league = {c: code for code, c in fv.LEAGUE_COUNTRY.items()}
    return teams.where(rating.lookup(country_league, "country", "string") == league)


def top(teams: DataFrame, n: int = TOP) -> DataFrame:
    """The best n, ranked. Only n rows reach the window."""
    best = teams.orderBy(*rating_order()).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*rating_order())).cast("long"))


def league_ranks(ranked_teams: DataFrame) -> DataFrame:
    """Adds `league_rank`, counting from 1 inside each league in rank order.

    A league may hold most of the teams, so places come from one global numbering and each league's
    first number rather than from a window per league.
    """
    placed = with_ordinal(ranked_teams, ["league", "rank"], "_place", "league-rank")
    first = placed.groupBy("league").agg(F.min("_place").alias("_first"))
    return (
        placed.join(first, "league")
        .withColumn("league_rank", F.col("_place") - F.col("_first") + F.lit(1))
        .drop("_place", "_first")
    )


def league_averages(registered: DataFrame, fill_missing: bool = True) -> DataFrame:
    """Rounded mean rating per country in report order; absent countries are 0 or left out."""
    means = registered.where("registered").groupBy("country").agg(F.avg("rating").alias("mean"))
    spark = registered.sparkSession
    order = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in fv.LEAGUE_COUNTRY.values()]))
                                  .alias("p", "country"))
    out = order.join(means, "country", "left" if fill_missing else "inner")
    return out.select(
        F.col("p").cast("long").alias("position"), "country",
        F.coalesce(parse.half_up(F.col("mean")), F.lit(0)).alias("average"))


def headline(states: DataFrame, matches: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: teams, matches, leagues, seasons and the top team."""
    best = states.orderBy(*rating_order()).limit(1).select(
        F.col("team").alias("top_team"), parse.half_up(F.col("rating")).alias("top_rating"))
    teams = states.agg(F.count(F.lit(1)).alias("teams_rated"))
    played = matches.agg(
        F.count(F.lit(1)).alias("matches_processed"), F.countDistinct("season").alias("seasons"),
        F.concat_ws("-", F.substring(F.min("season"), 1, 4), F.substring(F.max("season"), 6, 4)).alias("years"),
    )
    leagues = registry.agg(F.countDistinct("league").alias("leagues"))
    return side_by_side(teams, played, leagues, best)

