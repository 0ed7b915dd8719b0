"""Per-team figures derived from matches and rating events."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import parse, rating
from ladderline.operators.extremes import rows_at
from ladderline.operators.fold import rating_events, rating_fold
from ladderline.operators.perspective import team_matches
from ladderline.schema import MATCH_ORDER
from ladderline.session import written

FORM_LENGTH = 10
HISTORY_PAGE = 5_000
RANGES = {"3M": 3, "6M": 6, "1Y": 12, "All": 0}


def team_record(matches: DataFrame) -> DataFrame:
    """Wins, draws, losses and the date of the last match, without ratings."""
    seen = team_matches(matches)
    figures = ["matches", "wins", "draws", "losses"]
    counted = seen.groupBy("team").agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_if(F.col("result") == "W").alias("wins"),
        F.count_if(F.col("result") == "D").alias("draws"),
        F.count_if(F.col("result") == "L").alias("losses"),
        F.max("ts").alias("last_ts"))
    last = rows_at(seen.select("team", *MATCH_ORDER, "date"), counted, "team", F.col("ts") == F.col("last_ts"), "team-record")
    return last.groupBy("team", *figures).agg(F.max_by("date", F.struct("src_rank", "ord")).alias("last_updated")).select(
        "team", *figures, "last_updated")


def win_rate(records: DataFrame) -> DataFrame:
    share = F.when(F.col("matches") > 0, F.lit(100.0) * F.col("wins") / F.col("matches")).otherwise(0.0)
    return records.select("team", "matches", share.alias("win_rate"))


def start_ratings(registry: DataFrame, config: RatingConfig = RatingConfig()) -> DataFrame:
    """The rating each team starts from: its first league's baseline."""
    return registry.select("team", "league", rating.baseline("league", config).alias("start_rating"))


def peak_low(states: DataFrame, events: DataFrame) -> DataFrame:
    """Highest and lowest rating with their days; the first occurrence counts."""
    after = F.col("rating_after")
    bounds = events.groupBy("team").agg(F.max(after).alias("hi"), F.min(after).alias("lo"))
    high, low = after == F.col("hi"), after == F.col("lo")
    reached = rows_at(events.select("team", "seq", "date", "rating_after"), bounds, "team", high | low, "peak-low")
    extremes = reached.groupBy("team", "hi", "lo").agg(
        F.min_by("date", F.when(high, F.col("seq"))).alias("hi_day"), F.min_by("date", F.when(low, F.col("seq"))).alias("lo_day"))
    blank = F.lit("")
    return states.join(extremes, "team", "left").select(
        "team",
        F.coalesce("hi", "rating").alias("peak_rating"), F.coalesce("hi_day", blank).alias("peak_date"),
        F.coalesce("lo", "rating").alias("lowest_rating"), F.coalesce("lo_day", blank).alias("lowest_date"))


def daily_snapshot(events: DataFrame) -> DataFrame:
    """The last rating of each team and day."""
    return events.groupBy("team", "date").agg(F.max_by("rating_after", "seq").alias("rating"))


def rating_history(events: DataFrame, page: int = HISTORY_PAGE) -> DataFrame:
    """Event lists per team in order, in pages of at most `page` entries.

    A team's whole history has no size bound, so it is never gathered into one value.
    """
    entry = F.struct("seq", "date", F.col("rating_after").alias("rating"))
    return (
        events.withColumn("page", F.floor((F.col("seq") - 1) / F.lit(page)).cast("long"))
        .groupBy("team", "page").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select("team", "page", F.transform(
            "entries", lambda e: F.struct(e["date"].alias("date"), e["rating"].alias("rating"))).alias("history"))
    )


def range_start(as_of: datetime.date, months: int) -> Column:
    """The day `months` before `as_of`; a day the target month lacks overflows into the next one."""
    day = F.lit(as_of)
    return F.date_format(
        F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.lit(as_of.day - 1)), "yyyy-MM-dd")


def _ranges(as_of: datetime.date) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("range"),
                 (range_start(as_of, months) if months else F.lit("")).alias("start"))
        for name, months in RANGES.items()])


def history_range(daily: DataFrame, as_of: datetime.date) -> DataFrame:
    """Daily ratings of each trailing range, all ranges in one pass."""
    kept = F.filter(_ranges(as_of), lambda r: F.col("date") >= r["start"])
    return daily.select("team", "date", "rating", F.explode(kept).alias("r")).select(
        "r.range", "team", "date", "rating")


def chart_bounds(daily: DataFrame, as_of: datetime.date) -> DataFrame:
    """Axis bounds per team and range; NULL when the range holds no rating."""
    shown = F.when(F.col("date") >= F.col("r.start"), F.col("rating"))
    return (
        daily.select("team", "date", "rating", F.explode(_ranges(as_of)).alias("r"))
        .groupBy("team", F.col("r.range").alias("range"))
        .agg(F.min(shown).alias("lo"), F.max(shown).alias("hi"))
        .select("team", "range",
                (F.floor(F.col("lo") / 10) * 10 - 20).cast("long").alias("axis_min"),
                (F.ceil(F.col("hi") / 10) * 10 + 20).cast("long").alias("axis_max"))
    )


def flat_deltas(matches: DataFrame, config: RatingConfig = RatingConfig()) -> DataFrame:
    """Rating change per match side in the flat replay; of matches sharing an id the last one counts."""
    return _last_per_id(rating_events(rating_fold(matches, config.flat())))


def _last_per_id(events: DataFrame) -> DataFrame:
    delta = F.col("rating_after") - F.col("rating_before")
    return (
        events.groupBy("match_id", "side")
        .agg(F.max_by(delta, F.struct(*MATCH_ORDER)).alias("delta"))
    )


def last_matches(matches: DataFrame, length: int = FORM_LENGTH) -> DataFrame:
    """Each team's last `length` matches; `back` is 1 for the newest. A match against itself counts once."""
    seen = team_matches(matches).where(~((F.col("side") == 1) & (F.col("team") == F.col("opponent"))))
    newest_first = W.partitionBy("team").orderBy(*[F.desc(c) for c in MATCH_ORDER])
    # the rank limit is applied before the shuffle too, so a team sends at most `length` rows per task
    return seen.withColumn("back", F.row_number().over(newest_first)).where(F.col("back") <= length)


def recent_form(matches: DataFrame, config: RatingConfig = RatingConfig(), length: int = FORM_LENGTH) -> DataFrame:
    """Each team's last matches with the flat replay's rating change; place 1 is the oldest shown."""
    last = written(last_matches(matches, length), "recent-form")
    events = rating_events(rating_fold(matches, config.flat()))
    needed = last.select(F.col("id").alias("match_id")).distinct()
    deltas = _last_per_id(events.join(needed, "match_id", "left_semi"))
    shown = W.partitionBy("team").orderBy(F.desc("back"))  # at most `length` rows each
    return (
        last.join(deltas.withColumnRenamed("match_id", "id"), ["id", "side"], "left")
        .withColumn("place", F.row_number().over(shown).cast("long"))
        .select("team", "place", F.col("day").alias("date"), "opponent", "home_away", "score", "result",
                F.coalesce("delta", F.lit(0.0)).alias("rating_change"))
    )


def checks(matches: DataFrame, states: DataFrame, events: DataFrame) -> DataFrame:
    """Invariants of the fold: one row per check with the number of violations."""
    played = events.where(F.col("event") == "match")
    moved = F.sum(F.col("rating_after") - F.col("rating_before"))
    zero_sum = played.groupBy(*MATCH_ORDER).agg(moved.alias("d"), F.count(F.lit(1)).alias("n")).agg(
        F.count_if(F.abs("d") > 1e-9).alias("zero_sum"), F.count_if(F.col("n") != 2).alias("two_sides"))
    records = team_record(matches).select("team", F.col("matches").alias("m"), F.col("wins").alias("w"),
                                          F.col("losses").alias("l"))
    team_checks = states.join(records, "team", "full").agg(
        F.count_if(~F.col("matches").eqNullSafe(F.col("m"))).alias("matches"),
        F.count_if(~F.col("wins").eqNullSafe(F.col("w"))).alias("wins"),
        F.count_if(~F.col("losses").eqNullSafe(F.col("l"))).alias("losses"),
        F.abs(F.sum("wins") - F.sum("losses")).alias("wins_equal_losses"),
        F.count_if(F.isnan("rating") | F.col("rating").isNull()).alias("finite_rating"))

    def long(df):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in df.columns
        ])).alias("x")).select("x.*")

    return long(zero_sum).unionByName(long(team_checks))
