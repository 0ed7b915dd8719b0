"""The rating formula, the fold and what hangs off its events."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import rating
from ladderline.operators import continued, fold, merge, profiles
from ladderline.session import new_path, written
from ladderline.operators.rankings import ranked
from ladderline.sinks import documents as doc_sink
from ladderline.sources import documents
from workload import fixture
from workload import oracle_core as o
from workload.registry import register

CONFIG = RatingConfig()
AS_OF = datetime.date(2001, 5, 31)
COMPUTED_AT = "2001-08-02T00:00:00Z"
DIGITS = 4

FOLD = [o.MATCHES, o.CONFIG, o.fold()]


def match_table(spark, sf_dir):
    """The matches, written once: the fold and its followers read them several times."""
    return written(fixture.matches(spark, sf_dir), "matches")


def r4(c):
    return F.round(c, DIGITS)


def nullable(*names):
    """Whole numbers that may be NULL are compared as doubles."""
    return [F.col(c).cast("double").alias(c) for c in names]


def final(spark, sf_dir):
    return fold.final_states(fold.rating_fold(match_table(spark, sf_dir), CONFIG, with_events=False))


def events(spark, sf_dir):
    return fold.rating_events(fold.rating_fold(match_table(spark, sf_dir), CONFIG))


def both(spark, sf_dir):
    """Match table, final records and events of one fold, which is written once."""
    m = match_table(spark, sf_dir)
    done = written(fold.rating_fold(m, CONFIG), "fold")
    return m, fold.final_states(done), fold.rating_events(done)


PAIRS = """
pairs AS (
  SELECT *, 1400.0::DOUBLE + id % 301 AS home_rating, 1400.0::DOUBLE + (id * 7) % 401 AS away_rating FROM matches),
steps AS (
  SELECT p.*, 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, (away_rating - home_rating - 65.0::DOUBLE) / 400.0::DOUBLE)) AS e,
    1.0::DOUBLE + ln(abs(hg - ag) + 1) AS g, 24.0::DOUBLE * coalesce(c.strength, 1.0::DOUBLE) AS k,
    CASE WHEN hg > ag THEN 1.0 WHEN hg < ag THEN 0.0 ELSE 0.5 END::DOUBLE AS s
  FROM pairs p LEFT JOIN cfg c ON c.league = p.league)
"""
FORMULA = [o.MATCHES, o.CONFIG, PAIRS]


def pairs(spark, sf_dir):
    """Matches with made-up ratings on both sides, for the single-match formula."""
    return fixture.matches(spark, sf_dir).withColumns({
        "home_rating": F.lit(1400.0) + F.col("id") % 301, "away_rating": F.lit(1400.0) + (F.col("id") * 7) % 401})


@register("elo_expected", o.query(FORMULA, "SELECT id, round(e, 9) AS home_expected, round(1 - e, 9) AS away_expected FROM steps"))
def elo_expected(spark, sf_dir):
    e = rating.expected_home("home_rating", "away_rating", CONFIG)
    return pairs(spark, sf_dir).select(
        "id", F.round(e, 9).alias("home_expected"), F.round(F.lit(1.0) - e, 9).alias("away_expected"))


@register("elo_margin", o.query(FORMULA, "SELECT id, round(g, 9) AS margin, 1.0::DOUBLE AS margin_off FROM steps"))
def elo_margin(spark, sf_dir):
    off = RatingConfig(goal_margin=False)
    return fixture.matches(spark, sf_dir).select(
        "id", F.round(rating.margin_multiplier("hg", "ag", CONFIG), 9).alias("margin"),
        rating.margin_multiplier("hg", "ag", off).alias("margin_off"))


@register("elo_k", o.query(FORMULA, """
SELECT id, round(k, 9) AS k, CASE WHEN id % 9 = 0 THEN 24.0::DOUBLE ELSE round(k, 9) END AS k_some_unknown FROM steps"""))
def elo_k(spark, sf_dir):
    m = fixture.matches(spark, sf_dir).withColumn("other", F.when(F.col("id") % 9 != 0, F.col("league")))
    return m.select("id", F.round(rating.effective_k("league", CONFIG), 9).alias("k"),
                    F.round(rating.effective_k("other", CONFIG), 9).alias("k_some_unknown"))


@register("elo_update", o.query(FORMULA, """
SELECT id, round(home_rating + k * g * (s - e), 6) AS home_new,
  round(away_rating + k * g * ((1.0::DOUBLE - s) - (1.0::DOUBLE - e)), 6) AS away_new FROM steps"""))
def elo_update(spark, sf_dir):
    return rating.update_columns(pairs(spark, sf_dir), CONFIG).select(
        "id", F.round("home_new", 6).alias("home_new"), F.round("away_new", 6).alias("away_new"))


@register("elo_regress", o.query(FORMULA, """
SELECT id, round(home_rating + 0.15::DOUBLE * (c.baseline - home_rating), 6) AS toward_league,
  round(home_rating + 0.1::DOUBLE * (1500.0::DOUBLE - home_rating), 6) AS toward_default
FROM pairs p JOIN cfg c ON c.league = p.league"""))
def elo_regress(spark, sf_dir):
    toward = rating.regress("home_rating", rating.baseline("league", CONFIG), CONFIG.season_regression)
    return pairs(spark, sf_dir).select(
        "id", F.round(toward, 6).alias("toward_league"),
        F.round(rating.regress("home_rating", F.lit(CONFIG.initial_rating)), 6).alias("toward_default"))


@register("start_rating", o.query([o.MATCHES, o.CONFIG, o.SIDES], """
SELECT team, s.league, c.baseline AS start_rating
FROM (SELECT team, arg_min(league, (ts, src_rank, ord, side)) AS league FROM sides GROUP BY team) s
JOIN cfg c ON c.league = s.league"""))
def start_rating(spark, sf_dir):
    return profiles.start_ratings(merge.registry(fixture.matches(spark, sf_dir)), CONFIG)


@register("rating_fold", o.query(FOLD, f"""
SELECT team, seq, event, date, match_id::DOUBLE AS match_id, side::DOUBLE AS side, round(rating_before, {DIGITS}) AS rating_before,
  round(rating_after, {DIGITS}) AS rating_after FROM events"""))
def rating_fold(spark, sf_dir):
    return events(spark, sf_dir).select(
        "team", "seq", "event", "date", *nullable("match_id", "side"),
        r4("rating_before").alias("rating_before"), r4("rating_after").alias("rating_after"))


@register("final_ratings", o.query(FOLD, f"""
SELECT team, round(rating, {DIGITS}) AS rating, matches, wins, draws, losses, last_updated || 'T00:00:00Z' AS last_updated
FROM state"""))
def final_ratings(spark, sf_dir):
    return final(spark, sf_dir).select(
        "team", r4("rating").alias("rating"), "matches", "wins", "draws", "losses", "last_updated")


@register("flat_replay_delta", o.query([o.MATCHES, o.CONFIG, o.fold(flat=True)], f"""
SELECT match_id, side, round(rating_after - rating_before, {DIGITS}) AS delta FROM events"""))
def flat_replay_delta(spark, sf_dir):
    deltas = profiles.flat_deltas(match_table(spark, sf_dir), CONFIG)
    return deltas.select("match_id", "side", r4("delta").alias("delta"))


@register("fold_sliced", o.query(FOLD, f"""
SELECT team, seq, event, date, match_id::DOUBLE AS match_id, side::DOUBLE AS side,
  round(rating_after, {DIGITS}) AS rating_after FROM events"""))
def fold_sliced(spark, sf_dir):
    """The fold with pools above the row limit, which are cut into four slices each."""
    m = match_table(spark, sf_dir)
    limit = max(1, m.count() // 20)
    done = fold.rating_fold(m, CONFIG, max_group_rows=limit, wide=False)
    return fold.rating_events(done).select(
        "team", "seq", "event", "date", *nullable("match_id", "side"), r4("rating_after").alias("rating_after"))


@register("fold_continued", o.query(FOLD, f"""
SELECT team, round(rating, {DIGITS}) AS rating, matches, wins, draws, losses, last_updated || 'T00:00:00Z' AS last_updated
FROM state"""))
def fold_continued(spark, sf_dir):
    """Three runs, each going on from the folder the one before has written."""
    m = match_table(spark, sf_dir)
    year = F.year("ts")
    first, last = m.agg(F.min(year), F.max(year)).first()
    cuts = [(first or 0) + ((last or 0) - (first or 0)) * i // 3 for i in (1, 2)]
    paths = []
    for part in (m.where(year < cuts[0]), m.where((year >= cuts[0]) & (year < cuts[1])), m.where(year >= cuts[1])):
        path = new_path(spark, "fold-run")
        continued.fold_on(part, path, paths[-1] if paths else None, CONFIG)
        paths.append(path)
    return fold.final_states(continued.final_fold(spark, paths, CONFIG)).select(
        "team", r4("rating").alias("rating"), "matches", "wins", "draws", "losses", "last_updated")


PLAYERS = """
cust AS (SELECT count(*) AS n FROM customer),
players AS (
  SELECT m.* REPLACE ('c' || CAST(o_custkey AS VARCHAR) AS home,
    'c' || CAST((o_custkey + 1 + (id * 7919) % (n - 1)) % n AS VARCHAR) AS away, 'PL' AS league)
  FROM matches m JOIN orders ON o_orderkey = id CROSS JOIN cust)
"""


@register("flat_replay_wide", o.query([o.MATCHES, o.CONFIG, PLAYERS, o.fold("", "players", flat=True)], f"""
SELECT match_id, side, team, seq, round(rating_before, {DIGITS}) AS rating_before,
  round(rating_after, {DIGITS}) AS rating_after FROM events"""))
def flat_replay_wide(spark, sf_dir):
    """The flat replay with customers as teams: one pool of many teams, folded in cluster-wide rounds."""
    m = written(fixture.player_matches(spark, sf_dir), "players")
    done = fold.rating_fold(m, CONFIG.flat(), max_group_rows=1000, wide=True)
    return fold.rating_events(done).select(
        "match_id", "side", "team", "seq", r4("rating_before").alias("rating_before"),
        r4("rating_after").alias("rating_after"))


@register("rating_checks", o.query(FOLD + [o.SIDES, """
both_sides AS (SELECT ts, src_rank, ord, sum(rating_after - rating_before) AS d, count(*) AS n FROM events
  WHERE event = 'match' GROUP BY ALL),
recs AS (SELECT team, count(*) AS m, count(*) FILTER (WHERE goals > opp_goals) AS w,
  count(*) FILTER (WHERE goals < opp_goals) AS l FROM sides GROUP BY team),
cmp AS (SELECT * FROM state FULL JOIN recs USING (team))
"""], """
SELECT 'zero_sum' AS "check", count(*) AS violations FROM both_sides WHERE abs(d) > 1e-9
UNION ALL SELECT 'two_sides', count(*) FROM both_sides WHERE n <> 2
UNION ALL SELECT 'matches', count(*) FROM cmp WHERE matches IS DISTINCT FROM m
UNION ALL SELECT 'wins', count(*) FROM cmp WHERE wins IS DISTINCT FROM w
UNION ALL SELECT 'losses', count(*) FROM cmp WHERE losses IS DISTINCT FROM l
UNION ALL SELECT 'wins_equal_losses', abs(sum(wins) - sum(losses))::BIGINT FROM cmp
UNION ALL SELECT 'finite_rating', count(*) FROM cmp WHERE rating IS NULL OR isnan(rating)"""))
def rating_checks(spark, sf_dir):
    return profiles.checks(*both(spark, sf_dir))


DAILY = """
daily AS (SELECT team, date, arg_max(rating_after, seq) AS rating FROM events GROUP BY team, date)
"""


@register("daily_snapshot", o.query(FOLD + [DAILY], f"SELECT team, date, round(rating, {DIGITS}) AS rating FROM daily"))
def daily_snapshot(spark, sf_dir):
    return profiles.daily_snapshot(events(spark, sf_dir)).select("team", "date", r4("rating").alias("rating"))


@register("rating_history", o.query(FOLD, """
SELECT team, (seq - 1) // 100 AS page, count(*) AS entries,
  string_agg(date || '=' || CAST(CAST(floor(rating_after * 100 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY seq) AS history
FROM events GROUP BY ALL"""))
def rating_history(spark, sf_dir):
    """Pages of 100 entries; ratings in hundredths."""
    pages = profiles.rating_history(events(spark, sf_dir), page=100)
    text = F.array_join(F.transform("history", lambda e: F.concat_ws(
        "=", e["date"], F.floor(e["rating"] * 100 + 0.5).cast("long").cast("string"))), " ")
    return pages.select("team", "page", F.size("history").cast("long").alias("entries"), text.alias("history"))


@register("peak_low", o.query(FOLD, f"""
SELECT team, round(max(rating_after), {DIGITS}) AS peak_rating, arg_max(date, (rating_after, -seq)) AS peak_date,
  round(min(rating_after), {DIGITS}) AS lowest_rating, arg_min(date, (rating_after, seq)) AS lowest_date
FROM events GROUP BY team"""))
def peak_low(spark, sf_dir):
    _, states, changes = both(spark, sf_dir)
    found = profiles.peak_low(states, changes)
    return found.withColumns({c: r4(c) for c in ("peak_rating", "lowest_rating")})


RANGES = DAILY + """,
ranges AS (SELECT * FROM (VALUES ('3M', '2001-03-03'), ('6M', '2000-12-01'), ('1Y', '2000-05-31'), ('All', ''))
  t("range", start))
"""


@register("history_range", o.query(FOLD + [RANGES], f"""
SELECT "range", team, date, round(rating, {DIGITS}) AS rating FROM daily JOIN ranges ON date >= start"""))
def history_range(spark, sf_dir):
    """31 May minus 3 and 6 months: February and November lack the day, so the start moves on."""
    daily = profiles.daily_snapshot(events(spark, sf_dir))
    return profiles.history_range(daily, AS_OF).withColumn("rating", r4("rating"))


@register("chart_bounds", o.query(FOLD + [RANGES], """
SELECT team, "range", (floor(min(rating) FILTER (WHERE date >= start) / 10) * 10 - 20)::DOUBLE AS axis_min,
  (ceil(max(rating) FILTER (WHERE date >= start) / 10) * 10 + 20)::DOUBLE AS axis_max
FROM daily CROSS JOIN ranges GROUP BY ALL"""))
def chart_bounds(spark, sf_dir):
    bounds = profiles.chart_bounds(profiles.daily_snapshot(events(spark, sf_dir)), AS_OF)
    return bounds.select("team", "range", *nullable("axis_min", "axis_max"))


@register("recent_form", o.query([o.MATCHES, o.CONFIG, o.fold(flat=True), o.SIDES], f"""
SELECT team, (CAST(n AS BIGINT) - back + 1) AS place, day AS date, opponent, home_away,
  CAST(goals AS VARCHAR) || '-' || CAST(opp_goals AS VARCHAR) AS score,
  CASE WHEN goals > opp_goals THEN 'W' WHEN goals < opp_goals THEN 'L' ELSE 'D' END AS result,
  round(rating_after - rating_before, {DIGITS}) AS rating_change
FROM (SELECT s.*, row_number() OVER (PARTITION BY team ORDER BY ts DESC, src_rank DESC, ord DESC) AS back,
        least(count(*) OVER (PARTITION BY team), 10) AS n FROM sides s) s
JOIN (SELECT match_id, side, team, rating_after, rating_before FROM events) e
  ON e.match_id = s.id AND e.side = s.side WHERE back <= 10"""
    .replace("SELECT team, (CAST", "SELECT s.team, (CAST")))
def recent_form(spark, sf_dir):
    form = profiles.recent_form(match_table(spark, sf_dir), CONFIG)
    return form.withColumn("rating_change", r4("rating_change"))


@register("src_ratings_doc", o.query(FOLD, f"""
SELECT rank, team, round(rating, {DIGITS}) AS rating, matches, wins, draws, losses,
  last_updated || 'T00:00:00Z' AS last_updated, (SELECT count(*) FROM matches) AS matches_processed,
  '{COMPUTED_AT}' AS computed_at FROM ranked"""))
def src_ratings_doc(spark, sf_dir):
    path = _write_ratings(spark, sf_dir, part_teams=40)
    teams = documents.read_ratings(spark, path, run=True).withColumn("rating", r4("rating"))
    return teams.withColumnsRenamed({"matchesProcessed": "matches_processed", "computedAt": "computed_at"})


@register("sink_ratings", o.query(FOLD, f"""
SELECT team, seq, date, round(rating_after, {DIGITS}) AS rating FROM events"""))
def sink_ratings(spark, sf_dir):
    """Histories read back from documents of 40 teams and 100 entries each."""
    path = _write_ratings(spark, sf_dir, part_teams=40, part_entries=100)
    return documents.read_history(spark, path).withColumn("rating", r4("rating"))


def _write_ratings(spark, sf_dir, **sizes):
    m, states, changes = both(spark, sf_dir)
    path = new_path(spark, "ratings")
    doc_sink.write_ratings(ranked(states), changes, m.count(), COMPUTED_AT, CONFIG, path, **sizes)
    return path


def _write_daily(spark, sf_dir, **sizes):
    _, states, changes = both(spark, sf_dir)
    path = new_path(spark, "daily")
    doc_sink.write_daily(ranked(states), profiles.daily_snapshot(changes), path, **sizes)
    return path


@register("src_daily_doc", o.query(FOLD + [DAILY], f"SELECT team, date, round(rating, {DIGITS}) AS rating FROM daily"))
def src_daily_doc(spark, sf_dir):
    return documents.read_daily(spark, _write_daily(spark, sf_dir, part_teams=40, part_entries=365)).withColumn("rating", r4("rating"))


@register("sink_daily", o.query(FOLD + [DAILY], """
SELECT team, count(*) AS days, min(date) AS first_day, max(date) AS last_day FROM daily GROUP BY team"""))
def sink_daily(spark, sf_dir):
    """Documents of 40 teams and stretches of 11 months, summed up after reading back."""
    path = _write_daily(spark, sf_dir, part_teams=40, part_entries=365)
    return documents.read_daily(spark, path).groupBy("team").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
