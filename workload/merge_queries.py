"""Merging, counting, per-side rows and breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import labels
from ladderline.functions.rating import actual_home
from ladderline.operators import breaks, merge, perspective, profiles, summary
from ladderline.operators.ordinal import with_ordinal
from ladderline.schema import MATCHES
from ladderline.session import new_path
from ladderline.sinks import documents as doc_sink
from ladderline.sinks.tables import write_match_json, write_matches
from ladderline.sources import documents, tables
from workload import fixture
from workload import oracle_core as o
from workload.registry import register

TWO_SOURCES = """
hist AS (SELECT * REPLACE (2 * id + 1 AS id) FROM matches),
api AS (SELECT * REPLACE (2 * id AS id) FROM matches WHERE season_year >= 1999 AND id % 10 <> 0),
kept AS (SELECT * FROM hist h WHERE NOT EXISTS (
  SELECT 1 FROM api a WHERE a.day = h.day AND a.home = h.home AND a.away = h.away)),
merged AS (SELECT * REPLACE (0 AS src_rank) FROM kept UNION ALL SELECT * REPLACE (1 AS src_rank) FROM api)
"""
MERGED = [o.MATCHES, TWO_SOURCES]


def sources(spark, sf_dir):
    m = fixture.matches(spark, sf_dir)
    historical = m.withColumn("id", F.col("id") * 2 + 1)
    recent = (F.substring("season", 1, 4).cast("int") >= 1999) & (F.col("id") % 10 != 0)
    return historical, m.where(recent).withColumn("id", F.col("id") * 2)


@register("dedup_anti", o.query(MERGED, "SELECT id, day, home, away FROM kept"))
def dedup_anti(spark, sf_dir):
    return merge.uncovered(*sources(spark, sf_dir)).select(
        "id", F.substring("date", 1, 10).alias("day"), "home", "away")


@register("merge_matches", o.query(MERGED, """
SELECT id, date, league, season, home, away, hg, ag, src_rank::BIGINT AS src_rank FROM merged"""))
def merge_matches(spark, sf_dir):
    return merge.merged(*sources(spark, sf_dir)).select(
        "id", "date", "league", "season", "home", "away", F.col("hg").cast("long").alias("hg"),
        F.col("ag").cast("long").alias("ag"), F.col("src_rank").cast("long").alias("src_rank"))


@register("chrono_sort", o.query(MERGED, """
SELECT row_number() OVER (ORDER BY ts, src_rank, ord) AS position, id FROM merged"""))
def chrono_sort(spark, sf_dir):
    return merge.numbered(merge.merged(*sources(spark, sf_dir)), "position").select("position", "id")


@register("dedup_stats", o.query(MERGED, """
SELECT 'historical' AS source, (SELECT count(*) FROM hist) AS rows, (SELECT count(*) FROM kept) AS kept,
  (SELECT count(*) FROM hist) - (SELECT count(*) FROM kept) AS removed
UNION ALL SELECT 'api', count(*), count(*), 0 FROM api"""))
def dedup_stats(spark, sf_dir):
    return merge.dedup_stats(*sources(spark, sf_dir))


REGISTRY_ROWS = """
reg AS (SELECT team, arg_min(s.league, (ts, src_rank, ord, side)) AS first_league, count(*) AS matches_played,
  min((ts, src_rank, ord, side)) AS first_seen FROM sides s GROUP BY team)
"""
REG = [o.MATCHES, o.SIDES, o.COUNTRY, REGISTRY_ROWS]
REGISTRY = """SELECT team, r.first_league AS league, c.country, matches_played
FROM reg r JOIN country c ON c.league = r.first_league"""


@register("registry", o.query(REG, REGISTRY))
def registry(spark, sf_dir):
    return merge.registry(fixture.matches(spark, sf_dir)).drop("first_seen")


@register("src_registry", o.query(REG, REGISTRY))
def src_registry(spark, sf_dir):
    path = new_path(spark, "registry")
    doc_sink.write_registry(merge.registry(fixture.matches(spark, sf_dir)), path, part_teams=40)
    return documents.read_registry(spark, path)


@register("sink_registry", o.query(REG, """
SELECT team, (row_number() OVER (ORDER BY first_seen) - 1) // 40 AS part,
  (row_number() OVER (ORDER BY first_seen) - 1) % 40 AS position FROM reg"""))
def sink_registry(spark, sf_dir):
    """The keys of the written documents in their order, 40 teams to a document."""
    path = new_path(spark, "registry")
    placed = merge.registry(fixture.matches(spark, sf_dir))
    doc_sink.write_registry(placed, path, part_teams=40)
    keys = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(F.json_object_keys("value")).alias("position", "team"))
    # a file is a document; documents are told apart by their first team's place among all first teams
    heads = with_ordinal(keys.where("position = 0").join(placed.select("team", "first_seen"), "team"), ["first_seen"], "n")
    part = heads.select("file", (F.col("n") - 1).alias("part"))
    return keys.join(part, "file").select("team", "part", F.col("position").cast("long").alias("position"))


@register("sink_matches", o.query([o.MATCHES], """
SELECT id, epoch_ms(ts)::BIGINT AS ms, date, league, season, home, away, hg, ag FROM matches"""))
def sink_matches(spark, sf_dir):
    path = new_path(spark, "matches")
    write_matches(fixture.matches(spark, sf_dir), path)
    return tables.read_matches(spark, path).select(
        "id", F.unix_millis("ts").alias("ms"), "date", "league", "season", "home", "away",
        F.col("hg").cast("long").alias("hg"), F.col("ag").cast("long").alias("ag"))


@register("sink_match_json", o.query([o.MATCHES], """
SELECT id, date, league, home, away, row_number() OVER (ORDER BY ts, src_rank, ord) AS place FROM matches"""))
def sink_match_json(spark, sf_dir):
    """The exported list read back: a match's place in it is its place in match order."""
    path = new_path(spark, "match-export")
    write_match_json(fixture.matches(spark, sf_dir), path)
    back = tables.read_match_json(spark, path, multi_line=False)
    return with_ordinal(back, ["ord"], "place").select("id", "date", "league", "home", "away", "place")


@register("src_optional", o.query([o.MATCHES], """
SELECT league, count(*) AS matches, 0::BIGINT AS registered FROM matches GROUP BY league"""))
def src_optional(spark, sf_dir):
    """Inputs that aren't there give empty tables: no registry and no second source beside the matches."""
    gone = new_path(spark, "absent")
    absent = tables.optional(spark, gone, tables.read_matches, MATCHES)
    m = merge.merged(fixture.matches(spark, sf_dir), absent)
    known = documents.read_registry(spark, gone).groupBy("league").agg(F.count(F.lit(1)).alias("registered"))
    return m.groupBy("league").agg(F.count(F.lit(1)).alias("matches")).join(known, "league", "left").select(
        "league", "matches", F.coalesce("registered", F.lit(0)).alias("registered"))


@register("cnt_league_season", o.query([o.MATCHES], "SELECT league, season, count(*) AS n FROM matches GROUP BY ALL"))
def cnt_league_season(spark, sf_dir):
    return summary.league_season_counts(fixture.matches(spark, sf_dir))


@register("league_totals", o.query([o.MATCHES, o.COUNTRY], """
SELECT p::BIGINT AS league_pos, l AS league, coalesce(sum(n), 0)::BIGINT AS total,
  coalesce(string_agg(substr(season, 1, 4) || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY season), '') AS parts
FROM (VALUES (0, 'PL'), (1, 'PD'), (2, 'BL1'), (3, 'SA'), (4, 'FL1')) k(p, l)
LEFT JOIN (SELECT league, season, count(*) AS n FROM matches GROUP BY ALL) c ON c.league = l
GROUP BY ALL"""))
def league_totals(spark, sf_dir):
    return summary.league_totals(fixture.matches(spark, sf_dir))


@register("date_range", o.query([o.MATCHES], """
SELECT min(day) AS first_day, max(day) AS last_day, substr(min(day), 1, 4) || '-' || substr(max(day), 1, 4) AS years
FROM matches"""))
def date_range(spark, sf_dir):
    return summary.date_range(fixture.matches(spark, sf_dir))


@register("distinct_teams", o.query([o.MATCHES, o.SIDES], "SELECT count(DISTINCT team) AS teams FROM sides"))
def distinct_teams(spark, sf_dir):
    return summary.distinct_teams(fixture.matches(spark, sf_dir))


@register("outcome", o.query([o.MATCHES], """
SELECT id, CASE WHEN hg > ag THEN 'W' WHEN hg < ag THEN 'L' ELSE 'D' END AS home_result,
  CASE WHEN ag > hg THEN 'W' WHEN ag < hg THEN 'L' ELSE 'D' END AS away_result,
  CASE WHEN hg > ag THEN 1.0 WHEN hg < ag THEN 0.0 ELSE 0.5 END::DOUBLE AS home_score FROM matches"""))
def outcome(spark, sf_dir):
    hg, ag = F.col("hg"), F.col("ag")
    return fixture.matches(spark, sf_dir).select(
        "id", labels.result(hg, ag).alias("home_result"), labels.result(ag, hg).alias("away_result"),
        actual_home(hg, ag).alias("home_score"))


@register("team_match_long", o.query([o.MATCHES, o.SIDES], """
SELECT id, team, opponent, home_away, day AS date, CAST(goals AS VARCHAR) || '-' || CAST(opp_goals AS VARCHAR) AS score,
  CASE WHEN goals > opp_goals THEN 'W' WHEN goals < opp_goals THEN 'L' ELSE 'D' END AS result FROM sides"""))
def team_match_long(spark, sf_dir):
    return perspective.team_matches(fixture.matches(spark, sf_dir)).select(
        "id", "team", "opponent", "home_away", F.col("day").alias("date"), "score", "result")


@register("team_record", o.query([o.MATCHES, o.SIDES], """
SELECT team, count(*) AS matches, count(*) FILTER (WHERE goals > opp_goals) AS wins,
  count(*) FILTER (WHERE goals = opp_goals) AS draws, count(*) FILTER (WHERE goals < opp_goals) AS losses,
  arg_max(date, (ts, src_rank, ord)) AS last_updated FROM sides GROUP BY team"""))
def team_record(spark, sf_dir):
    return profiles.team_record(fixture.matches(spark, sf_dir))


@register("win_rate", o.query([o.MATCHES, o.SIDES], """
SELECT team, count(*) AS matches, round(100.0 * count(*) FILTER (WHERE goals > opp_goals) / count(*), 6) AS win_rate
FROM sides GROUP BY team"""))
def win_rate(spark, sf_dir):
    rates = profiles.win_rate(profiles.team_record(fixture.matches(spark, sf_dir)))
    return rates.withColumn("win_rate", F.round("win_rate", 6))


@register("season_breaks", o.query([o.MATCHES, o.SIDES, o.BREAKS], """
SELECT break_no::BIGINT AS break_no, strftime(prev_ts, '%Y-%m-%d') AS prev_date, strftime(i.ts, '%Y-%m-%d') AS date,
  floor((epoch_ms(i.ts) - epoch_ms(prev_ts)) / 86400000.0 + 0.5)::BIGINT AS gap_days,
  (SELECT count(DISTINCT team) FROM sides s WHERE s.ts < i.ts) AS teams_seen
FROM instants i WHERE is_break"""))
def season_breaks(spark, sf_dir):
    return breaks.season_breaks(fixture.matches(spark, sf_dir), RatingConfig())


@register("break_no", o.query([o.MATCHES, o.BREAKS], """
SELECT id, break_no::BIGINT AS break_no FROM matches JOIN instants USING (ts)"""))
def break_no(spark, sf_dir):
    numbered = breaks.with_break_no(fixture.matches(spark, sf_dir), RatingConfig())
    return numbered.select("id", F.col("break_no").cast("long").alias("break_no"))
