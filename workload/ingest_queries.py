"""Sources, parsing and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderline.functions import parse
from ladderline.operators import merge, rankings
from ladderline.sources import match_api, season_csv, tables
from ladderline.session import new_path
from workload import fixture, landing
from workload import oracle_core as o
from workload.registry import register

RAW = [o.MATCHES, landing.RAW_SQL]

DATED = """
dated AS (
  SELECT *, string_split(d, '/') AS p FROM raw),
parts AS (
  SELECT *, CASE WHEN length(p[1]) < 2 THEN '0' || p[1] ELSE p[1] END AS dd,
    CASE WHEN length(p[2]) < 2 THEN '0' || p[2] ELSE p[2] END AS mm,
    CASE WHEN length(p[3]) = 2 THEN CASE WHEN CAST(p[3] AS INTEGER) > 50 THEN '19' ELSE '20' END || p[3] ELSE p[3] END AS yy
  FROM dated),
isod AS (
  SELECT *, CASE WHEN len(p) = 3 AND CAST(dd AS INTEGER) BETWEEN 1 AND 31 AND CAST(mm AS INTEGER) BETWEEN 1 AND 12
    AND CAST(yy AS INTEGER) >= 2000 THEN yy || '-' || mm || '-' || dd || 'T15:00:00Z' END AS iso
  FROM parts)
"""

PARSED_LINES = """
judged AS (
  SELECT l.*, i.iso, TRY_CAST(nullif(regexp_extract(l.g1, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS gh,
    TRY_CAST(nullif(regexp_extract(l.g2, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS ga
  FROM landed l JOIN isod i USING (id))
"""


@register("src_csv", o.query(RAW + [landing.LINES_SQL, landing.FILES_SQL], """
SELECT competition, season_code, d AS date, h AS home, a AS away, g1 AS fthg, g2 AS ftag
FROM landed JOIN landed_files USING (competition, season_code, shard)
WHERE bytes >= 100 -- a file under 100 bytes is refused
"""))
def src_csv(spark, sf_dir):
    path = landing.write_lines(landing.season_lines(landing.raw_rows(spark, sf_dir)), "season-files")
    return season_csv.rows(spark, path).select(
        "competition", "season_code", F.col("Date").alias("date"), F.col("HomeTeam").alias("home"),
        F.col("AwayTeam").alias("away"), F.col("FTHG").alias("fthg"), F.col("FTAG").alias("ftag"))


@register("src_valid_files", o.query(RAW + [landing.LINES_SQL, landing.FILES_SQL], """
SELECT competition, season_code, sum(bytes)::BIGINT AS bytes,
  max(CASE WHEN bytes < 100 THEN 'too short' ELSE 'accepted' END) AS status
FROM landed_files GROUP BY competition, season_code
UNION ALL SELECT DISTINCT competition, '0001', 116, 'html' FROM raw
UNION ALL SELECT DISTINCT competition, '0002', 14, 'too short' FROM raw
"""))
def src_valid_files(spark, sf_dir):
    raw = landing.raw_rows(spark, sf_dir)
    path = landing.write_lines(landing.season_lines(raw).unionByName(landing.rejects(raw)), "landing")
    found = season_csv.files(season_csv.lines(spark, path))
    name = r"file=([A-Z0-9]+)_([0-9]{4})"
    return found.groupBy(
        F.regexp_extract("file", name, 1).alias("competition"),
        F.regexp_extract("file", name, 2).alias("season_code"),
    ).agg(F.sum("size").alias("bytes"), F.max(F.coalesce("reason", F.lit("accepted"))).alias("status"))


@register("src_rejects", o.query(RAW + [landing.LINES_SQL, landing.FILES_SQL, DATED, PARSED_LINES], """
SELECT competition, season_code, 'too short' AS reason, line FROM landed_files f JOIN landed l USING (competition, season_code, shard) WHERE bytes < 100
UNION ALL SELECT competition, season_code, 'too short', header FROM landed_files WHERE bytes < 100
UNION ALL SELECT competition, season_code,
  CASE WHEN d = '' OR h = '' OR a = '' OR g1 = '' OR g2 = '' THEN 'a needed column is empty'
    WHEN gh IS NULL OR ga IS NULL THEN 'unreadable score' ELSE 'unreadable date' END, line
FROM judged JOIN landed_files USING (competition, season_code, shard)
WHERE bytes >= 100 AND (d = '' OR h = '' OR a = '' OR g1 = '' OR g2 = '' OR gh IS NULL OR ga IS NULL OR iso IS NULL)
UNION ALL SELECT DISTINCT competition, '0001', 'html', '<!DOCTYPE html>' || repeat(' ', 100) FROM raw
UNION ALL SELECT DISTINCT competition, '0002', 'too short', 'Date,HomeTeam' FROM raw
"""))
def src_rejects(spark, sf_dir):
    """Every line of the landing zone that gives no match, with its reason."""
    raw = landing.raw_rows(spark, sf_dir)
    path = landing.write_lines(landing.season_lines(raw).unionByName(landing.rejects(raw)), "landing")
    name = r"file=([A-Z0-9]+)_([0-9]{4})"
    return season_csv.ledger(season_csv.lines(spark, path)).select(
        F.regexp_extract("file", name, 1).alias("competition"), F.regexp_extract("file", name, 2).alias("season_code"), "reason", "line")


API_ROWS = """
SELECT id, date, league, season, coalesce(home_name, 'Unknown') AS home, coalesce(away_name, 'Unknown') AS away,
  h AS hg, a AS ag, coalesce(md, 0) AS matchday
FROM entries WHERE h IS NOT NULL AND a IS NOT NULL
"""


@register("src_api_json", o.query([o.MATCHES, landing.API_SQL], API_ROWS))
def src_api_json(spark, sf_dir):
    path = landing.write_api(landing.api_entries(spark, sf_dir))
    return _wide(match_api.read(spark, path, multi_line=False))


@register("api_project", o.query([o.MATCHES, landing.API_SQL], API_ROWS))
def api_project(spark, sf_dir):
    entries = landing.api_entries(spark, sf_dir).select(
        "*", F.lit("").alias("file"), F.lit(0).alias("block"), F.lit(0).alias("place"), F.lit(0).alias("pos"))
    return _wide(match_api.projected(entries))


def _wide(m, *more):
    return m.select(*more, "id", "date", "league", "season", "home", "away", F.col("hg").cast("long").alias("hg"),
                    F.col("ag").cast("long").alias("ag"), F.col("matchday").cast("long").alias("matchday"))


@register("src_name_map", o.query([o.MATCHES, o.SIDES, landing.NAMES_SQL], "SELECT raw, canonical FROM name_map"))
def src_name_map(spark, sf_dir):
    return tables.read_name_map(spark, landing.write_name_map(landing.name_map(fixture.matches(spark, sf_dir))))


@register("src_matches", o.query([o.MATCHES], """
SELECT id, date, CAST(epoch_ms(ts) AS BIGINT) AS ms, league, season, home, away, hg, ag, 0::BIGINT AS matchday FROM matches
"""))
def src_matches(spark, sf_dir):
    path = new_path(spark, "match-json")
    fixture.matches(spark, sf_dir).select(
        "id", "date", "league", "season", F.col("home").alias("homeTeam"), F.col("away").alias("awayTeam"),
        F.col("hg").alias("homeGoals"), F.col("ag").alias("awayGoals"), "matchday").write.json(path)
    m = tables.read_match_json(spark, path, multi_line=False)
    return _wide(m, F.unix_millis("ts").alias("ms"))


@register("clean_required", o.query(RAW, """
SELECT id FROM raw WHERE d <> '' AND h <> '' AND a <> '' AND g1 <> '' AND g2 <> ''
"""))
def clean_required(spark, sf_dir):
    return season_csv.complete(landing.raw_rows(spark, sf_dir)).select("id")


@register("parse_int", o.query(RAW, """
SELECT id, g1 AS text, TRY_CAST(nullif(regexp_extract(g1, '^\\s*([+-]?[0-9]+)', 1), '') AS DOUBLE) AS value FROM raw
"""))
def parse_int(spark, sf_dir):
    return landing.raw_rows(spark, sf_dir).select(
        "id", F.col("FTHG").alias("text"), parse.leading_int(F.col("FTHG")).cast("double").alias("value"))


@register("parse_date", o.query(RAW + [DATED], """
SELECT id, d AS text, iso AS date,
  epoch_ms(CAST(substr(iso, 1, 8) || '01' AS TIMESTAMP) + to_days(CAST(dd AS INTEGER) - 1) + INTERVAL 15 HOUR)::DOUBLE AS ms
FROM isod
"""))
def parse_date(spark, sf_dir):
    raw = landing.raw_rows(spark, sf_dir).withColumn("iso", parse.iso_from_day_first(F.col("Date")))
    return raw.select("id", F.col("Date").alias("text"), F.col("iso").alias("date"),
                      F.unix_millis(parse.instant(F.col("iso"))).cast("double").alias("ms"))


@register("canon_names", o.query([o.MATCHES, o.SIDES, landing.NAMES_SQL], """
SELECT id, coalesce(h.canonical, home) AS home, coalesce(a.canonical, away) AS away
FROM matches LEFT JOIN name_map h ON h.raw = home LEFT JOIN name_map a ON a.raw = away
"""))
def canon_names(spark, sf_dir):
    m = fixture.matches(spark, sf_dir)
    return season_csv.canonical(m, landing.name_map(m)).select("id", "home", "away")


@register("season_label", o.query(RAW, """
SELECT id, season_code, CAST(season_year + 20 AS VARCHAR) || '-' || CAST(season_year + 21 AS VARCHAR) AS from_code,
  CAST(season_year AS VARCHAR) || '-' || CAST(season_year + 1 AS VARCHAR) AS from_year FROM raw
"""))
def season_label(spark, sf_dir):
    raw = landing.raw_rows(spark, sf_dir)
    start = F.substring("season_code", 1, 2).cast("int")
    return raw.select("id", "season_code", parse.season_from_code(F.col("season_code")).alias("from_code"),
                      parse.season_from_year(start + 1980).alias("from_year"))


PARSED = DATED + """,
parsed AS (
  SELECT *, TRY_CAST(nullif(regexp_extract(g1, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS gh,
    TRY_CAST(nullif(regexp_extract(g2, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS ga
  FROM isod WHERE d <> '' AND h <> '' AND a <> ''),
good AS (SELECT * FROM parsed WHERE gh IS NOT NULL AND ga IS NOT NULL AND iso IS NOT NULL)
"""


@register("league_code", o.query(RAW + [PARSED], """
SELECT id, competition, league, gh AS hg, ga AS ag, iso AS date FROM good
"""))
def league_code(spark, sf_dir):
    return season_csv.parsed(landing.raw_rows(spark, sf_dir)).select(
        "id", "competition", "league", F.col("hg").cast("long").alias("hg"), F.col("ag").cast("long").alias("ag"), "date")


@register("match_id", o.query(RAW + [PARSED], """
SELECT id AS line, 999999 + row_number() OVER (
  ORDER BY season_year, CASE league WHEN 'PL' THEN 0 WHEN 'PD' THEN 1 WHEN 'BL1' THEN 2 WHEN 'SA' THEN 3 ELSE 4 END, id)
  AS match_id FROM good
"""))
def match_id(spark, sf_dir):
    rows = season_csv.parsed(landing.raw_rows(spark, sf_dir)).withColumnRenamed("id", "place").withColumns({
        "file": F.concat_ws("_", "competition", "season_code"), "block": F.lit(0)})
    return season_csv.with_match_ids(rows, as_read=False).select(F.col("place").alias("line"), F.col("id").alias("match_id"))


@register("league_lookup", o.query([o.MATCHES, o.SIDES, o.COUNTRY], """
SELECT t.team, coalesce(c.country, '???') AS short, coalesce(c.label, 'Unknown') AS label,
  coalesce(c.country, '???') AS country
FROM (SELECT DISTINCT team FROM sides) t
LEFT JOIN (SELECT team, arg_min(league, (ts, src_rank, ord, side)) AS league FROM sides
           WHERE team NOT LIKE '%-5' GROUP BY team) r ON r.team = t.team
LEFT JOIN country c ON c.league = r.league
"""))
def league_lookup(spark, sf_dir):
    registry = merge.registry(fixture.matches(spark, sf_dir))
    return rankings.league_names(registry.select("team"), registry.where(~F.col("team").like("%-5")))
