"""Landing-zone files and raw rows derived from the matches, with every kind of defect.

File contents are cut by id ranges, so no file and no document grows with the scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.functions.rating import lookup
from ladderline.session import new_path, written
from ladderline.sources.season_csv import evaluated
from workload import fixture

ROWS_PER_FILE = 1_000_000
ROWS_PER_DOCUMENT = 1_000
NAMES_PER_PART = 1_000

RAW_SQL = """
raw AS (
  SELECT id,
    CASE league WHEN 'PL' THEN 'E0' WHEN 'PD' THEN 'SP1' WHEN 'BL1' THEN 'D1' WHEN 'SA' THEN 'I1' ELSE 'F1' END
      AS competition,
    lpad(CAST((season_year + 20) % 100 AS VARCHAR), 2, '0') || lpad(CAST((season_year + 21) % 100 AS VARCHAR), 2, '0')
      AS season_code,
    season_year % 2 AS odd, league, season_year,
    CASE id % 50 WHEN 2 THEN strftime(ts, '%d/%m')
      WHEN 3 THEN strftime(ts, '%d/') || '13/' || CAST(year(ts) + 20 AS VARCHAR)
      WHEN 4 THEN strftime(ts, '%d/%m/') || '51'
      WHEN 6 THEN strftime(ts, '%d/%m/') || lpad(CAST((year(ts) + 20) % 100 AS VARCHAR), 2, '0')
      WHEN 7 THEN CAST(day(ts) AS VARCHAR) || '/' || CAST(month(ts) AS VARCHAR) || '/' || CAST(year(ts) + 20 AS VARCHAR)
      WHEN 9 THEN '31/02/2020'
      ELSE strftime(ts, '%d/%m/') || CAST(year(ts) + 20 AS VARCHAR) END AS d,
    CASE id % 50 WHEN 10 THEN '' ELSE home END AS h, away AS a,
    CASE id % 50 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 5 THEN CAST(hg AS VARCHAR) || 'abc'
      WHEN 8 THEN CAST(hg AS VARCHAR) || '.5' ELSE CAST(hg AS VARCHAR) END AS g1,
    CAST(ag AS VARCHAR) AS g2
  FROM matches)
"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a season file would hold them, all text; years are moved on by 20."""
    m = fixture.matches(spark, sf_dir)
    kind = F.col("id") % 50
    year = F.year("ts") + 20
    start = F.substring("season", 1, 4).cast("int")
    code = {league: c for c, league in fv.COMPETITION_LEAGUE.items()}

    def two(c):
        return F.lpad((c % 100).cast("string"), 2, "0")

    date = (
        F.when(kind == 2, F.date_format("ts", "dd/MM"))
        .when(kind == 3, F.concat(F.date_format("ts", "dd/"), F.lit("13/"), year.cast("string")))
        .when(kind == 4, F.concat(F.date_format("ts", "dd/MM/"), F.lit("51")))
        .when(kind == 6, F.concat(F.date_format("ts", "dd/MM/"), two(year)))
        .when(kind == 7, F.concat_ws("/", F.day("ts").cast("string"), F.month("ts").cast("string"), year.cast("string")))
        .when(kind == 9, "31/02/2020")
        .otherwise(F.concat(F.date_format("ts", "dd/MM/"), year.cast("string")))
    )
    goals = F.col("hg").cast("string")
    return m.select("id", evaluated([
        lookup(code, "league", "string").alias("competition"),
        F.concat(two(start + 20), two(start + 21)).alias("season_code"), (start % 2).alias("odd"),
        date.alias("Date"),
        F.when(kind == 10, "").otherwise(F.col("home")).alias("HomeTeam"), F.col("away").alias("AwayTeam"),
        F.when(kind == 0, "").when(kind == 1, "x").when(kind == 5, F.concat(goals, F.lit("abc")))
        .when(kind == 8, F.concat(goals, F.lit(".5"))).otherwise(goals).alias("FTHG"),
        F.col("ag").cast("string").alias("FTAG")]))


EVEN_HEADER = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,,"
ODD_HEADER = "Date,Time,AwayTeam,HomeTeam,FTAG,FTHG"

# the same lines in SQL, for file sizes
LINES_SQL = f"""
landed AS (
  SELECT *, id // {ROWS_PER_FILE} AS shard, CASE WHEN odd = 1 THEN '{ODD_HEADER}' ELSE '{EVEN_HEADER}' END AS header,
    CASE WHEN odd = 1 THEN d || ',15:00,' || a || ',' || h || ',' || g2 || ',' || g1
         ELSE competition || ',' || d || ',' || h || ',' || a || ',' || g1 || ',' || g2 || ',D,,' END AS line
  FROM raw)
"""

# odd files end their lines with two bytes
FILES_SQL = """
landed_files AS (
  SELECT competition, season_code, shard, any_value(header) AS header,
    sum(length(line) + 1 + odd) + any_value(length(header) + 1 + odd) AS bytes
  FROM landed GROUP BY competition, season_code, shard)
"""


def season_lines(raw: DataFrame) -> DataFrame:
    line = F.when(
        F.col("odd") == 1,
        F.concat_ws(",", "Date", F.lit("15:00"), "AwayTeam", "HomeTeam", "FTAG", F.concat("FTHG", F.lit("\r"))),
    ).otherwise(F.concat_ws(
        ",", "competition", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", F.lit("D,,")))
    body = raw.select(
        F.concat_ws("_", "competition", "season_code").alias("file"),
        F.expr(f"id div {ROWS_PER_FILE}").alias("shard"), F.col("id").alias("pos"), line.alias("line"), "odd")
    header = F.when(F.col("odd") == 1, ODD_HEADER + "\r").otherwise(EVEN_HEADER)
    headers = body.select("file", "shard", "odd").distinct().select(
        "file", "shard", F.lit(-1).cast("long").alias("pos"), header.alias("line"))
    return body.drop("odd").unionByName(headers)


def write_lines(lines: DataFrame, label: str) -> str:
    path = new_path(lines.sparkSession, label)
    (
        lines.repartition("file", "shard").sortWithinPartitions("file", "shard", "pos")
        .select("file", "shard", "line").write.partitionBy("file", "shard").text(path)
    )
    return path


def rejects(raw: DataFrame) -> DataFrame:
    """One HTML answer and one stub file per competition."""
    html = "<!DOCTYPE html>" + " " * 100
    return raw.select("competition").distinct().select(F.inline(F.array(*[
        F.struct(F.concat(F.col("competition"), F.lit("_" + code)).alias("file"), F.lit(0).cast("long").alias("shard"),
                 F.lit(0).cast("long").alias("pos"), F.lit(text).alias("line"))
        for code, text in (("0001", html), ("0002", "Date,HomeTeam"))])))


API_SQL = """
entries AS (
  SELECT id, date, league, season, season_year,
    CASE WHEN id % 40 = 5 THEN NULL ELSE home END AS home_name, away AS away_name,
    CASE WHEN id % 25 = 3 THEN NULL ELSE hg END AS h, CASE WHEN id % 25 = 3 THEN NULL ELSE ag END AS a,
    CASE WHEN id % 7 = 0 THEN NULL ELSE id % 38 + 1 END AS md
  FROM matches)
"""


def api_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """league, year and payload entry `m` per match; some lack a score, a name or a matchday."""
    m = fixture.matches(spark, sf_dir)
    scored = F.col("id") % 25 != 3
    entry = F.struct(
        "id", F.col("date").alias("utcDate"),
        F.when(F.col("id") % 7 != 0, (F.col("id") % 38 + 1).cast("int")).alias("matchday"),
        F.struct(F.when(F.col("id") % 40 != 5, F.col("home")).alias("name")).alias("homeTeam"),
        F.struct(F.col("away").alias("name")).alias("awayTeam"),
        F.struct(F.struct(F.when(scored, F.col("hg")).alias("home"),
                          F.when(scored, F.col("ag")).alias("away")).alias("fullTime")).alias("score"))
    return m.select("league", F.substring("season", 1, 4).cast("int").alias("year"), entry.alias("m"))


def write_api(entries: DataFrame) -> str:
    """Payload documents of at most ROWS_PER_DOCUMENT ids, one per line."""
    path = new_path(entries.sparkSession, "api")
    (
        entries.groupBy(F.concat_ws("_", "league", "year").alias("doc"),
                        F.expr(f"m.id div {ROWS_PER_DOCUMENT}").alias("page"))
        .agg(F.array_sort(F.collect_list("m")).alias("matches"))
        .select("doc", F.to_json(F.struct("matches")).alias("value"))
        .write.partitionBy("doc").text(path)
    )
    return path


NAMES_SQL = """
teams AS (SELECT DISTINCT team FROM sides),
name_map AS (
  SELECT team AS raw, 'Club ' || substr(team, 8) AS canonical FROM teams
  WHERE CAST(regexp_extract(team, '_([0-9]+)-', 1) AS INTEGER) % 2 = 0)
"""


def name_map(matches: DataFrame) -> DataFrame:
    """Teams of even nations get another name, the others none."""
    teams = matches.select(F.explode(F.array("home", "away")).alias("raw")).distinct()
    return teams.where(F.regexp_extract("raw", "_([0-9]+)-", 1).cast("int") % 2 == 0).select(
        "raw", F.concat(F.lit("Club "), F.expr("substr(raw, 8)")).alias("canonical"))


def write_name_map(mapping: DataFrame) -> str:
    """JSON objects over the names, cut by a hash of the name into parts of about NAMES_PER_PART."""
    path = new_path(mapping.sparkSession, "names")
    pair = F.struct("raw", "canonical")
    mapping = written(mapping, "name-pairs")
    parts = max(1, mapping.count() // NAMES_PER_PART)
    (
        mapping.groupBy(F.pmod(F.xxhash64("raw"), F.lit(parts)).alias("part"))
        .agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value"))
        .repartition("part").write.partitionBy("part").text(path)
    )
    return path
