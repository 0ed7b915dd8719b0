"""Season result files: comma-separated, single-byte text, one header per file.

Headers differ between files, so a schema cannot be given to a CSV reader for a whole folder. The
files are read as splittable lines, twice: once for each file's header and facts, once for its rows.
File names (or a folder name on the path) carry `<competition>_<yyYY>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.functions import parse, rating
from ladderline.operators.ordinal import with_block_ordinal
from ladderline.session import side, written

NEEDED = ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG"]
MIN_BYTES = 100
HTML_MARK = "<!DOCTYPE"
# the last such name on the path: the file's own, else the nearest folder's
_NAME = r"(?s).*(?<![A-Za-z0-9])([A-Z]+[0-9]+)_([0-9]{4})(?![0-9])"


def evaluated(columns: list[Column]) -> Column:
    """The columns computed once per row.

    As the output of a generator they are values to later filters, which would otherwise be pushed
    below and repeat the parsing for every mention.
    """
    return F.inline(F.array(F.struct(*columns)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, size, block, place, line: (block, place) orders the lines of a file."""
    raw = (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            # only compared between lines of one block, where it follows the line order
            F.monotonically_increasing_id().alias("place"),
            # the reader keeps bytes as they are
            F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"))
    )
    return raw.withColumn("line", F.rtrim("line", F.lit("\r")))


def files(source_lines: DataFrame) -> DataFrame:
    """One row per file: header text, line count, and why it is rejected (NULL when it is not).

    One scan: lines that name all needed columns are group keys beside the facts of their block, so
    that only numbers are aggregated and the header needs no second look at the lines. `header` is
    NULL when the first filled line doesn't name them.
    """
    filled = parse.strip(F.col("line")) != ""
    naming = filled
    for c in NEEDED:
        naming = naming & F.contains("line", F.lit(c))
    blocks = source_lines.groupBy("file", "block", F.when(naming, F.col("line")).alias("header")).agg(
        F.max("size").alias("size"), F.max(F.contains("line", F.lit(HTML_MARK))).alias("html"),
        F.count_if(filled).alias("filled_lines"), F.min(F.when(filled, F.col("place"))).alias("place"))
    first = F.min(F.when(F.col("place").isNotNull(), F.struct("block", "place", "header")))
    facts = blocks.groupBy("file").agg(
        F.max("size").alias("size"), F.max("html").alias("html"), F.sum("filled_lines").alias("filled_lines"), first.alias("first"))
    competition = F.regexp_extract("file", _NAME, 1)
    names = F.transform(F.split("first.header", ",", -1), parse.strip)
    complete_ = F.forall(F.array(*[F.lit(c) for c in NEEDED]), lambda c: F.array_contains(names, c))
    reason = (
        F.when(F.col("size") < MIN_BYTES, "too short")
        .when(F.col("html"), "html")
        .when(competition == "", "no competition and season in the name")
        .when(rating.lookup(fv.COMPETITION_LEAGUE, competition, "string").isNull(), "unknown competition")
        .when(F.col("first").isNull(), "no header")
        .when(~F.coalesce(complete_, F.lit(False)), "missing columns")
    )
    return facts.select("file", "size", "filled_lines", F.col("first.header").alias("header"), reason.alias("reason"),
                        F.col("first.block").alias("first_block"), F.col("first.place").alias("first_place"))


def _row_reason() -> Column:
    return (
        F.when(~_complete(), "a needed column is empty")
        .when(parse.leading_int(F.col("FTHG")).isNull() | parse.leading_int(F.col("FTAG")).isNull(), "unreadable score")
        .when(parse.instant(parse.iso_from_day_first(F.col("Date"))).isNull(), "unreadable date")
    )


def rejects(source_lines: DataFrame) -> DataFrame:
    """file, reason, lines: files that aren't read, and counts of rows that are dropped from the others."""
    found = written(files(source_lines), "season-files")
    whole = found.where("reason IS NOT NULL").select("file", "reason", F.col("filled_lines").alias("lines"))
    text = _rows(source_lines, found.where("reason IS NULL"), NEEDED)
    rows_ = text.withColumn("reason", _row_reason()).where("reason IS NOT NULL").groupBy("file", "reason").agg(
        F.count(F.lit(1)).alias("lines"))
    return whole.unionByName(rows_)


def ledger(source_lines: DataFrame) -> DataFrame:
    """file, block, place, line, reason: every filled line that gives no match, and why.

    A rejected file gives all its lines with the file's reason. Header lines of accepted files are
    neither kept nor rejected. Written once; that every file's lines are its header, kept rows and
    rejected rows is checked then, and a difference raises.
    """
    found = written(files(source_lines), "season-files")
    refused = side(found.where("reason IS NOT NULL").select("file", "reason"), "season-refused")
    whole = source_lines.where(parse.strip(F.col("line")) != "").join(refused, "file").select(
        "file", "block", "place", "line", "reason")
    rows_ = _rows(source_lines, found.where("reason IS NULL"), NEEDED, "line").withColumn("reason", _row_reason())
    judged = written(whole.unionByName(rows_.select("file", "block", "place", "line", "reason")), "season-ledger")
    counts = judged.groupBy("file").agg(F.count("reason").alias("rejected"), F.count(F.lit(1)).alias("judged"))
    heads = F.when(F.col("reason").isNull(), 1).otherwise(0)
    wrong = found.join(counts, "file", "left").where(
        (F.col("filled_lines") != F.coalesce("judged", F.lit(0)) + heads)
        | (F.col("reason").isNotNull() & (F.coalesce("rejected", F.lit(0)) != F.col("filled_lines"))))
    lost = wrong.select("file").head(1)
    if lost:
        raise RuntimeError(f"lines read and lines judged differ in {lost[0].file}")
    return judged.where("reason IS NOT NULL")


def _field(name: str) -> Column:
    """The value under the last header called `name` that the row reaches; NULL when there is none."""
    reached = F.slice("names", 1, F.least(F.size("names"), F.size("fields")))
    back = F.array_position(F.reverse(reached), F.lit(name))
    index = F.nullif(back, F.lit(0))
    return parse.strip(F.try_element_at("fields", (F.size(reached) - index + 1).cast("int"))).alias(name)


def rows(spark: SparkSession, path: str, columns: list[str] = NEEDED) -> DataFrame:
    """Data rows of all accepted files with the named columns as text."""
    source_lines = lines(spark, path)
    return _rows(source_lines, files(source_lines).where("reason IS NULL"), columns)


def _rows(source_lines: DataFrame, accepted: DataFrame, columns: list[str], *more: str) -> DataFrame:
    # one row per file; what a file says about all its lines is worked out once per file
    headers = side(accepted.select(
        "file", "first_block", "first_place",
        F.regexp_extract("file", _NAME, 1).alias("competition"),
        F.regexp_extract("file", _NAME, 2).alias("season_code"),
        F.transform(F.split("header", ",", -1), parse.strip).alias("names")), "season-headers")
    return (
        source_lines.where(parse.strip(F.col("line")) != "")
        .join(headers, "file")
        # the header line itself; a later line of the same text is a row
        .where((F.col("block") != F.col("first_block")) | (F.col("place") != F.col("first_place")))
        .withColumn("fields", F.split("line", ",", -1))
        .select("file", "block", "place", *more, "competition", "season_code", evaluated([_field(c) for c in columns]))
    )


def canonical(matches: DataFrame, name_map: DataFrame, columns: tuple[str, ...] = ("home", "away")) -> DataFrame:
    """Replace team names by their canonical form; names without one stay."""
    out = matches
    for c in columns:
        mapping = name_map.select(F.col("raw").alias(c), F.col("canonical").alias("_canonical"))
        out = out.join(mapping, c, "left").withColumn(
            c, F.coalesce(F.nullif("_canonical", F.lit("")), c)).drop("_canonical")
    return out.select(matches.columns)


def complete(csv_rows: DataFrame) -> DataFrame:
    """Rows in which every needed column holds text."""
    return csv_rows.where(_complete())


def _complete() -> Column:
    keep = F.lit(True)
    for c in NEEDED:
        keep = keep & (F.coalesce(c, F.lit("")) != "")
    return keep


def parsed(csv_rows: DataFrame) -> DataFrame:
    """Complete rows, typed; rows with an unreadable date or score are dropped."""
    known = complete(csv_rows).drop(*NEEDED).columns
    return (
        complete(csv_rows)
        .select(*known, evaluated([
            rating.lookup(fv.COMPETITION_LEAGUE, "competition", "string").alias("league"),
            parse.season_from_code(F.col("season_code")).alias("season"),
            F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"),
            parse.leading_int(F.col("FTHG")).alias("hg"), parse.leading_int(F.col("FTAG")).alias("ag"),
            parse.iso_from_day_first(F.col("Date")).alias("iso_date")]))
        .where(F.col("league").isNotNull() & F.col("hg").isNotNull() & F.col("ag").isNotNull()
               & F.col("iso_date").isNotNull())
        .withColumn("ts", parse.instant(F.col("iso_date")))
        .where(F.col("ts").isNotNull())
        .withColumnRenamed("iso_date", "date")
    )


def league_position(league: Column | str) -> Column:
    order = {code: i for i, code in enumerate(fv.LEAGUE_COUNTRY)}
    return rating.lookup(order, league, "int")


def with_match_ids(matches: DataFrame, as_read: bool = True) -> DataFrame:
    """Number rows by season, league, file and line, starting at the first id of id-less sources.

    `as_read`: rows come as a scan gave them, those of a block together and in order.
    """
    numbered = with_block_ordinal(
        matches.withColumn("league_pos", league_position("league")), ["season", "league_pos", "file", "block"], "n", "match-ids",
        None if as_read else "place")
    return numbered.withColumn("id", F.col("n") + F.lit(fv.FIRST_MATCH_ID - 1)).withColumn("ord", F.col("n"))


def read(spark: SparkSession, path: str, name_map: DataFrame | None = None) -> DataFrame:
    """Season files as a match table."""
    typed = with_match_ids(parsed(rows(spark, path)))
    if name_map is not None:
        typed = canonical(typed, name_map)
    return typed.select(
        "id", "ts", "date", "league", "season", "home", "away", "hg", "ag",
        F.lit(0).alias("matchday"), F.lit(0).alias("src_rank"), "ord")
