import json

import pytest

from pyspark.sql import functions as F

from helpers import table
from ladderline import fixed_values as fv
from ladderline.config import RatingConfig
from ladderline.operators import fold, merge, profiles, rankings
from ladderline.schema import REGISTRY
from ladderline.session import written
from ladderline.sinks import documents as doc_sink
from ladderline.sinks.tables import write_matches
from ladderline.sources import documents, match_api, season_csv, tables

PAD = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,Referee and other columns that make the header line long enough for a file\n"


def files(tmp_path, **contents):
    for name, data in contents.items():
        (tmp_path / f"{name}.csv").write_bytes(data if isinstance(data, bytes) else data.encode("latin-1"))
    return str(tmp_path)


def rows_of(spark, path):
    found = season_csv.rows(spark, path).orderBy("season_code", "competition", "block", "place").collect()
    return [(r["Date"], r["HomeTeam"], r["AwayTeam"], r["FTHG"], r["FTAG"]) for r in found]


def test_headers_differ_between_files(spark, tmp_path):
    path = files(
        tmp_path,
        E0_1516=PAD + "E0,08/08/2015,Arsenal,Chelsea,1,2,x\n",
        E0_1617="FTAG,FTHG,AwayTeam,HomeTeam,Date" + "," * 80 + "\n2,1,Chelsea,Arsenal,13/08/16,,,,\n",
    )
    assert rows_of(spark, path) == [
        ("08/08/2015", "Arsenal", "Chelsea", "1", "2"), ("13/08/16", "Arsenal", "Chelsea", "1", "2")]


def test_line_ends_blank_lines_blanks_and_short_rows(spark, tmp_path):
    text = "\r\n" + PAD.replace("\n", "\r\n").replace("Date", " Date ") + " \r\nE0, 08/08/2015 ,A ,\xa0B,1\r\n\r\nE0,09/08/2015,A\rC,B,1,2\r\n"
    path = files(tmp_path, E0_1516=text)
    assert rows_of(spark, path) == [("08/08/2015", "A", "B", "1", None), ("09/08/2015", "A\rC", "B", "1", "2")]


def test_single_byte_text_and_quotes_are_kept(spark, tmp_path):
    path = files(tmp_path, D1_1516=PAD + 'D1,08/08/2015,Köln,"Bayern,1,2,3\n')
    assert rows_of(spark, path) == [("08/08/2015", "Köln", '"Bayern', "1", "2")]


def test_utf8_mark_spoils_only_the_first_header(spark, tmp_path):
    body = PAD + "E0,08/08/2015,A,B,1,2,x\n"
    assert rows_of(spark, files(tmp_path, E0_1516=b"\xef\xbb\xbf" + body.encode())) == [
        ("08/08/2015", "A", "B", "1", "2")]


def test_repeated_header_takes_the_last_reached_value(spark, tmp_path):
    head = "Date,HomeTeam,AwayTeam,FTHG,FTAG,,,FTHG" + "," * 70
    path = files(tmp_path, E0_1516=f"{head}\n08/08/2015,A,B,1,2,,,7,\n09/08/2015,A,B,1,2\n")
    assert rows_of(spark, path) == [("08/08/2015", "A", "B", "7", "2"), ("09/08/2015", "A", "B", "1", "2")]


def test_bad_files_give_no_rows_and_a_reason(spark, tmp_path):
    path = files(
        tmp_path, E0_1516=PAD, E0_1617="Date\n1", E0_1718="<!DOCTYPE html>" + "x" * 200,
        E0_1819=PAD + "E0,08/08/2018,A,B,1,2,x\n")
    assert len(rows_of(spark, path)) == 1
    found = season_csv.files(season_csv.lines(spark, path)).select(
        F.regexp_extract("file", "_([0-9]{4})", 1), "reason").collect()
    assert {r[0]: r[1] for r in found} == {"1516": None, "1617": "too short", "1718": "html", "1819": None}


def test_season_files_become_matches(spark, tmp_path):
    path = files(
        tmp_path,
        F1_1516=PAD + "F1,08/08/2015,Paris SG,Lyon,2,0,x\nF1,bad,Paris SG,Lyon,2,0,x\nF1,09/08/2015,,Lyon,2,0,x\n",
        E0_1516=PAD + "E0,31/02/2016,Arsenal,Leeds,3abc,1,x\nE0,09/08/2015,Arsenal,Leeds,x,1,x\n",
        E0_1617=PAD + "E0,08/08/2016,Arsenal,Leeds,0,1,x\n",
        XX_1516=PAD + "XX,08/08/2015,A,B,2,0,x\n",
    )
    names = spark.createDataFrame([("Arsenal", "Arsenal FC"), ("Lyon", "")], "raw string, canonical string")
    got = season_csv.read(spark, path, names).orderBy("id").collect()
    assert [(r["id"], r["date"], r["league"], r["season"], r["home"], r["away"], r["hg"], r["ag"]) for r in got] == [
        (1000000, "2016-02-31T15:00:00Z", "PL", "2015-2016", "Arsenal FC", "Leeds", 3, 1),
        (1000001, "2015-08-08T15:00:00Z", "FL1", "2015-2016", "Paris SG", "Lyon", 2, 0),
        (1000002, "2016-08-08T15:00:00Z", "PL", "2016-2017", "Arsenal FC", "Leeds", 0, 1)]


def test_lines_split_over_many_tasks_keep_their_order(spark, tmp_path):
    n = 3000
    body = "".join(f"E0,{1 + i % 28:02d}/08/2015,H{i},A{i},{i % 5},1,x\n" for i in range(n))
    path = files(tmp_path, E0_1516=PAD + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = season_csv.read(spark, path).orderBy("id").select("id", "home").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in got] == [(1_000_000 + i, f"H{i}") for i in range(n)]


def payload(entries):
    return json.dumps({"filters": {}, "matches": entries}, indent=2)


def entry(i, home="A", away="B", score=(1, 0), **extra):
    e = {"id": i, "utcDate": "2023-08-11T19:00:00Z", "matchday": 1, "homeTeam": {"name": home},
         "awayTeam": {"name": away}, "score": {"winner": "x", "fullTime": {"home": score[0], "away": score[1]}}}
    e.update(extra)
    return e


def test_payloads(spark, tmp_path):
    (tmp_path / "PL_2023.json").write_text(payload([
        entry(1), entry(2, score=(None, None)), entry(3, homeTeam={}), entry(4, matchday=None),
        entry(5, score=(0, None)), entry(6, awayTeam=None)]))
    (tmp_path / "SA_2023.json").write_text(payload([entry(7)]))
    (tmp_path / "BL1_2024.json").write_text(payload([entry(8)]))
    (tmp_path / "FL1_2024.json").write_text('{"matches": "none", "padding": "' + "x" * 200 + '"}')
    (tmp_path / "PD_2024.json").write_text('{"matches": []}')
    got = match_api.read(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["id"], r["league"], r["season"], r["home"], r["away"], r["matchday"], r["ord"]) for r in got] == [
        (1, "PL", "2023-2024", "A", "B", 1, 1), (3, "PL", "2023-2024", "Unknown", "B", 1, 2),
        (4, "PL", "2023-2024", "A", "B", 0, 3), (6, "PL", "2023-2024", "A", "Unknown", 1, 4),
        (8, "BL1", "2024-2025", "A", "B", 1, 5), (7, "SA", "2023-2024", "A", "B", 1, 6)]


def test_name_map_and_optional_inputs(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"Köln": "1. FC Köln", "x": "y"}, indent=1))
    got = tables.read_name_map(spark, str(tmp_path / "names.json")).collect()
    assert {tuple(r) for r in got} == {("Köln", "1. FC Köln"), ("x", "y")}
    assert tables.read_name_map(spark, str(tmp_path / "absent.json")).isEmpty()
    assert documents.read_registry(spark, str(tmp_path / "absent.json")).isEmpty()
    assert tables.default_name_map(spark).count() == len(fv.CLUB_NAMES)


@pytest.mark.parametrize("multi_line", [True, False])
def test_match_lists_keep_their_order(spark, tmp_path, multi_line):
    entries = [{"id": i * 7919 % 501, "date": "2020-02-31T15:00:00Z", "league": "PL", "season": "s", "homeTeam": "a",
                "awayTeam": "b", "homeGoals": 1, "awayGoals": 2, "matchday": 0} for i in range(500)]
    text = json.dumps(entries, indent=1) if multi_line else "\n".join(json.dumps(e) for e in entries)
    (tmp_path / "m.json").write_text(text)
    got = tables.read_match_json(spark, str(tmp_path / "m.json"), multi_line=multi_line).orderBy("ord").collect()
    assert [r["id"] for r in got] == [e["id"] for e in entries]
    assert got[0]["ord"] == 1 and str(got[0]["ts"])[:10] == "2020-03-02"


def test_match_table_round_trip(spark, tmp_path):
    rows = [(1, "2016-02-31T15:00:00Z", "PL", "a", "b", 1, 0), (2, "2016-03-01T15:00:00Z", "SA", "c", "d", 1, 0)]
    m = table(spark, rows)
    write_matches(m, str(tmp_path / "m"))
    write_matches(m, str(tmp_path / "m"))
    back = tables.read_matches(spark, str(tmp_path / "m"))
    assert sorted(back.collect()) == sorted(m.collect())


def test_whole_documents(spark, tmp_path):
    """Pretty-printed single objects, as another program would write them."""
    (tmp_path / "reg.json").write_text(json.dumps(
        {"A": {"league": "PL", "country": "ENG", "matchesPlayed": 2}, "B": {"league": "SA"}}, indent=2))
    got = documents.read_registry(spark, str(tmp_path / "reg.json")).collect()
    assert {tuple(r) for r in got} == {("A", "PL", "ENG", 2), ("B", "SA", None, None)}
    (tmp_path / "daily.json").write_text(json.dumps({"A": [{"date": "2020-01-01", "rating": 1.5}], "B": []}, indent=2))
    assert [tuple(r) for r in documents.read_daily(spark, str(tmp_path / "daily.json")).collect()] == [
        ("A", "2020-01-01", 1.5)]
    (tmp_path / "ratings.json").write_text(json.dumps({
        "config": {"kFactor": 24, "leagueStrength": {"PL": 1.15}}, "computedAt": "now", "matchesProcessed": 3,
        "teams": [{"team": "B", "rating": 1600.5, "wins": 1, "ratingHistory": [{"date": "d", "rating": 1.0}]},
                  {"team": "A", "rating": 1500, "ratingHistory": []}]}, indent=2))
    path = str(tmp_path / "ratings.json")
    assert [(r["rank"], r["team"], r["rating"]) for r in documents.read_ratings(spark, path).orderBy("rank").collect()] == [
        (1, "B", 1600.5), (2, "A", 1500.0)]
    assert [tuple(r) for r in documents.read_history(spark, path).collect()] == [("B", 1, "d", 1.0)]
    run = documents.read_run(spark, path).first()
    assert (run["computedAt"], run["matchesProcessed"], run["config"]["kFactor"]) == ("now", 3, 24.0)


@pytest.mark.parametrize("part_teams,part_entries", [(200, 5000), (2, 3)])
def test_written_documents_hold_everything(spark, tmp_path, part_teams, part_entries):
    from test_fold import random_rows

    config = RatingConfig()
    m = written(table(spark, random_rows(11, n=60, leagues=("PL", "SA"), teams=3)), "m")
    done = written(fold.rating_fold(m, config), "f")
    states, events = fold.final_states(done), fold.rating_events(done)
    ranked = written(rankings.ranked(states), "r")
    path = str(tmp_path / "ratings")
    doc_sink.write_ratings(ranked, events, m.count(), "t", config, path, part_teams, part_entries)
    expected = {(r["rank"], r["team"], r["rating"], r["wins"], r["last_updated"]) for r in ranked.collect()}
    assert {(r["rank"], r["team"], r["rating"], r["wins"], r["last_updated"])
            for r in documents.read_ratings(spark, path).collect()} == expected
    history = {(r["team"], r["seq"], r["date"], r["rating_after"]) for r in events.collect()}
    assert {tuple(r) for r in documents.read_history(spark, path).collect()} == history
    assert documents.read_run(spark, path).count() == 1
    daily = profiles.daily_snapshot(events)
    doc_sink.write_daily(ranked, daily, str(tmp_path / "daily"), part_teams, part_entries)
    assert ({tuple(r) for r in documents.read_daily(spark, str(tmp_path / "daily")).collect()}
            == {tuple(r) for r in daily.collect()})
    registry = merge.registry(m)
    doc_sink.write_registry(registry, str(tmp_path / "reg"), part_teams)
    back = documents.read_registry(spark, str(tmp_path / "reg"))
    assert back.schema.fieldNames() == REGISTRY.fieldNames()
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in registry.drop("first_seen").collect()}
    if part_teams == 200:
        texts = spark.read.text(path).collect()
        assert len(texts) == 1
        assert [t["team"] for t in json.loads(texts[0][0])["teams"]] == [
            r["team"] for r in ranked.orderBy("rank").collect()]


def test_names_come_from_the_end_of_the_path(spark, tmp_path):
    folder = tmp_path / "RUN1_2024"
    folder.mkdir()
    files(folder, E0_1516=PAD + "E0,08/08/2015,Arsenal,Chelsea,1,2,x\n")
    assert [(r["competition"], r["season_code"]) for r in season_csv.rows(spark, str(folder)).collect()] == [("E0", "1516")]
    (folder / "PL_2023.json").write_text(json.dumps({"matches": [{
        "id": 1, "utcDate": "2023-08-01T20:00:00Z", "homeTeam": {"name": "a"}, "awayTeam": {"name": "b"},
        "score": {"fullTime": {"home": 4, "away": 0}}}]}))
    found = match_api.read(spark, str(folder / "PL_2023.json")).collect()
    assert [(r["league"], r["season"]) for r in found] == [("PL", "2023-2024")]


def test_rejects_have_reasons(spark, tmp_path):
    good = "E0,08/08/2015,Arsenal,Chelsea,1,2,x\n"
    path = files(tmp_path, E0_1516=PAD + good + "E0,31/13/2015,A,B,1,2\nE0,09/08/2015,A,B,x,2\nE0,09/08/2015,,B,1,2\n",
                 X9_1516=PAD + good, nameless=PAD + good, E0_1617="Div,Day" + "," * 120 + "\nE0,1\n", E0_1718="x", E0_1819="<!DOCTYPE html>" + " " * 120)
    found = season_csv.rejects(season_csv.lines(spark, path)).collect()
    got = sorted((r["file"].rsplit("/", 1)[1].removesuffix(".csv"), r["reason"], r["lines"]) for r in found)
    assert got == sorted([
        ("E0_1516", "unreadable date", 1), ("E0_1516", "unreadable score", 1), ("E0_1516", "a needed column is empty", 1),
        ("X9_1516", "unknown competition", 2), ("nameless", "no competition and season in the name", 2),
        ("E0_1617", "missing columns", 2), ("E0_1718", "too short", 1), ("E0_1819", "html", 1)])


def test_a_later_line_equal_to_the_header_is_a_row(spark, tmp_path):
    path = files(tmp_path, E0_1516=PAD + "E0,08/08/2015,A,B,1,2\n" + PAD + "E0,09/08/2015,A,B,1,2\n")
    assert len(rows_of(spark, path)) == 3


def test_large_documents_by_default_settings(spark, tmp_path):
    teams = spark.range(450).select(
        F.concat(F.lit("t"), F.col("id")).alias("team"), F.lit("PL").alias("league"), F.lit("ENG").alias("country"),
        F.col("id").alias("matches_played"), F.col("id").alias("first_seen"))
    doc_sink.write_registry(teams, str(tmp_path / "reg"))
    assert documents.read_registry(spark, str(tmp_path / "reg")).distinct().count() == 450
    ranked = teams.limit(2).select(
        "team", (F.col("matches_played") + 1).alias("rank"), F.lit(1.0).alias("rating"), *[F.lit(1).cast("long").alias(c) for c in ("matches", "wins", "draws", "losses")],
        F.lit("d").alias("last_updated"))
    events = spark.range(1, 6001).select(
        F.lit("t0").alias("team"), F.col("id").alias("seq"), F.col("id").cast("string").alias("date"), F.col("id").cast("double").alias("rating_after"))
    doc_sink.write_ratings(ranked, events, 6000, "t", RatingConfig(), str(tmp_path / "ratings"))
    assert documents.read_history(spark, str(tmp_path / "ratings")).distinct().count() == 6000
    assert documents.read_ratings(spark, str(tmp_path / "ratings")).count() == 2


def test_a_day_that_is_no_calendar_day_is_published(spark, tmp_path):
    daily = spark.createDataFrame([("a", "2020-02-31", 1.0), ("a", "2020-03-01", 2.0)], "team string, date string, rating double")
    ranked = spark.createDataFrame([("a", 1)], "team string, rank long")
    doc_sink.write_daily(ranked, daily, str(tmp_path / "daily"))
    assert {tuple(r) for r in documents.read_daily(spark, str(tmp_path / "daily")).collect()} == {tuple(r) for r in daily.collect()}
