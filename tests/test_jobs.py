"""The jobs end to end on landed files, and the shape of the plans."""

import datetime
import json
import re

import pytest

from pyspark.sql import functions as F

from helpers import replay, table
from ladderline.config import RatingConfig
from ladderline.functions import parse
from ladderline.operators import breaks, fold, merge, profiles
from ladderline.plans import ingest, rate, views
from ladderline.schema import MATCHES
from ladderline.session import written
from ladderline.sources import documents
from test_fold import random_rows
from workload import fixture

SF = "/root/testdata/sf0.001"


def test_landed_files_to_views(spark, tmp_path):
    csv, api = tmp_path / "historical", tmp_path / "raw"
    csv.mkdir(), api.mkdir()
    lines = ["Div,Date,HomeTeam,AwayTeam,FTHG,FTAG" + "," * 60]
    start = datetime.date(2023, 8, 1)
    clubs = ["Arsenal", "Chelsea", "Leeds", "Everton"]
    played = []
    for i in range(60):
        h, a = clubs[i % 4], clubs[(i + 1 + i % 3) % 4]
        d = start + datetime.timedelta(days=i if i < 30 else i + 90)
        played.append((d, h, a, i % 4, i % 3))
        lines.append(f"E0,{d:%d/%m/%Y},{h},{a},{i % 4},{i % 3}")
    (csv / "E0_2324.csv").write_text("\n".join(lines))
    d, h, a, hg, ag = played[5]
    (api / "PL_2023.json").write_text(json.dumps({"matches": [{
        "id": 77, "utcDate": f"{d}T20:00:00Z", "homeTeam": {"name": "Chelsea FC"}, "awayTeam": {"name": "Leeds United FC"},
        "score": {"fullTime": {"home": 4, "away": 0}}, "padding": "x" * 100}]}))
    m = ingest.build_match_table(spark, str(csv), str(api), str(tmp_path / "m"), str(tmp_path / "reg"))
    assert m.count() in (60, 61)
    assert m.where("id = 77").first()["season"] == "2023-2024"
    registry = documents.read_registry(spark, str(tmp_path / "reg"))
    assert "Arsenal FC" in {r["team"] for r in registry.collect()}

    done = rate.rate(m)
    rows = [(r["id"], r["date"], r["league"], r["home"], r["away"], r["hg"], r["ag"])
            for r in merge.chronological(m).collect()]
    expected, _ = replay(rows, RatingConfig())
    assert {r["team"]: r["rating"] for r in done.ranked.collect()} == pytest.approx(expected)
    rate.publish(done, "now", str(tmp_path / "ratings"), str(tmp_path / "daily"))
    assert documents.read_ratings(spark, str(tmp_path / "ratings")).count() == len(expected)

    shown = views.rankings_view(done, registry, league="PL", limit=2)
    assert [r["rank"] for r in shown["ranking"].collect()] == [1, 2]
    assert shown["headline"].first()["teams_rated"] == len(expected)
    for name, df in views.team_view(done, registry, datetime.date(2024, 1, 1)).items():
        assert df.count() >= (1 if name != "external" else 0), name
    report = views.validation(done.ranked, done.ranked)
    assert report["comparison"].count() == 20
    assert report["spearman_delta"].first()["change"] == 0
    assert {r["movement"] for r in report["movements"].collect()} == {"unchanged"}


def test_absent_sources(spark, tmp_path):
    m = ingest.build_match_table(spark, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "m"))
    assert m.isEmpty()


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_fold_shuffles_and_sorts_once(spark):
    m = written(table(spark, random_rows(1, leagues=("PL", "SA"))), "m")
    text = plan(fold.rating_fold(m, RatingConfig()))
    assert text.count("FlatMapGroupsInArrow") == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_merge_is_an_anti_join(spark):
    m = fixture.matches(spark, SF)
    assert "LeftAnti" in plan(merge.uncovered(m, m))


def test_breaks_window_sees_buckets_only(spark):
    m = written(fixture.matches(spark, SF), "m")
    text = plan(breaks.bucket_spans(m, RatingConfig()))
    single = text.index("SinglePartition")
    # the only unpartitioned exchange is above the aggregation to buckets
    assert text.index("HashAggregate") > single
    assert breaks.bucket_spans(m, RatingConfig()).count() <= 100


def test_form_limits_before_the_shuffle(spark):
    m = written(fixture.matches(spark, SF), "m")
    assert "WindowGroupLimit" in plan(profiles.last_matches(m))


def test_scan_reads_needed_columns_and_pushes_filters(spark):
    m = written(fixture.matches(spark, SF), "m")
    text = plan(m.where(F.col("ts").isin(F.expr("timestamp_micros(0)"))).groupBy("ts").agg(F.min("date")))
    assert re.search(r"PushedFilters: \[.*EqualTo\(ts", text) or re.search(r"PushedFilters: \[.*In\(ts", text)
    assert re.search(r"ReadSchema: struct<ts:timestamp,date:string>", text)


def test_small_tables_are_not_python_data(spark):
    assert "Scan ExistingRDD" not in plan(fixture.matches(spark, SF))
    assert set(fixture.matches(spark, SF).columns) == set(MATCHES.fieldNames())
    assert fixture.matches(spark, SF).where(parse.instant(F.col("date")) != F.col("ts")).isEmpty()
