"""Runs that go on from written ones, split documents with a manifest, plans without sorts of rows."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import table
from ladderline.config import RatingConfig
from ladderline.operators import continued, fold, merge, ordinal, profiles
from ladderline.schema import MATCH_ORDER
from ladderline.session import shared_folder, written
from ladderline.sinks import documents as doc_sink
from ladderline.sources import documents, season_csv
from test_fold import random_rows
from test_sources import PAD, files


def rows_of(df):
    return sorted(map(repr, df.collect()))


def same_fold(one, other):
    """Bit for bit, but for the number of state rows' order."""
    assert rows_of(fold.rating_events(one)) == rows_of(fold.rating_events(other))
    assert rows_of(fold.final_states(one)) == rows_of(fold.final_states(other))


@pytest.mark.parametrize("cuts", [(0, 40), (13, 14), (60, 90)])
@pytest.mark.parametrize("max_group_rows", [20_000_000, 15])
def test_continued_runs_equal_one_fold(spark, tmp_path, cuts, max_group_rows):
    config = RatingConfig()
    m = written(table(spark, random_rows(5, n=90, leagues=("PL", "SA"), teams=4)), "m")
    placed = written(m.withColumn("at", F.row_number().over(ordinal.W.orderBy(*MATCH_ORDER))), "placed")
    paths = []
    for i, (low, high) in enumerate(zip((0, *cuts), (*cuts, 90))):
        path = str(tmp_path / str(i))
        part = placed.where((F.col("at") > low) & (F.col("at") <= high)).drop("at")
        continued.fold_on(part, path, paths[-1] if paths else None, config, max_group_rows=max_group_rows)
        paths.append(path)
    same_fold(continued.final_fold(spark, paths, config), fold.rating_fold(m, config))


def test_a_late_match_raises(spark, tmp_path):
    m = written(table(spark, random_rows(6, n=30, leagues=("PL",), teams=4)), "m")
    continued.fold_on(m, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="not later"):
        continued.fold_on(m.limit(1), str(tmp_path / "b"), str(tmp_path / "a"))


def registry(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("t"), F.col("id")).alias("team"), F.lit("PL").alias("league"), F.lit("ENG").alias("country"),
        F.col("id").alias("matches_played"), F.col("id").alias("first_seen"))


def parts(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-") and os.path.getsize(os.path.join(path, f)))


def test_a_lost_repeated_or_altered_part_is_an_error(spark, tmp_path):
    path = str(tmp_path / "reg")
    doc_sink.write_registry(registry(spark, 50), path, part_teams=10)
    assert documents.read_registry(spark, path).count() == 50
    lost = parts(path)[2]
    text = open(lost, "rb").read()
    for wrong in (b"", text + text, text.replace(b"ENG", b"END", 1)):
        with open(lost, "wb") as file:
            file.write(wrong)
        crc = os.path.join(path, "." + os.path.basename(lost) + ".crc")
        if os.path.exists(crc):
            os.remove(crc)
        with pytest.raises(RuntimeError, match="documents that are not"):
            documents.read_registry(spark, path)
    with open(lost, "wb") as file:
        file.write(text)
    assert documents.read_registry(spark, path).count() == 50


def test_an_empty_document_set_is_read(spark, tmp_path):
    doc_sink.write_registry(registry(spark, 0), str(tmp_path / "reg"))
    assert documents.read_registry(spark, str(tmp_path / "reg")).isEmpty()


def test_the_ledger_balances_and_holds_the_lines(spark, tmp_path):
    bad = ["E0,31/13/2015,A,B,1,2", "E0,09/08/2015,A,B,x,2", "E0,09/08/2015,,B,1,2"]
    path = files(tmp_path, E0_1516=PAD + "E0,08/08/2015,A,B,1,2\n" + "\n".join(bad) + "\n\n", X9_1516=PAD + "X9,1\n" * 2, E0_1718="x")
    found = {(r.line, r.reason) for r in season_csv.ledger(season_csv.lines(spark, path)).collect()}
    assert found == {(bad[0], "unreadable date"), (bad[1], "unreadable score"), (bad[2], "a needed column is empty"),
                     (PAD.strip(), "unknown competition"), ("X9,1", "unknown competition"), ("x", "too short")}


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_season_rows_are_scanned_once_and_not_shuffled(spark, tmp_path):
    path = files(tmp_path, E0_1516=PAD + "E0,08/08/2015,A,B,1,2,x\n")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(season_csv.rows(spark, path))
        assert plan.count("FileScan text") == 1 and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        facts = plan_of(season_csv.files(season_csv.lines(spark, path)))
        # lines are hashed once; only a row per block and header is sorted
        assert facts.count("FileScan text") == 1 and facts.count("Exchange") == 2
        assert facts.index("SortAggregate") < facts.index("HashAggregate")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_extremes_and_accounting_hash(spark):
    m = written(table(spark, random_rows(7, n=40, leagues=("PL", "SA"), teams=4)), "m")
    stats = plan_of(merge.dedup_stats(m, m.limit(10)))
    assert stats.count("FileScan parquet") == 2 and "SortAggregate" not in stats
    plan = plan_of(merge.registry(m))
    below = plan[plan.index("HashAggregate"):]
    assert "SortAggregate" not in below  # the sort is over a row per team and league
    record = plan_of(profiles.team_record(m))
    scans = record.split("SortAggregate")[-1]
    assert "BroadcastHashJoin" in scans and scans.count("FileScan parquet") == 2


@pytest.mark.parametrize("bucket_rows", [1, 3, 1_000_000])
def test_numbers_by_instant(spark, bucket_rows):
    m = written(table(spark, random_rows(8, n=60, leagues=("PL", "SA"), teams=4)), "m")
    both = m.unionByName(m.withColumn("src_rank", F.lit(1)))
    got = ordinal.with_time_ordinal(both, "n", bucket_rows=bucket_rows).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 121))
    assert [tuple(r[c] for c in MATCH_ORDER) for r in got] == sorted(tuple(r[c] for c in MATCH_ORDER) for r in got)
    assert ordinal.with_time_ordinal(both.limit(0), "n").isEmpty()


def test_prefix_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(2).alias("v")).repartition(7)
    assert all(r.before == 2 * r.k for r in ordinal.prefix_sums(df, ["k"], "v", "before").collect())


def test_shared_folder_of_a_local_session(spark):
    assert shared_folder(spark)
