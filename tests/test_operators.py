import datetime

import pytest

from pyspark.sql import functions as F

from helpers import table
from ladderline import fixed_values as fv
from ladderline.functions import labels
from ladderline.operators import agreement, merge, profiles, rankings, summary
from ladderline.operators.ordinal import with_ordinal


def day(n):
    return (datetime.date(2020, 1, 1) + datetime.timedelta(days=n)).isoformat() + "T12:00:00Z"


def test_merge_prefers_the_second_source_and_keeps_repeats(spark):
    hist = table(spark, [(1, day(0), "PL", "a", "b", 1, 0), (2, day(0), "PL", "a", "b", 1, 0),
                         (3, day(1), "PL", "a", "b", 1, 0), (4, day(2), "PL", "b", "a", 1, 0)])
    api = table(spark, [(9, day(0)[:11] + "23:00:00Z", "PL", "a", "b", 2, 2), (8, day(2), "PL", "a", "b", 0, 0),
                        (7, day(2), "PL", "a", "b", 0, 0)])
    got = merge.chronological(merge.merged(hist, api)).collect()
    assert [r["id"] for r in got] == [9, 3, 4, 8, 7]
    stats = {r["source"]: (r["rows"], r["kept"], r["removed"]) for r in merge.dedup_stats(hist, api).collect()}
    assert stats == {"historical": (4, 2, 2), "api": (3, 3, 0)}


def test_registry_keeps_the_first_league(spark):
    m = table(spark, [(1, day(5), "SA", "a", "b", 1, 0), (2, day(0), "PL", "c", "a", 1, 0), (3, day(0), "XX", "b", "a", 1, 0)])
    got = {r["team"]: (r["league"], r["country"], r["matches_played"]) for r in merge.registry(m).collect()}
    assert got == {"a": ("PL", "ENG", 3), "c": ("PL", "ENG", 1), "b": ("XX", None, 2)}


def test_summaries(spark):
    m = table(spark, [(1, day(0), "PL", "a", "b", 1, 0), (2, day(9), "PL", "a", "c", 1, 0)]).withColumn(
        "season", F.lit("2019-2020"))
    totals = {r["league"]: (r["total"], r["parts"]) for r in summary.league_totals(m).collect()}
    assert totals["PL"] == (2, "2019: 2") and totals["FL1"] == (0, "") and len(totals) == 5
    assert tuple(summary.date_range(m).first()) == ("2020-01-01", "2020-01-10", "2020-2020")
    assert summary.date_range(m.limit(0)).isEmpty()
    assert summary.distinct_teams(m).first()[0] == 3


@pytest.mark.parametrize("parts", [1, 5])
def test_ordinals(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(parts)
    got = with_ordinal(df, [F.desc("v")], "n").collect()
    assert len(got) == 1000 and all(r["n"] == 1000 - r["v"] for r in got)
    assert with_ordinal(df.where("v < 0"), ["v"], "n").isEmpty()


@pytest.mark.parametrize("as_of,months,start", [
    (datetime.date(2024, 5, 31), 3, "2024-03-02"), (datetime.date(2023, 5, 31), 3, "2023-03-03"),
    (datetime.date(2024, 5, 15), 3, "2024-02-15"), (datetime.date(2024, 2, 29), 12, "2023-03-01"),
    (datetime.date(2024, 1, 31), 6, "2023-07-31")])
def test_range_starts_overflow(spark, as_of, months, start):
    assert spark.range(1).select(profiles.range_start(as_of, months)).first()[0] == start


def test_chart_bounds_of_an_empty_range(spark):
    daily = spark.createDataFrame([("a", "2020-01-01", 1501.0), ("a", "2020-01-02", 1510.0)],
                                  "team string, date string, rating double")
    got = {r["range"]: (r["axis_min"], r["axis_max"])
           for r in profiles.chart_bounds(daily, datetime.date(2024, 1, 31)).collect()}
    assert got == {"3M": (None, None), "6M": (None, None), "1Y": (None, None), "All": (1480, 1530)}


def test_peak_takes_the_first_occurrence(spark):
    events = spark.createDataFrame(
        [("a", 1, "d1", 1.0), ("a", 2, "d2", 3.0), ("a", 3, "d3", 3.0), ("a", 4, "d4", 1.0)],
        "team string, seq long, date string, rating_after double")
    states = spark.createDataFrame([("a", 1.0), ("b", 7.0)], "team string, rating double")
    got = {r["team"]: tuple(r)[1:] for r in profiles.peak_low(states, events).collect()}
    assert got == {"a": (3.0, "d2", 1.0, "d1"), "b": (7.0, "", 7.0, "")}


def test_history_pages(spark):
    events = spark.createDataFrame([("a", i, f"d{i}", float(i)) for i in range(1, 8)],
                                   "team string, seq long, date string, rating_after double")
    got = profiles.rating_history(events, page=3).orderBy("page").collect()
    assert [[e["rating"] for e in r["history"]] for r in got] == [[1, 2, 3], [4, 5, 6], [7]]


def test_recent_form_uses_the_last_of_equal_ids(spark):
    m = table(spark, [(5, day(0), "PL", "a", "b", 1, 0), (5, day(1), "PL", "a", "b", 0, 5)])
    form = profiles.recent_form(m).where("team = 'a'").orderBy("place").collect()
    assert [(r["score"], r["result"], r["home_away"]) for r in form] == [("1-0", "W", "H"), ("0-5", "L", "H")]
    assert form[0]["rating_change"] == form[1]["rating_change"] < 0


def test_recent_form_is_limited(spark):
    m = table(spark, [(i, day(i), "PL", "a", f"o{i % 3}", 1, 0) for i in range(25)])
    form = profiles.recent_form(m).where("team = 'a'").orderBy("place").collect()
    assert [r["place"] for r in form] == list(range(1, 11))
    assert [r["date"] for r in form] == [day(i)[:10] for i in range(15, 25)]


def states(spark, rows):
    return spark.createDataFrame(
        [(t, r, i) for i, (t, r) in enumerate(rows)], "team string, rating double, first_ord long").selectExpr(
        "team", "rating", "timestamp'2020-01-01' as first_ts", "0 as first_src_rank", "first_ord", "0 as first_side",
        "1L as wins", "2L as draws", "3L as losses", "'2020-01-01T15:00:00Z' as last_updated")


def registry(spark, rows):
    return spark.createDataFrame([(t, lg, fv.LEAGUE_COUNTRY.get(lg), 1) for t, lg in rows],
                                 "team string, league string, country string, matches_played long")


def test_ranking_tables(spark):
    s = states(spark, [("a", 1500.5), ("b", 1700.0), ("c", 1500.5), ("d", 1400.0)])
    reg = registry(spark, [("a", "PL"), ("b", "XX"), ("d", "PL")])
    ranked = rankings.ranked(s)
    shown = [tuple(r) for r in rankings.display(ranked, reg).orderBy("rank").collect()]
    assert shown == [(1, "b", "XX", 1700, "1-2-3", "2020-01-01"), (2, "a", "ENG", 1501, "1-2-3", "2020-01-01"),
                     (3, "c", "???", 1501, "1-2-3", "2020-01-01"), (4, "d", "ENG", 1400, "1-2-3", "2020-01-01")]
    full = rankings.with_registry(ranked, reg)
    assert {r["team"]: (r["league"], r["country"]) for r in full.collect()} == {
        "a": ("PL", "ENG"), "b": ("XX", "?"), "c": ("?", "?"), "d": ("PL", "ENG")}
    assert [(r["team"], r["league_rank"]) for r in rankings.league_ranks(full).where("league = 'PL'").orderBy("rank").collect()] == [
        ("a", 1), ("d", 2)]
    assert [r["team"] for r in rankings.of_league(full, "PL").orderBy("rank").collect()] == ["a", "d"]
    assert rankings.of_league(full, "ALL").count() == 4
    assert [tuple(r)[1:] for r in rankings.league_averages(full).orderBy("position").collect()] == [
        ("ENG", 1450), ("ESP", 0), ("GER", 0), ("ITA", 0), ("FRA", 0)]
    assert [r["country"] for r in rankings.league_averages(full, fill_missing=False).collect()] == ["ENG"]


def found(spark, rows):
    ranking = spark.createDataFrame([(f"R{i}", 2000 - i, i) for i in range(1, 6)], "ref_team string, ref_elo int, ref_rank int")
    names = spark.createDataFrame([("a", "R1"), ("a2", "R1"), ("b", "R2"), ("c", "R3")], "team string, ref_team string")
    ranked = spark.createDataFrame([(t, r, i + 1) for i, (t, r) in enumerate(rows)], "team string, rating double, rank long")
    return agreement.matched(ranked, ranking, names), ranking


def test_matching_takes_the_worse_of_two_and_own_names(spark):
    got, ranking = found(spark, [("b", 1700.0), ("a", 1650.0), ("R4", 1600.0), ("a2", 1600.0), ("z", 1.0)])
    assert [(r["ref_team"], r["rank"], r["rating"], r["local_rank"]) for r in got.orderBy("local_rank").collect()] == [
        ("R2", 1, 1700.0, 1), ("R1", 4, 1600.0, 2), ("R4", 3, 1600.0, 3)]
    compared = {r["ref_team"]: (r["local_rank"], r["rank_diff"]) for r in agreement.compare(got, ranking).collect()}
    assert compared == {"R1": (2, 1), "R2": (1, -1), "R3": (None, None), "R4": (3, -1), "R5": (None, None)}
    assert agreement.rank_error(got).first()[0] == pytest.approx(1.0)
    assert tuple(agreement.top_overlap(got, 2).first()) == (3, 2)


@pytest.mark.parametrize("rows,expected", [
    ([], 0.0), ([("a", 1.0)], 0.0), ([("a", 3.0), ("b", 2.0), ("c", 1.0)], 1.0),
    ([("c", 3.0), ("b", 2.0), ("a", 1.0)], -1.0),
    # equal ratings rank by position, not by their mean
    ([("a", 2.0), ("b", 2.0)], -1.0)])
def test_rank_correlation(spark, rows, expected):
    got, _ = found(spark, rows)
    assert agreement.spearman(got).first()["spearman"] == pytest.approx(expected)


def test_before_and_after(spark):
    old, ranking = found(spark, [("b", 2.0), ("a", 1.0)])
    new, _ = found(spark, [("a", 2.0), ("c", 1.0)])
    got = {r["ref_team"]: (r["old_rank"], r["new_rank"], r["change"], r["change_label"], r["key_team"])
           for r in agreement.before_after(old, new, ranking, ["R1"]).collect()}
    assert got == {"R1": (2, 1, 1, "+1", True), "R2": (1, 0, 1, "+1", False), "R3": (0, 2, -2, "-2", False),
                   "R4": (0, 0, 0, "=", False), "R5": (0, 0, 0, "=", False)}


def test_ordinal_ranks_and_labels(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (3, 5.0), (4, 1.0)], "p int, v double")
    up = agreement.assign_ranks(df, "v", "p", "r")
    down = agreement.assign_ranks(df, "v", "p", "r", ascending=False)
    assert [r["r"] for r in up.orderBy("p").collect()] == [3, 2, 4, 1]
    assert [r["r"] for r in down.orderBy("p").collect()] == [1, 3, 2, 4]
    moves = spark.createDataFrame([(3, 1), (1, 3), (2, 2)], "o int, n int")
    assert [r[0] for r in moves.select(labels.movement(F.col("o"), F.col("n"))).collect()] == [
        "IMPROVED", "dropped", "unchanged"]


def test_external_tables(spark):
    assert agreement.external_ranking(spark).count() == 20
    assert agreement.external_names(spark).count() == 20
    ranked = spark.createDataFrame([("Arsenal FC", 2000.4, 2), ("Nobody", 1.0, 3)], "team string, rating double, rank long")
    got = agreement.rating_difference(ranked, agreement.external_ranking(spark), agreement.external_names(spark)).collect()
    assert [tuple(r) for r in got] == [("Arsenal FC", "Arsenal", -52, 1)]
