import pytest

from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import parse, rating

# worked by hand from the formula, to six decimals
CASES = [
    (1500.0, 1500.0, 1, 1, None, True, 1497.780810, 1502.219190),
    (1600.0, 1600.0, 2, 0, "PL", True, 1623.605048, 1576.394952),
    (1470.0, 1470.0, 0, 3, "FL1", True, 1441.158504, 1498.841496),
    (1600.0, 1470.0, 0, 1, "SA", True, 1569.342358, 1500.657642),
    (1600.0, 1600.0, 2, 0, "PL", False, 1611.247932, 1588.752068),
]


@pytest.mark.parametrize("case", CASES)
def test_worked_updates(spark, case):
    home, away, hg, ag, league, margin, home_new, away_new = case
    df = spark.createDataFrame(
        [(home, away, hg, ag, league)], "home_rating double, away_rating double, hg int, ag int, league string")
    row = rating.update_columns(df, RatingConfig(goal_margin=margin)).first()
    assert row["home_new"] == pytest.approx(home_new, abs=1e-6)
    assert row["away_new"] == pytest.approx(away_new, abs=1e-6)


def test_worked_regression(spark):
    df = spark.createDataFrame([(1623.605048,), (1576.394952,)], "r double")
    got = [r[0] for r in df.select(rating.regress("r", F.lit(1600.0), 0.15)).collect()]
    assert got == pytest.approx([1620.064291, 1579.935709], abs=1e-6)


def test_unknown_league(spark):
    c = RatingConfig()
    df = spark.createDataFrame([("XX",), (None,), ("PL",)], "league string")
    rows = df.select(rating.effective_k("league", c), rating.baseline("league", c)).collect()
    assert [tuple(r) for r in rows] == [(24.0, 1500.0), (24.0, 1500.0), (pytest.approx(27.6), 1600.0)]


def test_leading_int(spark):
    texts = ["3", "3abc", "2.5", "", "x", " 4", "-1", "+7", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse.leading_int(F.col("t"))).collect()]
    assert got == [3, 3, 2, None, None, 4, -1, 7, None]


def test_day_first_dates(spark):
    cases = {
        "1/8/16": "2016-08-01T15:00:00Z",
        "01/08/2016": "2016-08-01T15:00:00Z",
        "31/02/2020": "2020-02-31T15:00:00Z",
        "01/13/2020": None,
        "32/01/2020": None,
        "01/08/51": None,
        "01/08/50": "2050-08-01T15:00:00Z",
        "01/08/1999": None,
        "2020-08-01": None,
        "01/08": None,
        "01/08/2016/1": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", parse.iso_from_day_first(F.col("t"))).collect()}
    assert got == cases


def test_instants_roll_over(spark):
    texts = ["2020-02-31T15:00:00Z", "2021-02-31T15:00:00Z", "2020-08-01T00:00:00Z", "2023-05-01T19:45:30.500Z", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(
        F.date_format(parse.instant(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSS")).collect()]
    assert got == ["2020-03-02 15:00:00.000", "2021-03-03 15:00:00.000", "2020-08-01 00:00:00.000",
                   "2023-05-01 19:45:30.500", None]


def test_rounding_and_seasons(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.4999,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(parse.half_up(F.col("x"))).collect()] == [0, 1, 1, -1]
    row = spark.range(1).select(
        parse.season_from_code(F.lit("1516")).alias("a"), parse.season_from_year(F.lit(2023)).alias("b")).first()
    assert tuple(row) == ("2015-2016", "2023-2024")
