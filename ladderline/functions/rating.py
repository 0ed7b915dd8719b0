"""The rating formula as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ladderline.config import RatingConfig


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(values: dict, key_type: str = "string", value_type: str = "double") -> Column:
    """A small constant dictionary inside the plan, so that looking it up needs no join."""
    if not values:
        return F.expr(f"cast(map() as map<{key_type},{value_type}>)")
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict, key: Column | str, value_type: str = "double") -> Column:
    return F.try_element_at(literal_map(values, value_type=value_type), _col(key))


def expected_home(home_rating, away_rating, config: RatingConfig) -> Column:
    gap = (_col(away_rating) - _col(home_rating) - F.lit(config.home_advantage)) / F.lit(400.0)
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), gap))


def actual_home(hg, ag) -> Column:
    hg, ag = _col(hg), _col(ag)
    return F.when(hg > ag, 1.0).when(hg < ag, 0.0).otherwise(0.5)


def margin_multiplier(hg, ag, config: RatingConfig) -> Column:
    if not config.goal_margin:
        return F.lit(1.0)
    return F.lit(1.0) + F.ln(F.abs(_col(hg) - _col(ag)) + F.lit(1))


def league_multiplier(league, config: RatingConfig) -> Column:
    return F.coalesce(lookup(config.league_strength, league), F.lit(1.0))


def effective_k(league, config: RatingConfig) -> Column:
    return F.lit(config.k_factor) * league_multiplier(league, config)


def baseline(league, config: RatingConfig) -> Column:
    return F.coalesce(lookup(config.league_baseline, league), F.lit(config.initial_rating))


def regress(rating, mean, factor: float = 0.1) -> Column:
    rating, mean = _col(rating), _col(mean)
    return rating + F.lit(factor) * (mean - rating)


def update_columns(df, config: RatingConfig, home_rating="home_rating", away_rating="away_rating",
                   hg="hg", ag="ag", league="league"):
    """Single-match update on a table that already holds both ratings."""
    step = effective_k(league, config) * margin_multiplier(hg, ag, config)
    return (
        df.withColumn("home_expected", expected_home(home_rating, away_rating, config))
        .withColumn("away_expected", F.lit(1.0) - F.col("home_expected"))
        .withColumn("home_new", F.col(home_rating) + step * (actual_home(hg, ag) - F.col("home_expected")))
        .withColumn("away_new", F.col(away_rating)
                    + step * ((F.lit(1.0) - actual_home(hg, ag)) - F.col("away_expected")))
    )
