"""From the match table to rating events, rankings and their documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ladderline.config import RatingConfig
from ladderline.operators import fold, profiles, rankings
from ladderline.session import prepare, written
from ladderline.sinks import documents


@dataclass(frozen=True)
class Ratings:
    """A rated match table: ranked teams and the events behind them, both written tables."""

    matches: DataFrame
    ranked: DataFrame
    events: DataFrame
    config: RatingConfig


def rate(matches: DataFrame, config: RatingConfig = RatingConfig(), registry: DataFrame | None = None) -> Ratings:
    prepare(matches.sparkSession)
    done = written(fold.rating_fold(matches, config, registry=registry), "rating-events")
    ranked = written(rankings.ranked(fold.final_states(done)), "ranked")
    return Ratings(matches, ranked, fold.rating_events(done), config)


def publish(ratings: Ratings, computed_at: str, ratings_out: str, daily_out: str) -> None:
    """Write the ratings and daily documents. `computed_at` is given, so that runs can be repeated."""
    documents.write_ratings(
        ratings.ranked, ratings.events, ratings.matches.count(), computed_at, ratings.config, ratings_out)
    documents.write_daily(ratings.ranked, profiles.daily_snapshot(ratings.events), daily_out)
