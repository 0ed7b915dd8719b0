"""The read side: what the rankings view, the team view and the validation report show.

Team views come for all teams at once; a single team is a filter on `team`.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline import fixed_values as fv
from ladderline.operators import agreement, profiles, rankings
from ladderline.plans.rate import Ratings


def rankings_view(ratings: Ratings, registry: DataFrame, league: str = "ALL", limit: int | None = rankings.TOP
                  ) -> dict[str, DataFrame]:
    teams = rankings.with_registry(ratings.ranked, registry)
    shown = rankings.of_league(teams, league)
    if league != "ALL":
        shown = rankings.league_ranks(shown).withColumn("rank", F.col("league_rank"))
    if limit is not None:
        shown = shown.orderBy("rank").limit(limit)
    return {
        "headline": rankings.headline(ratings.ranked, ratings.matches, registry),
        "ranking": shown,
        "league_averages": rankings.league_averages(teams),
    }


def team_view(ratings: Ratings, registry: DataFrame, as_of: datetime.date) -> dict[str, DataFrame]:
    spark = ratings.matches.sparkSession
    daily = profiles.daily_snapshot(ratings.events)
    return {
        "header": rankings.league_names(ratings.ranked, registry).join(
            ratings.ranked.select("team", "rating", "rank", "wins", "draws", "losses"), "team"),
        "peak_low": profiles.peak_low(ratings.ranked, ratings.events),
        "win_rate": profiles.win_rate(ratings.ranked),
        "history": profiles.history_range(daily, as_of),
        "chart_bounds": profiles.chart_bounds(daily, as_of),
        "recent_form": profiles.recent_form(ratings.matches, ratings.config),
        "external": agreement.rating_difference(
            ratings.ranked, agreement.external_ranking(spark), agreement.external_names(spark)),
    }


def validation(ranked: DataFrame, old_ranked: DataFrame | None = None, ranking: DataFrame | None = None,
               names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Agreement with the external ranking, and with an earlier run when there is one."""
    spark = ranked.sparkSession
    ranking = agreement.external_ranking(spark) if ranking is None else ranking
    names = agreement.external_names(spark) if names is None else names
    found = agreement.matched(ranked, ranking, names)
    out = {
        "comparison": agreement.compare(found, ranking),
        "spearman": agreement.spearman(found),
        "rank_error": agreement.rank_error(found),
        "top_overlap": agreement.top_overlap(found),
    }
    if old_ranked is not None:
        old = agreement.matched(old_ranked, ranking, names)
        out["before_after"] = agreement.before_after(old, found, ranking, fv.KEY_TEAMS)
        out["spearman_delta"] = agreement.spearman_delta(old, found)
        out["movements"] = agreement.movements(old_ranked, ranked)
    return out
