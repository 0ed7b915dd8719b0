"""Small match tables and a plain sequential replay to compare with."""

import math

from pyspark.sql import functions as F

from ladderline.functions import parse
from ladderline.schema import MATCHES


def table(spark, rows):
    """rows: (id, date, league, home, away, hg, ag) in input order."""
    shaped = [
        (r[0], r[1], r[2], "s", r[3], r[4], r[5], r[6], 0, 0, i) for i, r in enumerate(rows)
    ]
    schema = ("id long, date string, league string, season string, home string, away string, hg int, ag int, "
              "matchday int, src_rank int, ord long")
    df = spark.createDataFrame(shaped, schema).withColumn("ts", parse.instant(F.col("date")))
    return df.select(*MATCHES.fieldNames())


def _ms(date):
    import datetime

    d = datetime.datetime.fromisoformat(date.replace("Z", "+00:00"))
    return d.timestamp() * 1000


def replay(rows, config):
    """Every match in order over one dictionary; (final ratings, events per team)."""
    ordered = sorted(enumerate(rows), key=lambda x: (_ms(x[1][1]), x[0]))
    rating, mean, events, previous = {}, {}, {}, None
    for _, (mid, date, league, home, away, hg, ag) in ordered:
        now = _ms(date)
        if previous is not None and now - previous >= config.gap_ms and config.season_regression:
            for team in rating:
                target = config.initial_rating if mean[team] is None else mean[team]
                rating[team] += config.season_regression * (target - rating[team])
                events[team].append(("regress", date[:10], None, rating[team]))
        previous = now
        base = config.league_baseline.get(league, config.initial_rating) if league else None
        for team in (home, away):
            if team not in rating:
                rating[team] = config.initial_rating if base is None else base
                mean[team], events[team] = base, []
            elif mean[team] is None:
                mean[team] = base
        rh, ra = rating[home], rating[away]
        e = 1 / (1 + math.pow(10, (ra - rh - config.home_advantage) / 400))
        s = 1.0 if hg > ag else 0.0 if hg < ag else 0.5
        k = config.k_factor * config.league_strength.get(league, 1.0)
        k *= 1 + math.log(abs(hg - ag) + 1) if config.goal_margin else 1.0
        rating[home] = rh + k * (s - e)
        rating[away] = ra + k * ((1 - s) - (1 - e))
        for team in (home, away):
            events[team].append(("match", date[:10], mid, rating[team]))
    return rating, events
