"""The rating fold for pools with very many teams.

One pool may hold a third of all matches. When its matches spread over many teams, each team plays
few of them, and the fold can use the whole cluster: the matches are cut into consecutive rounds in
which a team plays at most about `ROUND_MATCHES` matches, and inside a round all ratings are found
together. Start from the ratings at the beginning of the round, compute every match's rating change
from the current ratings before the match, sum those changes up along each team's matches to get new
ratings before each match, and repeat. This is waveform relaxation (Picard iteration) of a
recurrence with one solution, the sequential fold. After n repetitions every match is right that has
fewer than n matches behind it in the round, so the repetition ends; changes shrink much faster than
that because one result moves a rating by little, and it stops when no rating moves any more by
more than `TOLERANCE`.

A repetition is two windows, one over the two sides of a match and one over a team's matches of the
round, both on keys with few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import rating as formula
from ladderline.operators.ordinal import with_ordinal
from ladderline.schema import MATCH_ORDER, RATING_EVENTS, TEAM_STATE
from ladderline.session import new_path, written

ROUND_MATCHES = 32
STEPS_PER_JOB = 4
TOLERANCE = 1e-10

_RECORD = [f.name for f in TEAM_STATE.fields]


def round_sizes(rows: DataFrame) -> dict[str, int]:
    """Per pool how many matches a round takes so that its busiest team plays about ROUND_MATCHES.

    Called for oversized pools only, of which there are few.
    """
    per_team = (
        rows.select("pool", F.explode(F.array("home", "away")).alias("team"))
        .groupBy("pool", "team").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pool").agg(F.max("n").alias("busiest"), F.sum("n").alias("appearances"))
    )
    return {r["pool"]: max(1, r["appearances"] // 2 // -(-r["busiest"] // ROUND_MATCHES)) for r in per_team.collect()}


def fold_wide(rows: DataFrame, sizes: dict[str, int], config: RatingConfig, breaks: dict, with_events: bool
              ) -> DataFrame:
    """Rating events and final states of the pools in `sizes`."""
    spark = rows.sparkSession
    rounds = _cut(rows, sizes)
    order = rounds.select("break_no", "round").distinct().orderBy("break_no", "round").collect()
    match_root, break_root = new_path(spark, "wide-matches"), new_path(spark, "wide-breaks")
    match_events: list[str] = []
    break_events: list[str] = []

    def regressed(records: DataFrame, number: int) -> DataFrame:
        day, instant = breaks[number]
        break_events.append(f"{break_root}/number={number}")
        return written(_regress(records, number, day, instant, config), "break", break_events[-1])

    records, applied = None, 0
    for break_no, number in (tuple(r) for r in order):
        part = rounds.where((F.col("break_no") == break_no) & (F.col("round") == number))
        for passed in range(applied + 1, break_no + 1) if records is not None else ():
            records = regressed(records, passed)
        applied = break_no
        opening = written(_opening(part, records, config), "round-opening")
        match_events.append(f"{match_root}/at={len(match_events)}")
        played = written(_played(part, _relax(part, opening, config), opening), "round", match_events[-1])
        fresh = _records(played, opening, break_no)
        if records is not None:
            old = records.select(fresh.columns).join(fresh.select("team"), "team", "left_anti")
            fresh = old.unionByName(fresh)
        records = written(fresh, "round-records")
    for passed in range(applied + 1, max(breaks, default=0) + 1):
        records = regressed(records, passed)
    out = _as_events(records.select(
        "team", F.lit("state").alias("event"), "seq", F.col("rating").alias("rating_after"),
        F.struct(*_RECORD).alias("state")))
    if not with_events:
        return out
    out = out.unionByName(_as_events(spark.read.schema(played.schema).parquet(*match_events)))
    if break_events:
        out = out.unionByName(_as_events(spark.read.parquet(*break_events).select(
            "team", F.lit("regress").alias("event"), "seq", F.col("day").alias("date"), "ts", "rating_before",
            F.col("rating").alias("rating_after"))))
    return out


def _as_events(df: DataFrame) -> DataFrame:
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RATING_EVENTS.fields])


def _cut(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Rows with their `position` in the pool's order and `round`, written by break and round."""
    ordered = with_ordinal(rows, ["pool", *MATCH_ORDER], "position", "wide-order")
    starts = ordered.groupBy("pool").agg(F.min("position").alias("start"))
    size = formula.lookup({pool: float(n) for pool, n in sizes.items()}, "pool")
    path = new_path(rows.sparkSession, "wide-rounds")
    (
        # one row per oversized pool
        ordered.join(F.broadcast(starts), "pool")
        .withColumn("round", F.floor((F.col("position") - F.col("start")) / size).cast("int"))
        .drop("start").write.partitionBy("break_no", "round").parquet(path)
    )
    return rows.sparkSession.read.parquet(path)


def _sides(part: DataFrame) -> DataFrame:
    own = F.col("home") == F.col("away")
    return part.select("position", "actual", "step", own.alias("own"), F.explode(F.array(
        F.struct(F.col("home").alias("team"), F.lit(0).alias("side"), F.col("home_base").alias("base")),
        F.struct(F.col("away").alias("team"), F.lit(1).alias("side"), F.col("away_base").alias("base")),
    )).alias("s")).select("position", "actual", "step", "own", "s.*")


def _opening(part: DataFrame, records: DataFrame | None, config: RatingConfig) -> DataFrame:
    """Records of the round's teams as it begins; teams new to the pool start from their base."""
    met = _sides(part).groupBy("team").agg(
        F.min_by("base", "position").alias("base"),
        F.min_by("base", F.when(F.col("base").isNotNull(), F.col("position"))).alias("known_base"))
    if records is None:
        known = met.select("team", "base", "known_base", *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in TEAM_STATE.fields])
    else:
        known = met.join(records, "team", "left")
    zero = F.lit(0).cast("long")
    return known.select(
        "team",
        F.coalesce("rating", "base", F.lit(config.initial_rating)).alias("rating"),
        F.coalesce("mean", "known_base").alias("mean"),
        *[F.coalesce(c, zero).alias(c) for c in ("seq", "wins", "draws", "losses")],
        "first_ts", "first_src_rank", "first_ord", "first_side")


def _changes(current: DataFrame, config: RatingConfig) -> DataFrame:
    """Adds `delta`, each side's rating change given the ratings `before`."""
    match = W.partitionBy("position")  # two rows
    home = F.max(F.when(F.col("side") == 0, F.col("before"))).over(match)
    away = F.max(F.when(F.col("side") == 1, F.col("before"))).over(match)
    expected = formula.expected_home(home, away, config)
    return current.withColumn("expected", expected).withColumn(
        "delta",
        # a team meeting itself keeps the away side's change only
        F.when((F.col("side") == 0) & F.col("own"), 0.0)
        .when(F.col("side") == 0, F.col("step") * (F.col("actual") - F.col("expected")))
        .otherwise(F.col("step") * ((F.lit(1.0) - F.col("actual")) - (F.lit(1.0) - F.col("expected")))),
    ).drop("expected")


def _relax(part: DataFrame, opening: DataFrame, config: RatingConfig) -> DataFrame:
    """The round's sides with the settled rating `before` each match."""
    earlier = W.partitionBy("team").orderBy("position", "side").rowsBetween(W.unboundedPreceding, -1)
    current = (
        _sides(part).drop("base").join(opening.select("team", F.col("rating").alias("start")), "team")
        .withColumn("before", F.col("start")).withColumn("previous", F.col("start"))
    )
    while True:
        for _ in range(STEPS_PER_JOB):
            moved = F.coalesce(F.sum("delta").over(earlier), F.lit(0.0))
            current = (
                _changes(current.withColumn("previous", F.col("before")), config)
                .withColumn("before", F.col("start") + moved).drop("delta")
            )
        current = written(current, "round-step")
        if current.agg(F.max(F.abs(F.col("before") - F.col("previous")))).first()[0] <= TOLERANCE:
            return _changes(current, config)


def _played(part: DataFrame, settled: DataFrame, opening: DataFrame) -> DataFrame:
    """Match events of the round, with `score` for the records."""
    nth = F.row_number().over(W.partitionBy("team").orderBy("position", "side"))
    total = F.sum("delta").over(W.partitionBy("position"))
    # both sides of a team meeting itself end at the same rating
    after = F.col("before") + F.when(F.col("own"), total).otherwise(F.col("delta"))
    score = F.when(F.col("side") == 0, F.col("actual")).otherwise(F.lit(1.0) - F.col("actual"))
    numbered = settled.withColumns({"nth": nth, "rating_after": after, "score": score})
    return (
        numbered.join(opening.select("team", "seq"), "team")
        .join(part.select("position", F.col("id").alias("match_id"), "date", *MATCH_ORDER), "position")
        .select("team", F.lit("match").alias("event"), (F.col("seq") + F.col("nth")).alias("seq"), "date", "match_id",
                "side", *MATCH_ORDER, F.col("before").alias("rating_before"), "rating_after", "score")
    )


def _records(played: DataFrame, opening: DataFrame, break_no: int) -> DataFrame:
    gained = played.groupBy("team").agg(
        F.max_by("rating_after", "seq").alias("new_rating"), F.max("seq").alias("new_seq"),
        F.count_if(F.col("score") == 1.0).alias("w"), F.count_if(F.col("score") == 0.5).alias("d"),
        F.count_if(F.col("score") == 0.0).alias("l"), F.max_by("date", "seq").alias("last_date"),
        F.min(F.struct(*MATCH_ORDER, "side")).alias("f"))
    first = {
        "first_ts": F.col("f.ts"), "first_src_rank": F.col("f.src_rank"), "first_ord": F.col("f.ord"),
        "first_side": F.col("f.side")}
    return opening.join(gained, "team").select(
        "team", F.col("new_rating").alias("rating"), F.col("new_seq").alias("seq"), F.lit(break_no).alias("break_no"),
        "mean", (F.col("wins") + F.col("w")).alias("wins"), (F.col("draws") + F.col("d")).alias("draws"),
        (F.col("losses") + F.col("l")).alias("losses"), "last_date",
        *[F.coalesce(name, c).alias(name) for name, c in first.items()])


def _regress(records: DataFrame, number: int, day: str, instant: int, config: RatingConfig) -> DataFrame:
    """Apply one season break to every record; `rating_before`, `day` and `ts` describe the event."""
    mean = F.coalesce("mean", F.lit(config.initial_rating))
    return records.select("team", *_RECORD).withColumn("rating_before", F.col("rating")).withColumns({
        "rating": formula.regress("rating", mean, config.season_regression),
        "seq": F.col("seq") + 1, "break_no": F.lit(number),
        "day": F.lit(day), "ts": F.expr(f"timestamp_micros({instant})")})
