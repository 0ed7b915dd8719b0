"""The rating fold: ratings after every match, in order.

A match needs the ratings both teams hold after all their earlier matches, so the fold is
sequential along a team's matches. Pools of teams that never meet are independent and run as
groups of a grouped map; rows of a group arrive sorted and are streamed in Arrow batches, so a task
holds one record per team, never the group.

A pool larger than `max_group_rows` is not given to one task:

- its matches are written in order and cut into consecutive slices of at most `max_group_rows`; team
  records carry over from slice to slice through a written table, so a lost executor costs a slice.
  This gives the same bits as one task, at every size;
- on request (`wide=True`, never by size) a pool of many teams is folded in rounds that use the whole
  cluster (wide_pools.py) and agree with that to about 1e-11.

A season break only touches a team's own rating. It is therefore
applied when the team next plays, or at the end, and no group needs to see another group's matches.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderline.config import RatingConfig
from ladderline.functions import parse, rating
from ladderline.operators import breaks as season
from ladderline.operators import fold_task
from ladderline.operators.ordinal import with_ordinal
from ladderline.operators.pools import sized_pools
from ladderline.operators.wide_pools import fold_wide, round_sizes
from ladderline.schema import MATCH_ORDER, RATING_EVENTS, TEAM_STATE
from ladderline.session import discard, new_path, shuffle_partitions, written

MAX_GROUP_ROWS = 20_000_000
TASK_ROWS = 5_000_000

_INPUT = ["pool", "ts", "src_rank", "ord", "id", "date", "home", "away",
          "actual", "step", "home_base", "away_base", "break_no"]

_INPUT_TYPES = dict(zip(_INPUT, (
    "string", "timestamp", "int", "long", "long", "string", "string", "string", "double", "double", "double", "double", "int")))

cloudpickle.register_pickle_by_value(fold_task)


def _task(config: RatingConfig, breaks: dict, closing: bool, with_events: bool):
    return fold_task.folder(config.home_advantage, config.initial_rating, config.season_regression,
                            breaks, closing, with_events)


def _run(rows: DataFrame, fold, n: int) -> DataFrame:
    """Group by pool with rows in order; the grouped map reuses this partitioning and sort."""
    ordered = rows.repartition(n, "pool").sortWithinPartitions("pool", *MATCH_ORDER)
    return ordered.groupBy("pool").applyInArrow(fold, RATING_EVENTS)


def fold_input(matches: DataFrame, config: RatingConfig, registry: DataFrame | None = None) -> DataFrame:
    """The columns the fold reads; everything that does not depend on ratings is computed here."""
    if registry is None:
        home_league = away_league = F.col("league")
    else:
        # a match without a league falls back on the registry's league of the team
        known = registry.select("team", F.col("league").alias("known_league"))
        matches = (
            matches
            .join(known.toDF("home", "home_known"), "home", "left")
            .join(known.toDF("away", "away_known"), "away", "left")
        )
        own = F.nullif(F.col("league"), F.lit(""))
        home_league, away_league = F.coalesce(own, "home_known"), F.coalesce(own, "away_known")

    def base(league):
        named = F.coalesce(league, F.lit("")) != ""
        return F.when(named, rating.baseline(league, config))

    step = rating.effective_k("league", config) * rating.margin_multiplier("hg", "ag", config)
    return (
        matches
        .withColumn("actual", rating.actual_home("hg", "ag"))
        .withColumn("step", step)
        .withColumn("home_base", base(home_league))
        .withColumn("away_base", base(away_league))
        .select(*_INPUT)
    )


def _prepare_breaks(matches: DataFrame, config: RatingConfig):
    if config.season_regression == 0.0:
        return None, {}
    spans = written(season.bucket_spans(matches, config), "spans")
    return spans, season.dated_breaks(matches, spans)


def with_instants(matches: DataFrame) -> DataFrame:
    """A match without an instant has no place in the order and raises."""
    placed = F.when(F.col("ts").isNull(), F.raise_error(F.concat_ws(
        " ", F.lit("match without an instant:"), F.col("id").cast("string"), F.col("date")))).otherwise(F.col("ts"))
    return matches.withColumn("ts", placed.cast("timestamp"))


def task_count(spark, found) -> int:
    """Pools hash to tasks: a few times more tasks than pools keeps them from sharing one while pools
    are few, and with many pools a task's share of rows decides."""
    return max(shuffle_partitions(spark), min(4 * found["pools"], 10_000), -(-found["rows"] // TASK_ROWS))


def rating_fold(
    matches: DataFrame,
    config: RatingConfig = RatingConfig(),
    *,
    registry: DataFrame | None = None,
    with_events: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS,
    wide: bool = False,
) -> DataFrame:
    """Fold `matches` into rating events.

    Rows with event 'state' hold each team's final record; `with_events=False` returns only those.
    An oversized pool is cut into slices, which gives the same bits as one task. `wide` asks for
    cluster-wide rounds instead, which converge to within about 1e-11 of that and need many teams.
    A match without an instant has no place in the order and raises.
    """
    spark = matches.sparkSession
    matches = with_instants(matches)
    with ThreadPoolExecutor(2) as both:
        # two independent preparations, side by side
        found_breaks = both.submit(inheritable_thread_target(spark)(_prepare_breaks), matches, config)
        found_pools = both.submit(inheritable_thread_target(spark)(sized_pools), matches, max_group_rows)
        spans, dated = found_breaks.result()
        pooled, found = found_pools.result()
    if spans is None:
        pooled = pooled.withColumn("break_no", F.lit(0))
    else:
        pooled = season.with_break_no(pooled, config, spans)
    rows = fold_input(pooled, config, registry)
    n = task_count(spark, found)
    oversized = found["oversized"]
    if not oversized:
        return _run(rows, _task(config, dated, True, with_events), n)

    large = F.col("pool").isin(oversized)
    broad = round_sizes(rows.where(large)) if wide else {}
    narrow = [] if wide else oversized
    out = _run(rows.where(~large), _task(config, dated, True, with_events), n)
    if broad:
        out = out.unionByName(
            fold_wide(rows.where(F.col("pool").isin(list(broad))), broad, config, dated, with_events))
    if narrow:
        out = out.unionByName(
            _fold_in_slices(rows.where(F.col("pool").isin(narrow)), config, dated, with_events, max_group_rows, n))
    return out


def carrying(rows: DataFrame, records: DataFrame | None) -> DataFrame:
    """`rows` with the records of the teams that play in them; record rows have no instant and come first."""
    if records is None:
        return rows
    present = rows.select(F.explode(F.array("home", "away")).alias("team"), "pool").distinct()
    carried = records.join(present, "team").select("pool", F.col("team").alias("home"), "state")
    return rows.withColumn("state", F.lit(None).cast(TEAM_STATE)).unionByName(carried, allowMissingColumns=True)


def renewed(records: DataFrame | None, done: DataFrame) -> DataFrame:
    """Records after the folded rows `done`: theirs, and the earlier ones of teams that didn't play."""
    fresh = done.where(F.col("event") == "state").select("team", "state")
    return fresh if records is None else records.join(fresh.select("team"), "team", "left_anti").unionByName(fresh)


def closed(records: DataFrame, config: RatingConfig, dated: dict, with_events: bool, n: int) -> DataFrame:
    """State rows of all teams after the breaks that follow their last match, and those breaks' events.

    Teams no longer depend on each other: any split of them does.
    """
    final = records.select(
        F.pmod(F.xxhash64("team"), F.lit(n)).cast("string").alias("pool"), F.col("team").alias("home"), "state")
    blank = records.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in _INPUT_TYPES.items())).withColumn(
        "state", F.lit(None).cast(TEAM_STATE))
    return _run(blank.unionByName(final, allowMissingColumns=True), _task(config, dated, True, with_events), n)


def fold_slices(rows: DataFrame, records: DataFrame | None, config: RatingConfig, dated: dict, with_events: bool,
                max_group_rows: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(events, records) of pools that are cut into slices, from the `records` of earlier matches on."""
    spark = rows.sparkSession
    ordered = with_ordinal(rows, ["pool", *MATCH_ORDER], "position", "fold-order")
    starts = ordered.groupBy("pool").agg(F.min("position").alias("start"))
    # one row per oversized pool
    ordered = ordered.join(F.broadcast(starts), "pool").withColumn(
        "slice", F.floor((F.col("position") - F.col("start")) / F.lit(max_group_rows)).cast("int"))
    sliced_path = new_path(spark, "fold-slices")
    ordered.drop("position", "start").write.partitionBy("slice").parquet(sliced_path)
    sliced = spark.read.parquet(sliced_path)
    last_slice = sliced.agg(F.max("slice")).first()[0]

    out_root = new_path(spark, "fold-events")
    fold = _task(config, dated, False, with_events)
    path = None
    for number in range(last_slice + 1):
        part = carrying(sliced.where(F.col("slice") == number).select(*_INPUT), records)
        done = written(_run(part, fold, n), "fold-slice", f"{out_root}/slice={number}")
        following = new_path(spark, "fold-records")
        records = written(renewed(records, done), "", following)
        if path:
            discard(spark, path)
        path = following
    discard(spark, sliced_path)
    events = spark.read.schema(RATING_EVENTS).parquet(
        *[f"{out_root}/slice={number}" for number in range(last_slice + 1)])
    return events.where(F.col("event") != "state"), records


def _fold_in_slices(rows, config, dated, with_events, max_group_rows, n) -> DataFrame:
    events, records = fold_slices(rows, None, config, dated, with_events, max_group_rows, n)
    return events.unionByName(closed(records, config, dated, with_events, n))


def rating_events(fold: DataFrame) -> DataFrame:
    """Match and regression events, one row per change of a team's rating."""
    return (
        fold.where(F.col("event") != "state").drop("state")
        .withColumn("date", parse.day_of(F.col("date")))
    )


def final_states(fold: DataFrame) -> DataFrame:
    """One row per team: final rating and record."""
    return fold.where(F.col("event") == "state").select(
        "team", "state.rating",
        (F.col("state.wins") + F.col("state.draws") + F.col("state.losses")).alias("matches"),
        "state.wins", "state.draws", "state.losses",
        F.col("state.last_date").alias("last_updated"),
        "state.first_ts", "state.first_src_rank", "state.first_ord", "state.first_side",
    )


FIRST_SEEN = ["first_ts", "first_src_rank", "first_ord", "first_side"]
