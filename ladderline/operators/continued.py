"""Rating runs that go on from where an earlier run stopped.

A run's folder holds everything a later run needs: the record of every team after its last match, the
season breaks so far, and the place of the last match. Later matches alone are read and folded; the
result is that of one fold over all matches, bit for bit. A match at or before the last one of the
earlier run would change what is already folded, so it raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline.config import RatingConfig
from ladderline.operators import breaks as season
from ladderline.operators.fold import (
    MAX_GROUP_ROWS, _run, _task, carrying, closed, fold_input, fold_slices, renewed, task_count, with_instants)
from ladderline.operators.pools import sized_pools
from ladderline.schema import MATCH_ORDER, RATING_EVENTS, TEAM_STATE
from ladderline.session import shuffle_partitions, written

_RECORDS = T.StructType([T.StructField("team", T.StringType()), T.StructField("state", TEAM_STATE)])
_BREAKS = "break_no int, day string, us long"
_MARK = "ts timestamp, src_rank int, ord long, break_no int"


def _read(spark: SparkSession, path: str, part: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{part}")


def fold_on(matches: DataFrame, path: str, previous: str | None = None, config: RatingConfig = RatingConfig(), *,
            registry: DataFrame | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Fold `matches` after the run in folder `previous`, write the run's folder `path`, return the new events.

    Events are matches and the breaks before them; those after each team's last match come from
    `final_fold`. Without new matches the records are handed on. The configuration must stay the same.
    """
    spark = matches.sparkSession
    matches = with_instants(matches)
    records, dated, mark = None, {}, None
    if previous is not None:
        records = _read(spark, previous, "records", _RECORDS)
        # at most one break per gap length of the time covered
        dated = {r.break_no: (r.day, r.us) for r in _read(spark, previous, "breaks", _BREAKS).collect()}
        mark = _read(spark, previous, "mark", _MARK).first()
    if mark is not None:
        at = F.struct(*[F.lit(mark[c]).cast(kind).alias(c) for c, kind in zip(MATCH_ORDER, ("timestamp", "int", "long"))])
        late = matches.where(F.struct(*[F.col(c).cast(k).alias(c) for c, k in zip(MATCH_ORDER, ("timestamp", "int", "long"))]) <= at).head(1)
        if late:
            raise ValueError(f"match {late[0].id} of {late[0].date} is not later than the run it continues")
    passed = mark.break_no if mark else 0
    pooled, found = sized_pools(matches, max_group_rows)
    if config.season_regression == 0.0:
        pooled = pooled.withColumn("break_no", F.lit(0))
    else:
        spans = written(season.bucket_spans(matches, config, (mark.ts, passed) if mark else None), "spans")
        dated = dated | season.dated_breaks(matches, spans)
        pooled = season.with_break_no(pooled, config, spans)
    rows, n = fold_input(pooled, config, registry), task_count(spark, found)
    large = F.col("pool").isin(found["oversized"])
    done = written(_run(carrying(rows.where(~large), records), _task(config, dated, False, True), n), "fold-done")
    events = done.where(F.col("event") != "state")
    latest = renewed(records, done)
    if found["oversized"]:
        more, sliced = fold_slices(rows.where(large), records, config, dated, True, max_group_rows, n)
        events = events.unionByName(more)
        # slices hand on every record; those of teams of the other pools are the fresh ones
        played = done.where(F.col("event") == "state").select("team", "state")
        latest = sliced.join(played.select("team"), "team", "left_anti").unionByName(played)
    written(latest, "", f"{path}/records")
    written(spark.createDataFrame([(k, *v) for k, v in sorted(dated.items())], _BREAKS), "", f"{path}/breaks")
    last = matches.agg(F.max(F.struct(*MATCH_ORDER)).alias("last")).where("last IS NOT NULL").select(
        *[F.col(f"last.{c}").alias(c) for c in MATCH_ORDER], F.lit(max(dated, default=0)).alias("break_no"))
    kept = spark.createDataFrame([mark] if mark else [], _MARK)
    written(last if not mark else last.unionByName(kept).orderBy(*[F.desc(c) for c in MATCH_ORDER]).limit(1), "", f"{path}/mark")
    return written(events, "", f"{path}/events")


def final_fold(spark: SparkSession, paths: list[str], config: RatingConfig = RatingConfig()) -> DataFrame:
    """What one fold over the matches of all runs gives; `paths` are the runs' folders in order."""
    events = spark.read.schema(RATING_EVENTS).parquet(*[f"{p}/events" for p in paths])
    dated = {r.break_no: (r.day, r.us) for r in _read(spark, paths[-1], "breaks", _BREAKS).collect()}
    records = _read(spark, paths[-1], "records", _RECORDS)
    return events.unionByName(closed(records, config, dated, True, shuffle_partitions(spark)))
