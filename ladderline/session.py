"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
SIDE_ROWS = 200_000  # rows up to which a written table is broadcast
_known_shared: set[tuple[str, str]] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: dates and instants are read and printed in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one in `spark.checkpoint.dir`, else one below the warehouse."""
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    folder = named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/ladderline-intermediate"
    _require_shared(spark, folder)
    return folder


def _require_shared(spark: SparkSession, folder: str) -> None:
    """A cluster may mount a `file:` folder on all its machines or not: rows that its tasks write there must be read again.

    Tried once for a session and folder. Rows of a folder that each machine has for itself would be lost without an error.
    """
    context = spark.sparkContext
    if context.master.startswith("local") or (context.applicationId, folder) in _known_shared:
        return
    named = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if named.getFileSystem(context._jsc.hadoopConfiguration()).getScheme() == "file":
        rows, path = max(2, context.defaultParallelism), f"{folder}/probe-{uuid.uuid4().hex}"
        spark.range(rows, numPartitions=rows).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
        discard(spark, path)
        if found != rows:
            raise RuntimeError(f"{folder} is not one folder for all machines: set {_CHECKPOINT_KEY} to one every executor can reach")
    _known_shared.add((context.applicationId, folder))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a superseded intermediate table through the file system it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def side(table: DataFrame, label: str, limit: int = SIDE_ROWS) -> DataFrame:
    """`table`, written, as the side of a join: built from all of it up to `limit` rows, else left to the optimizer.

    For tables of a row per file, block or team. Both ways join alike.
    """
    kept = written(table, label)
    return kept.hint("broadcast") if kept.count() <= limit else kept
