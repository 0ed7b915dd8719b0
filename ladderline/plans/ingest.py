"""From landed files to the match table and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ladderline.operators import merge
from ladderline.schema import MATCHES
from ladderline.session import prepare, written
from ladderline.sinks.documents import write_registry
from ladderline.sinks.tables import write_matches
from ladderline.sources import match_api, season_csv, tables


def build_match_table(
    spark: SparkSession,
    season_files: str,
    payloads: str,
    matches_out: str,
    registry_out: str | None = None,
    name_map: str | None = None,
) -> DataFrame:
    """Read both sources, merge them, write the match table (and registry); returns the table.

    Either source may be absent. Without `name_map` the built-in club names apply.
    """
    prepare(spark)
    names = tables.default_name_map(spark) if name_map is None else tables.read_name_map(spark, name_map)
    historical = tables.optional(
        spark, season_files, lambda s, p: season_csv.read(s, p, names), MATCHES)
    api = tables.optional(spark, payloads, match_api.read, MATCHES)
    write_matches(merge.merged(historical, api), matches_out)
    table = tables.read_matches(spark, matches_out)
    if registry_out is not None:
        write_registry(written(merge.registry(table), "registry"), registry_out)
    return table
