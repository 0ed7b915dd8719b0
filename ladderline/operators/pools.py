"""Rating pools: sets of teams that never meet a team outside the set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ladderline.operators.perspective import team_names
from ladderline.session import written


def connected_components(edges: DataFrame, a: str = "home", b: str = "away") -> DataFrame:
    """(node, root) for every node of the graph, root being the smallest node it connects to.

    Alternating star contraction (Kiveris et al., SoCC 2014). A round regroups the edge set around
    local minima and the number of rounds grows with the logarithm of the graph. A round is an
    aggregate with map-side combine plus an equi-join against one row per node, so a node with very
    many edges is split by the adaptive skew join instead of meeting in one task.
    """
    current = written(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    nodes = current.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    before = None
    while True:
        links = current.where(F.col("u") != F.col("v"))
        # large star: hang every larger neighbour of a node below the smallest one
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u")).join(lowest, "u")
            .select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()
        )
        large = written(large, "large-star")
        # small star: hang a node and its smaller neighbours below the smallest of them
        lowest = large.groupBy(F.col("v").alias("w")).agg(F.min("u").alias("m"))
        hung = large.join(lowest, F.col("v") == F.col("w"))
        small = (
            hung.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
            .where(F.col("u") != F.col("v")).distinct()
        )
        current = written(small, "small-star")
        seen = current.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
        ).first()
        if tuple(seen) == before:
            break
        before = tuple(seen)
    roots = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def sized_pools(matches: DataFrame, max_rows: int) -> tuple[DataFrame, Row]:
    """Matches with their `pool`, and a summary: pools, rows, and the pools of more than `max_rows` matches.

    Leagues already are pools when nobody plays in two of them and every match names one. That and
    the sizes come from one aggregation; only if it fails are the pools searched in the match graph.
    """
    # counted per team and league first, which hashes; the text minima then see few rows
    per_league = team_names(matches).groupBy("team", "league").agg(F.count(F.lit(1)).alias("n"))
    appearances = per_league.groupBy("team").agg(
        F.min("league").alias("lo"), F.count(F.lit(1)).alias("leagues"),
        F.max((F.coalesce("league", F.lit("")) == "").cast("int")).alias("blank"), F.sum("n").alias("n"))
    stray = (F.col("leagues") > 1) | (F.col("blank") == 1)
    by_league = appearances.groupBy(F.col("lo").alias("pool")).agg(
        F.floor(F.sum("n") / F.lit(2)).alias("rows"), F.max(stray.cast("int")).alias("stray"))
    found = _size_summary(by_league, max_rows, F.max("stray"))
    if not found["stray"]:
        return matches.withColumn("pool", F.col("league")), found
    roots = connected_components(matches.select("home", "away"))
    pooled = matches.join(roots.toDF("home", "pool"), "home")
    sizes = pooled.groupBy("pool").agg(F.count(F.lit(1)).alias("rows"))
    return pooled, _size_summary(sizes, max_rows, F.lit(0))


def _size_summary(sizes: DataFrame, max_rows: int, stray) -> Row:
    return sizes.agg(
        F.count(F.lit(1)).alias("pools"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        # at most (all rows / max_rows) entries
        F.collect_list(F.when(F.col("rows") > max_rows, F.col("pool"))).alias("oversized"),
        stray.alias("stray"),
    ).first()
