"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any orderable type -> (node, root), one row for each node that has an edge to another.

    ``root`` is the least node of the component. Self-loops, repeated edges and both directions are allowed;
    rows with a null end are ignored; no edges give no rows. A round does not gather a node's edges: minima are
    pre-aggregated and the joins may be split by AQE where one hub is hot. The lineage is cut after each round.
    """
    kept = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    kept = cut_lineage(kept.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _digest(kept)
    while before[0]:
        kept = cut_lineage(_small_star(_large_star(kept)))
        after = _digest(kept)
        if after == before:
            break
        before = after
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        kept.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
