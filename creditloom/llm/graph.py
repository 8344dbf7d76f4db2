"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import discard, sorted_join, stored


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, once each."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest ``v`` of every ``u``; combined before the shuffle, so that a hub costs one row per task."""
    return edges.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("low"))


def _is_star(edges: DataFrame) -> bool:
    """Whether every node points to a single one that points nowhere."""
    found = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("sources")).first()
    # each end once: a join of the edges would bring all of a hub to one task
    ends, hubs = edges.select("v").distinct(), edges.select(F.col("u").alias("w")).distinct()
    return found.n == found.sources and sorted_join(ends).join(hubs, ends.v == hubs.w, "left_semi").isEmpty()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has an edge.

    ``edges`` has columns u and v; nulls and loops are ignored. Each round links the neighbours of every node to the
    smallest of them (first the larger neighbours, then the smaller ones), until all components are stars. A round is
    two groupings and two joins over the edges; each round's edges are written to the shared folder.
    """
    now = stored(_oriented(edges), purpose)
    while not _is_star(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both)
        large = _oriented(
            sorted_join(both).join(low, both.u == low.hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        )
        large = stored(large, purpose)
        low = _smallest(large)
        small = sorted_join(large).join(low, large.u == low.hub)
        ends = F.explode(F.array("u", "v")).alias("u")
        new = stored(_oriented(small.select(ends, F.col("low").alias("v"))), purpose)
        discard(now, large)
        now = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
