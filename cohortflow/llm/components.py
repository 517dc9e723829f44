"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.texts import write_once


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``links`` (a, b).

    Each round hangs the larger neighbours of a node, then its smaller ones, on
    the smallest of them (large star, small star); the number of rounds grows
    with the logarithm of a component's length.  Every round is written to the
    shared folder, groups are only ever reduced to their smallest member, so no
    task holds a whole component.  Links to itself and repeated links change
    nothing; nulls are left out.  Nodes without links are not listed.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct()
    )
    edges = write_once(edges, "links")
    was = _summary(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = write_once(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                        F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                    )
                ).alias("e")
            )
            .select("e.*")
            .where("a > b")
            .distinct()
        )
        edges = write_once(small, "links")
        now = _summary(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
