"""Removal of repeated runs of lines by prefix doubling over line numbers (operator 2).

Lines get places that count through the whole corpus.  The rank of a place is
the first place whose next lines are the same, so ranks of 2 and 3 lines come
from pairs of shorter ranks.  Doubling stops at ``min_lines``, and ranks are
never put in order: windows of a fixed number of lines take the place of a
suffix array and its intervals.  A line lies in a repeated run of that length or
more just if it lies in such a window, so the removed lines are the same; the
maximal repeated runs and their lengths are not found.  Everything is DataFrame
operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.texts import write_once

# A run counts from so many lines on, a single line from so many bytes.
MIN_LINES = 3
MIN_BYTES = 30


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def line_places(docs: DataFrame, text: str) -> DataFrame:
    """(place, doc_id, hash, i, a, b, bytes, last): every line of the distinct (doc_id, text), in order.

    Documents are ordered by doc_id, nulls last, and then by the hash of their
    text.  ``a`` and ``b`` name the line's content; ``last`` is the place of the
    document's last line.  Places of a document follow each other.
    """
    lines = (
        docs.where(F.col(text).isNotNull())
        .select("doc_id", F.xxhash64(text).alias("hash"), _lines(text).alias("lines"))
        .select("doc_id", "hash", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
        .select(
            "doc_id",
            "hash",
            "i",
            "n",
            F.xxhash64("line").alias("a"),
            F.xxhash64(F.lit(1), "line").alias("b"),
            F.octet_length("line").alias("bytes"),
        )
    )
    placed = (
        lines.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("hash"))
        .dropDuplicates(["doc_id", "hash", "i"])
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "hash", "i")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("last", F.col("place") - F.col("i") + F.col("n") - 1)
    )
    # Written once, so that the numbers are the same wherever they are read.
    return write_once(placed.drop("n"), "lines")


def first_ranks(places: DataFrame) -> DataFrame:
    """(place, last, rank, bytes) of the lines that occur more than once."""
    same = ["a", "b", "bytes"]
    groups = (
        places.groupBy(*same)
        .agg(F.min("place").alias("rank"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return places.join(groups, same).select("place", "last", "rank", "bytes")


def doubled(ranks: DataFrame, jump: int) -> DataFrame:
    """Ranks of ``jump`` more lines: the pair of a place's rank and that of the place ``jump`` further on.

    Places whose longer run occurs once drop out; their common prefix with any
    other place ends before.
    """
    further = ranks.select((F.col("place") - jump).alias("place"), F.col("rank").alias("next"))
    pairs = (
        ranks.select("place", "last", "rank")
        .join(further, "place")
        .where(F.col("place") + jump <= F.col("last"))
    )
    groups = (
        pairs.groupBy("rank", "next")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return pairs.join(groups, ["rank", "next"]).select("place", "last", F.col("first").alias("rank"))


def later_copies(places: DataFrame, min_lines: int, min_bytes: int) -> DataFrame:
    """The places (place) of all lines in later copies of repeated runs."""
    ranks = write_once(first_ranks(places), "ranks")
    later = F.col("rank") < F.col("place")
    single = ranks.where(later & (F.col("bytes") >= min_bytes)).select("place")
    covered = 1
    while covered < min_lines:
        jump = min(covered, min_lines - covered)
        ranks = doubled(ranks, jump)
        covered += jump
        if covered < min_lines:
            ranks = write_once(ranks, "ranks")
    run = F.explode(F.sequence(F.col("place"), F.col("place") + min_lines - 1))
    return single.unionByName(ranks.where(later).select(run.alias("place"))).distinct()


def removed_runs(places: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, hash, runs): the maximal runs (start, size) of removed lines of each document."""
    of = places.select("place", "doc_id", "hash", "i").join(gone, "place")
    # Neighbours keep the distance between their line number and their number among the removed.
    listed = of.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list("i")).alias("gone"))
    each = listed.select("doc_id", "hash", F.posexplode("gone").alias("k", "i"))
    runs = each.groupBy("doc_id", "hash", (F.col("i") - F.col("k")).alias("d")).agg(
        F.min("i").alias("start"), F.count(F.lit(1)).cast("int").alias("size")
    )
    return runs.groupBy("doc_id", "hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "size"))).alias("runs")
    )


def _kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, taken stretch by stretch."""

    def stretch(j: Column) -> Column:
        before = F.get(runs, j - 1)
        start = F.when(j == 0, F.lit(0)).otherwise(before["start"] + before["size"])
        end = F.when(j == F.size(runs), F.size(lines)).otherwise(F.get(runs, j)["start"])
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), stretch))


def dedup_lines(
    docs: DataFrame,
    min_lines: int = MIN_LINES,
    min_bytes: int = MIN_BYTES,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """``keep``, n_lines, n_removed, n_runs (long) and kept (text) of every row of ``docs``.

    Lines are what stands between line feeds.  A line goes if it lies in a run
    of at least ``min_lines`` lines that also starts earlier, in the same
    document or one before it, or if it has at least ``min_bytes`` bytes and
    stands earlier itself.  Earlier documents have a smaller doc_id; nulls are
    the last ones, and texts under one id follow the order of their hash.
    ``n_runs`` counts the maximal removed runs; ``kept`` joins the other lines.

    A null text has no lines and stays null, an empty one has an empty line.
    Rows that repeat a doc_id and its text are one document and get the same
    result.  Of a text whose lines all go, an empty text is left.  An empty
    table gives no row; other columns may have any name but those of the result.
    """
    places = line_places(docs, text)
    runs = removed_runs(places, later_copies(places, min_lines, min_bytes))
    runs = runs.select(
        F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("runs").alias("_runs")
    )
    rows = docs.select(
        F.struct(*keep).alias("_row"),
        F.col("doc_id").alias("_doc"),
        F.col(text).alias("_text"),
        F.xxhash64(text).alias("_own"),
    )
    joined = rows.join(
        runs, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left"
    )
    lines = _lines("_text")
    count = F.when(F.col("_text").isNull(), 0).otherwise(F.size(lines))
    gone = F.aggregate("_runs", F.lit(0), lambda t, r: t + r["size"])
    return joined.select(
        "_row.*",
        count.cast("bigint").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("_runs"), F.lit(0)).cast("bigint").alias("n_runs"),
        F.when(F.col("_runs").isNull(), F.col("_text"))
        .otherwise(F.array_join(_kept_lines(lines, F.col("_runs")), "\n"))
        .alias("kept"),
    )
