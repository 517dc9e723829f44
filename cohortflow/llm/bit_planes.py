"""Centroid clustering by bit planes (operator 11).

Components become integers, and the b-th bits of a vector's 64 components one
64-bit word, its b-th plane.  The dot product of two vectors is the sum over all
pairs of planes of 2^(a+b) times the bits that both have, so distances are exact
and need no floating point.  The planes are written once; a round reads them,
and one row of sums per task and centroid comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.texts import write_once

WIDTH = 64

# Components may span so many bits at most, or a squared distance would leave 64 bits.
MOST_BITS = 28

# Vectors whose distances are worked out together.
ROWS_AT_ONCE = 4096


def kept(column: Column, width: int = WIDTH) -> Column:
    """True for arrays of exactly ``width`` components, none null, NaN or infinite."""
    finite = F.forall(
        column,
        lambda x: F.coalesce(
            ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)
        ),
    )
    return F.coalesce((F.size(column) == width) & finite, F.lit(False))


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) words of (n, 64) numbers below 2^bits; bit i of word b is bit b of component i."""
    out = np.empty((len(values), bits), np.uint64)
    for b in range(bits):
        plane = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(plane, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def values(words: np.ndarray) -> np.ndarray:
    """The numbers that ``planes`` made the words of."""
    n, bits = words.shape
    raw = np.ascontiguousarray(words.astype("<u8")).view(np.uint8).reshape(n, bits, 8)
    out = np.zeros((n, WIDTH), np.int64)
    for b in range(bits):
        out += np.unpackbits(raw[:, b], axis=1, bitorder="little").astype(np.int64) << b
    return out


def distances(words: np.ndarray, squares: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors, given as planes, to centroids (k, 64), by AND and popcount."""
    bits = words.shape[1]
    of = planes(centroids, bits)
    out = np.empty((len(words), len(centroids)), np.int64)
    for j, centroid in enumerate(centroids):
        dot = np.zeros(len(words), np.int64)
        for b in range(bits):
            if of[j, b]:
                for a in range(bits):
                    dot += np.bitwise_count(words[:, a] & of[j, b]).astype(np.int64) << (a + b)
        out[:, j] = squares + int(centroid @ centroid) - 2 * dot
    return out


def _words(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        words = part.column("words").flatten().to_numpy().view(np.uint64).reshape(-1, bits)
        yield at, words, part.column("square").to_numpy()


def packed(vectors: DataFrame, low: int, bits: int) -> DataFrame:
    """(key, words, square) of (key, q): the planes of q - low, and the sum of its squares."""
    schema = T.StructType(
        [
            vectors.schema["key"],
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("square", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                q = part.column("q").flatten().to_numpy().reshape(-1, WIDTH) - low
                words = pa.array(planes(q, bits).ravel().view(np.int64))
                ends = pa.array(np.arange(0, len(words) + 1, bits, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.ListArray.from_arrays(ends, words),
                        pa.array((q * q).sum(axis=1)),
                    ],
                    names=["key", "words", "square"],
                )

    return vectors.select("key", "q").mapInArrow(run, schema)


def moved(table: DataFrame, centroids: np.ndarray, low: int, bits: int) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; those of none stay.

    Each task adds up its own vectors; Spark adds these sums per centroid and
    component as decimals, so nothing overflows, and as many rows as there are
    components come to the driver.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for batch in batches:
            for _, words, squares in _words(batch, bits):
                nearest = distances(words, squares, centroids).argmin(axis=1)
                counts += np.bincount(nearest, minlength=k)
                all_values = values(words)
                for j in np.unique(nearest):
                    sums[j] += all_values[nearest == j].sum(axis=0)
        full = np.flatnonzero(counts)
        if len(full):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(full, WIDTH).astype(np.int32)),
                    pa.array(np.tile(np.arange(WIDTH, dtype=np.int32), len(full))),
                    pa.array(np.repeat(counts[full], WIDTH)),
                    pa.array(sums[full].ravel()),
                ],
                names=["c", "i", "n", "s"],
            )

    whole = "decimal(38,0)"
    rows = (
        table.select("words", "square")
        .mapInArrow(run, "c int, i int, n long, s long")
        .groupBy("c", "i")
        .agg(F.sum(F.col("n").cast(whole)).alias("n"), F.sum(F.col("s").cast(whole)).alias("s"))
        .collect()
    )
    out = centroids.copy()
    for row in rows:
        out[row["c"], row["i"]] = int(row["s"]) // int(row["n"])
    return out


def assigned(table: DataFrame, centroids: np.ndarray, bits: int) -> DataFrame:
    """(key, cluster, distance) of every vector; of centroids at one distance the first."""
    schema = T.StructType(
        [
            table.schema["key"],
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, squares in _words(batch, bits):
                d = distances(words, squares, centroids)
                nearest = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(at, len(words)),
                        pa.array(nearest.astype(np.int32)),
                        pa.array(d[np.arange(len(d)), nearest]),
                    ],
                    names=["key", "cluster", "distance"],
                )

    return table.mapInArrow(run, schema)


def cluster_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    scale: int = 64,
    seed: str = "1:",
) -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia and the sha256 of the centroid, row by row.

    A component x counts as floor(scale * x).  The start is the ``k`` vectors of
    the smallest sha256 of ``seed`` and key; a round moves every centroid to the
    floor of its vectors' mean.  Arrays of another length than 64 or with a null
    or non-finite component give no row.  A repeated row gives a repeated result
    and counts each time (of equal keys the smaller vector starts first), a null
    key stays null and never starts.  With fewer keys than ``k`` there are fewer
    centroids, with none at all everything but the key is null; an empty table
    gives no row.  Other columns are not read.  Components that span 2^28 or
    more raise a ValueError, as distances would leave 64 bits.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(column).alias("v")).where(kept(F.col("v")))
    rows = rows.select("key", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"))
    low, high = rows.agg(F.min(F.array_min("q")), F.max(F.array_max("q"))).first()
    start = (
        rows.where(F.col("key").isNotNull())
        .select(F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256).alias("h"), "q")
        .orderBy("h", "q")
        .limit(k)
        .collect()
    )
    if not start:
        return rows.select(
            F.col("key").alias(key),
            F.lit(None).cast("int").alias("cluster"),
            *[F.lit(None).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit(None).cast("string").alias("centroid_sha256"),
        )
    bits = max(1, (high - low).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"components from {low} to {high} span more than {MOST_BITS} bits")
    table = write_once(packed(rows, low, bits), "planes")
    centroids = np.array([row["q"] for row in start], np.int64) - low
    for _ in range(rounds):
        centroids = moved(table, centroids, low, bits)
    out = write_once(assigned(table, centroids, bits), "clusters")
    sums = {
        row["cluster"]: int(row["s"])
        for row in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    }
    names = [
        hashlib.sha256(",".join(map(str, (c + low).tolist())).encode()).hexdigest() for c in centroids
    ]

    def of(items: list) -> Column:
        return F.element_at(F.array(*map(F.lit, items)), F.col("cluster") + 1)

    return out.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        of([sums.get(j, 0) for j in range(len(names))]).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        of(names).alias("centroid_sha256"),
    )
