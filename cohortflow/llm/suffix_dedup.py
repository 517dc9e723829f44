"""Removal of repeated byte strings by merged Burrows-Wheeler transforms (operator 1).

A string of ``size`` bytes is repeated if it starts at two places.  Only places
whose string shares its smallest inner piece (a fixed choice that equal strings
make alike) with another place can be repeated.  Runs of places with the same
piece are blocks: equal blocks repeat as a whole, and the distinct blocks that
share a piece without being equal are put into shards.  Each shard gets its
Burrows-Wheeler transform; the transforms are merged by refining their
interleave, and the intervals whose common prefix reaches ``size`` are the
repeated strings.

Blocks of one piece that are too many for a task are cut anew by a longer piece:
strings that are equal share that one too, and the blocks around it are shorter
and more alike.  A piece as long as the string leaves nothing to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.shingles import _BYTE, mix
from cohortflow.llm.texts import sized, slices, write_once

# Steps in which an interleave is refined to the full length.
STEPS = 4
# Bytes of a shard, of the blocks that one task merges, about, and of the different blocks of a piece.
SHARD_BYTES = 256 << 10
MERGE_BYTES = 2 << 20
PIECE_BYTES = 2 << 20

_P = 0xD1342543DE82EF95
_FACTOR = np.uint64(_P)
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))
_TOP = np.uint64(2**64 - 1)


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Numbers of all substrings of one length, with tables of powers that grow when needed."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_FACTOR, 1 << 16), _powers(_INVERSE, 1 << 16)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.up):
            grown = max(n, 2 * len(self.up))
            self.up, self.down = _powers(_FACTOR, grown), _powers(_INVERSE, grown)
        out = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: n - 1], out=out[1:])
        return out

    def at(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + mix((end - start).astype(np.uint64)))

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return mix((sums[length:] - sums[:-length]) * self.down[:n])


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours."""
    f, fill = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = f.accumulate(rows, axis=1).ravel()
    right = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: n - width + 1], left[width - 1 : n])


def blocks_of(raw: bytes, size: int, piece: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Piece, name, first and last place, and weight of the blocks of a text.

    A place's piece is the one of the smallest number in its string; neighbours
    with the same piece form a block.  Its name stands for its bytes.  A piece
    that the text has twice weighs 2, as a block may repeat inside itself.
    """
    if len(raw) < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    width = size - piece + 1
    sums = rolling.sums(np.frombuffer(raw, np.uint8))
    numbers = rolling.all(sums, piece)
    smallest = slide(numbers, width, least=True)
    first = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    last = np.concatenate([first[1:], [len(smallest)]]) - 1
    pieces = smallest[first]
    padded = np.zeros(len(smallest) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(smallest)] = smallest
    chosen = numbers[slide(padded, width, least=False) == numbers]
    values, counts = np.unique(chosen, return_counts=True)
    weight = np.where(counts[np.searchsorted(values, pieces)] > 1, 2, 1)
    names = rolling.at(sums, first, last + size)
    return pieces.view(np.int64), names.view(np.int64), first, last, weight


def text_blocks(docs: DataFrame, size: int, piece: int, text: str) -> DataFrame:
    """(row, doc_id, packed, n_bytes, blocks): one row per input row, with a number of its own once written."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct(
        [("piece", pa.int64()), ("name", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("weight", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        rolling = Rolling()
        for whole in batches:
            for b in slices(whole, 1):
                raws = [(t or "").encode("utf-8") for t in b.column(1).to_pylist()]
                parts = [blocks_of(r, size, piece, rolling) for r in raws]
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)]
                ends = np.cumsum([0, *[len(p[0]) for p in parts]])
                blocks = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([shrink(r) for r in raws], pa.binary()),
                        pa.array([len(r) for r in raws], pa.int64()),
                        blocks,
                    ],
                    names=["doc_id", "packed", "n_bytes", "blocks"],
                )

    rows = docs.select("doc_id", text).mapInArrow(
        run,
        f"doc_id {kind}, packed binary, n_bytes bigint, blocks array<struct<"
        "piece: bigint, name: bigint, first: bigint, last: bigint, weight: bigint>>",
    )
    return rows.withColumn("row", F.monotonically_increasing_id())


# Transforms and their merge ----------------------------------------------------------------------


def named(x: np.ndarray) -> np.ndarray:
    """Equal values get equal small numbers, in the order of the values."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def stable_order(x: np.ndarray) -> np.ndarray:
    """A stable sort of numbers under 2**32, by their halves, which numpy sorts by counting."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def shard_transform(symbols: np.ndarray, step: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a shard in order of their next ``step * steps`` bytes, and the symbol before each.

    The shard is read as a ring.  ``symbols`` names the ``step`` bytes at each
    place; ranks are doubled until they cover the length.
    """
    rank, covered = symbols, 1
    while covered < steps:
        jump = min(covered, steps - covered)
        rank = named(rank * (int(rank.max()) + 1) + np.roll(rank, -step * jump))
        covered += jump
    order = np.argsort(rank, kind="stable")
    return order, np.roll(symbols, step)[order]


def merge(transforms: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' orders, and the interval of each entry.

    ``interleave[t]`` is the entry, counted through all shards, at place t of
    the merged order.  Each step sorts the interleave stably by the symbol in
    front, which sorts the suffixes one step longer; entries whose common prefix
    ends there are parted.  Only the transforms are read, never the texts.
    """
    sizes = [len(t) for t in transforms]
    before = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(sizes)), sizes)
    interval = np.zeros(len(shard), np.int64)

    def entries() -> np.ndarray:
        out = np.empty(len(shard), np.int64)
        out[stable_order(shard)] = np.arange(len(shard))
        return out

    for _ in range(steps):
        symbol = before[entries()]
        order = stable_order(symbol)
        shard, symbol, interval = shard[order], symbol[order], interval[order]
        parted = np.ones(len(shard), np.int64)
        parted[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(parted) - 1
    return entries(), interval


def repeated_places(
    blocks: list[bytes], size: int, rolling: Rolling, steps: int = STEPS, shard_bytes: int = SHARD_BYTES
) -> tuple[list[np.ndarray], np.ndarray]:
    """For each place of each block with ``size`` bytes after it, the interval of its string; and the intervals' sizes."""
    step = size // steps
    bounds = np.cumsum([0, *map(len, blocks)])
    data = np.frombuffer(b"".join(blocks), np.uint8)
    n = len(data)
    ring = np.concatenate([data, data[: step - 1]])
    symbols = rolling.all(rolling.sums(ring), step)
    # Strings end inside their block, so what follows a shard's end is never part of one.
    symbols = named(symbols)
    valid = np.ones(n, np.int64)
    for end in bounds[1:]:
        valid[end - size + 1 : end] = 0
    cuts = [0]
    for end in bounds[1:].tolist():
        if end - cuts[-1] >= shard_bytes or end == n:
            cuts.append(end)
    orders, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        order, transform = shard_transform(symbols[a:b], step, steps)
        orders.append(order + a)
        transforms.append(transform)
    entry, interval = merge(transforms, steps)
    place = np.concatenate(orders)[entry]
    of = np.empty(n, np.int64)
    of[place] = interval
    counts = np.bincount(of, valid, int(interval.max()) + 1 if n else 0)
    return [of[a : b - size + 1] for a, b in zip(bounds[:-1], bounds[1:])], counts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def merged_shards(found: DataFrame, size: int) -> DataFrame:
    """(row, first, last): runs of repeated places in the blocks (bucket, row, first, bytes).

    A task merges the shards of one bucket, which has all blocks of its pieces.
    """

    def run(table: pa.Table) -> pa.Table:
        intervals, counts = repeated_places(table.column("bytes").to_pylist(), size, Rolling())
        out: dict[str, list] = {"row": [], "first": [], "last": []}
        for of, row, start in zip(intervals, table.column("row").to_pylist(), table.column("first").to_pylist()):
            a, b = runs(counts[of] > 1)
            out["row"] += [row] * len(a)
            out["first"] += (a + start).tolist()
            out["last"] += (b + start).tolist()
        return pa.table({f: pa.array(v, pa.int64()) for f, v in out.items()})

    return found.groupBy("bucket").applyInArrow(run, "row bigint, first bigint, last bigint")


# The operator ------------------------------------------------------------------------------------


PLACES = ["row", "first", "last"]


def _blocks_bytes(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The wanted blocks (bucket, row, first, last) with their bytes, cut out of the texts (row, n_bytes, packed)."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("bucket", "first", "last")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for b in sized(whole, whole.column(1).to_numpy()):
                out = []
                for row, packed, blocks in zip(*[b.column(i).to_pylist() for i in (0, 2, 3)]):
                    raw = open_(packed)
                    out += [(row, x["bucket"], x["first"], raw[x["first"] : x["last"] + size]) for x in blocks]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.binary())],
                    names=["row", "bucket", "first", "bytes"],
                )

    joined = texts.join(lists, "row").select("row", "n_bytes", "packed", "wanted")
    return joined.mapInArrow(run, "row bigint, bucket bigint, first bigint, bytes binary")


def _cut_anew(texts: DataFrame, ranges: DataFrame, size: int, piece: int) -> DataFrame:
    """Blocks by a longer piece within ranges (row, first, last) of places of the texts (row, n_bytes, packed)."""
    lists = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    names = ["row", "piece", "name", "first", "last", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        rolling = Rolling()
        for whole in batches:
            for b in sized(whole, whole.column(1).to_numpy()):
                parts: list[list[np.ndarray]] = [[] for _ in names]
                for row, packed, found in zip(*[b.column(i).to_pylist() for i in (0, 2, 3)]):
                    raw = open_(packed)
                    for x in found:
                        cut = blocks_of(raw[x["first"] : x["last"] + size], size, piece, rolling)
                        of, name, first, last, weight = cut
                        shift = x["first"]
                        columns = (np.full(len(of), row), of, name, first + shift, last + shift, weight)
                        for part, c in zip(parts, columns):
                            part.append(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*p, np.zeros(0, np.int64)]), pa.int64()) for p in parts], names=names
                )

    joined = texts.join(lists, "row").select("row", "n_bytes", "packed", "ranges")
    return joined.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _judged(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks whose piece is shared: ``whole`` if an equal block is there, ``open`` if the piece has others to compare.

    ``amount`` is the size of the piece's different blocks.
    """
    shared = blocks.groupBy("piece").agg(F.sum("weight").alias("total")).where("total > 1")
    marked = write_once(blocks.drop("weight").join(shared.select("piece"), "piece", "left_semi"), "blocks")
    bytes_ = F.max(F.col("last") - F.col("first") + size)
    counted = marked.groupBy("piece", "name").agg(F.count(F.lit(1)).alias("c"), bytes_.alias("bytes"))
    pieces = counted.groupBy("piece").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("bytes").alias("amount"),
        (F.min("c") == 1).alias("open"),
    )
    state = counted.join(pieces, "piece").select(
        "piece", "name", "open", "distinct", "amount", (F.col("c") > 1).alias("whole")
    )
    return write_once(marked.join(state, ["piece", "name"]), "marked")


def remove_repeats(docs: DataFrame, size: int = 200, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every row of ``docs`` (doc_id, text).

    Every byte goes that lies in a string of ``size`` bytes which also starts
    elsewhere in the input, in the same text or another, overlaps included;
    ``n_spans`` counts the maximal removed runs.  Matches never cross documents.

    Null texts are empty; texts under ``size`` bytes keep all.  Each row is a
    document of its own: a row that repeats another repeats its strings, and so
    both lose them.  A null doc_id stays null.  An empty table gives no row,
    columns other than doc_id and the text are not read.  ``size`` is a
    multiple of STEPS.
    """
    if size % STEPS:
        raise ValueError(f"size must be a multiple of {STEPS}")
    piece = max(1, size * 64 // 200)
    texts = write_once(text_blocks(docs, size, piece, text), "texts")
    # The texts are dealt once; the joins with them read the same shuffle.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("row", "doc_id", "n_bytes", "packed").repartition(n, "row")
    sources = dealt.select("row", "n_bytes", "packed")
    blocks = texts.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    equal, compared = [], []
    while True:
        marked = _judged(blocks, size)
        if piece == size:
            # What shares the whole string is repeated, whatever its block.
            equal.append(marked.select(*PLACES))
            break
        equal.append(marked.where("whole").select(*PLACES))
        # Of equal blocks one is enough to compare others with; the rest are all distinct.
        candidates = marked.where("open")
        kept = ["piece", "name", "distinct", "amount"]
        some = (
            candidates.where("whole")
            .groupBy(*kept)
            .agg(F.min(F.struct(*PLACES)).alias("s"))
            .select(*kept, "s.*")
        )
        distinct = candidates.where("NOT whole").select(*kept, *PLACES).unionByName(some)
        many = (F.col("distinct") > 1) & (F.col("amount") > PIECE_BYTES)
        compared.append(distinct.where(~many).select("piece", *PLACES))
        further = write_once(distinct.where(many).select(*PLACES), "further")
        if further.isEmpty():
            break
        piece = size - (size - piece) // 2
        blocks = _cut_anew(sources, further, size, piece)
    wanted = compared[0]
    for level in compared[1:]:
        wanted = wanted.unionByName(level)
    if len(compared) > 1:
        wanted = write_once(wanted, "wanted")
    amount = wanted.agg(F.sum(F.col("last") - F.col("first") + size))
    buckets = max(1, -(-2 * int(amount.first()[0] or 0) // MERGE_BYTES))
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("bigint"))
    partial = merged_shards(_blocks_bytes(sources, wanted.drop("piece"), size), size)
    whole = equal[0]
    for level in equal[1:]:
        whole = whole.unionByName(level)
    places = (
        whole.unionByName(partial)
        .groupBy("row")
        .agg(F.collect_set(F.struct("first", "last")).alias("places"))
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = dealt.join(places, "row", "left").select("doc_id", "n_bytes", "packed", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for b in sized(whole, whole.column(1).to_numpy()):
                removed, spans, kept = [], [], []
                for n, packed, where in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)]):
                    raw = open_(packed)
                    edge = np.zeros(n + 1, np.int64)
                    for x in where or []:
                        edge[x["first"]] += 1
                        edge[x["last"] + size] -= 1
                    gone = np.cumsum(edge[:n]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(len(runs(gone)[0]))
                    kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if where else raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()),
                        pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
