"""Merkle manifest of a table, with proofs by octopus multiproof (operator 13).

Rows are leaves, put in order within their group; every 8 consecutive nodes
become one, up to the group's root, and the groups' roots likewise up to one.
The leaves of a group lie in chunks of 8^4 consecutive ones, whose nodes no
other chunk needs but for the topmost.  A chunk knows from its place and its
group's size alone which nodes its proofs lack: the siblings on the way up from
its root, the same for all its leaves.  It asks for these coordinates once, by a
join with the table of runs, derives all nodes within itself from its own
leaves, and expands the proof of each leaf from both.

Order and places come from one range partitioning and from counts per partition
and group, so no task has a group as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from cohortflow.llm.texts import write_once

FANOUT = 8

# Levels within a chunk, which has FANOUT ** CHUNK_LEVELS leaves.
CHUNK_LEVELS = 4
CHUNK = FANOUT**CHUNK_LEVELS

# Results that leave a task at once.
ROWS_AT_ONCE = 2048

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Offset of the levels above the groups' roots, so that they sort after all levels below.
TOP = 1000


def part(value: Column) -> Column:
    """``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    said = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(said, F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def places(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, the place within the group, and ``n``, the group's rows; the largest ``n`` too.

    ``order`` must leave no ties.  One range partitioning by group and order;
    a partition's rows of a group then follow those of the partitions before.
    """
    by = [group, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = write_once(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn("p", F.shiftright("at", 33))
    before = Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "p").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    shifts = write_once(
        counts.select(
            group,
            "p",
            (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("here").over(Window.partitionBy(group)).alias("n"),
        ),
        "shifts",
    )
    most = shifts.agg(F.max("n")).first()[0] or 0
    found = ranged.join(shifts, [group, "p"]).withColumn("pos", F.col("at") + F.col("shift"))
    return found.drop("at", "p", "shift"), most


def digest(hexes: Sequence[bytes]) -> bytes:
    return sha256(b"".join(hexes)).hexdigest().encode()


def widths(n: int, levels: int) -> list[int]:
    """Nodes on the levels from ``n`` leaves up that still have to be joined, ``levels`` of them at most."""
    out = []
    while n > 1 and len(out) < levels:
        out.append(n)
        n = -(-n // FANOUT)
    return out


def climb(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of a chunk, level by level; the last level is its root."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def fold(node: bytes, steps: Sequence[tuple[int, list[bytes]]]) -> bytes:
    """Go up: at each step the node joins its siblings, at its own place among them."""
    for own, siblings in steps:
        node = digest([*siblings[:own], node, *siblings[own:]])
    return node


def expand(levels: list[list[bytes]], above: bytes) -> list[bytes]:
    """The digest of each leaf's siblings, up to the chunk's root and then ``above``, which all share."""
    rest = [above]
    for nodes in levels[-2::-1]:
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        rest = [
            b"".join([*run[:j], *run[j + 1 :], rest[r]])
            for r, run in enumerate(runs)
            for j in range(len(run))
        ]
    return [sha256(x).hexdigest().encode() for x in rest]


def refold(
    levels: list[list[bytes]], at: int, leaf: bytes, steps: Sequence[tuple[int, list[bytes]]]
) -> bytes:
    """The root that another leaf at a place of the chunk leads to."""
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        run = nodes[first : first + FANOUT]
        run[at - first] = leaf
        leaf, at = digest(run), at // FANOUT
    return fold(leaf, steps)


def _groups(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str]
) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows with equal keys, which lie together, as lists by column."""
    key, held = None, {}
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        at = 0
        of = list(zip(*[cols[k] for k in keys]))
        for i in range(1, len(of) + 1):
            if i == len(of) or of[i] != of[at]:
                if of[at] != key:
                    if key is not None:
                        yield key, held
                    key, held = of[at], {n: [] for n in cols}
                for n, c in cols.items():
                    held[n] += c[at:i]
                at = i
    if key is not None:
        yield key, held


def _hexes(digests: Sequence[bytes]) -> list[bytes]:
    return [d.hex().encode() for d in digests]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) == ROWS_AT_ONCE:
            yield batch()
            held = []
    if held:
        yield batch()


def _streamed(
    rows: DataFrame,
    order: Sequence[str],
    schema: T.StructType,
    of_group: Callable[[tuple, dict[str, list]], Iterator[tuple]],
) -> DataFrame:
    """Run a function over the rows of each chunk, in order; a task has one chunk in memory at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _groups(batches, ["g", "chunk"])
        yield from _batches((row for key, held in found for row in of_group(key, held)), arrow)

    near = rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", *order)
    return near.mapInArrow(run, schema)


def chunk_roots(leaves: DataFrame) -> DataFrame:
    """(g, idx, n, node): the root of each chunk of (g, chunk, pos, n, leaf)."""
    schema = T.StructType(
        [
            T.StructField("g", T.StringType()),
            T.StructField("idx", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("node", T.BinaryType()),
        ]
    )

    def of_group(key: tuple, held: dict[str, list]) -> Iterator[tuple]:
        n = held["n"][0]
        root = climb(_hexes(held["leaf"]), len(widths(n, CHUNK_LEVELS)))[-1][0]
        yield (*key, n, bytes.fromhex(root.decode()))

    return _streamed(leaves.select("g", "chunk", "pos", "n", "leaf"), ["pos"], schema, of_group)


def runs_above(nodes: DataFrame, most: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Join nodes (g, idx, w, node), w nodes of a group on a level, up to one node a group.

    Gives the runs (g, level, run, members) of at most 8 nodes, and (g, node) of
    each group's root.  Each level is one aggregate over an eighth of the rows
    of the level below; ``most`` is the largest w.
    """
    runs = nodes.select(
        "g", F.lit(0).alias("level"), F.col("idx").alias("run"), F.array("node").alias("members")
    ).limit(0)
    tops = nodes.where("w = 1").select("g", "node")
    while most > 1:
        grouped = nodes.where("w > 1").groupBy("g", "w", F.floor(F.col("idx") / FANOUT).alias("run"))
        members = F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"]
        )
        joined = F.concat_ws("", F.transform("members", lambda x: F.lower(F.hex(x))))
        made = write_once(
            grouped.agg(members.alias("members")).select(
                "g", F.lit(level).alias("level"), "run", "w", "members",
                F.unhex(F.sha2(joined, 256)).alias("node"),
            ),
            "runs",
        )
        runs = runs.unionByName(made.select("g", "level", "run", "members"))
        nodes = made.select("g", F.col("run").alias("idx"), F.ceil(F.col("w") / FANOUT).alias("w"), "node")
        tops = tops.unionByName(nodes.where("w = 1").select("g", "node"))
        most, level = -(-most // FANOUT), level + 1
    return runs, tops


def asked(nodes: DataFrame, most: int, level: int, keep: Sequence[str]) -> DataFrame:
    """The runs that hold the missing siblings of nodes (g, idx, w): keep, g, level, run and own, the place in it."""
    levels = len(widths(most, 10**6))
    if not levels:
        steps = F.lit(None).cast("array<struct<k:int,scale:bigint>>")
    else:
        steps = F.array(
            *[
                F.struct(F.lit(i).alias("k"), F.lit(FANOUT**i).cast("bigint").alias("scale"))
                for i in range(levels)
            ]
        )
    rows = nodes.select(*keep, "g", "idx", "w", F.explode(steps).alias("s"))
    up = F.floor(F.col("idx") / F.col("s.scale"))
    return rows.where(F.ceil(F.col("w") / F.col("s.scale")) > 1).select(
        *keep,
        "g",
        (F.col("s.k") + level).alias("level"),
        F.floor(up / FANOUT).alias("run"),
        (up % FANOUT).cast("int").alias("own"),
    )


def steps_of(requests: DataFrame, runs: DataFrame, keys: Sequence[str], shift: int = 0) -> DataFrame:
    """keys and ``steps``: for each level the own place and the siblings, lowest level first."""
    found = requests.join(runs, ["g", "level", "run"])
    step = F.struct(
        (F.col("level") + shift).alias("level"),
        "own",
        F.filter("members", lambda x, i: i != F.col("own")).alias("siblings"),
    )
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    order: str = "doc_id",
    text: str = "text",
    tampered: Column | None = None,
) -> DataFrame:
    """``order``, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    A leaf is the sha256 of the named columns, of nulls too.  Leaves of a group
    ascend by ``order``, nulls first, then by leaf; equal rows are leaves of
    their own.  Groups ascend by the UTF-8 bytes of their text, a null group
    first.  Where ``tampered`` (never by default) holds, the root is folded from
    the row with A-Z of ``text`` in lower case, which for null and empty texts
    and texts without A-Z is the same leaf.  An empty table gives no row.
    Columns beside those named are not read and may have any name.
    """
    now = [F.col(c) for c in columns]
    then = [lowered(F.col(c)) if c == text else F.col(c) for c in columns]
    change = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(order).alias("key"),
        F.unhex(leaf_of(now)).alias("leaf"),
        F.when(change, F.unhex(leaf_of(then))).alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # The tie breaker is written with the leaves, so that it is the same whatever is computed again.
    leaves = write_once(leaves, "leaves")
    leaves, most = places(leaves, "g", ["key", "leaf", "tie"])
    leaves = leaves.withColumn("chunk", F.floor(F.col("pos") / CHUNK))

    roots = write_once(chunk_roots(leaves), "chunks")
    nodes = roots.withColumn("w", F.ceil(F.col("n") / CHUNK))
    runs, tops = runs_above(nodes, -(-most // CHUNK), CHUNK_LEVELS)

    # The groups' roots are the leaves of one more tree.
    tops = write_once(tops, "subroots").select(F.lit("").alias("all"), F.col("g").alias("name"), "node")
    tops, n_groups = places(tops, "all", ["name"])
    tops = write_once(
        tops.select(
            F.lit("").alias("g"), "name", F.col("pos").alias("idx"), F.col("n").alias("w"), "node"
        ),
        "places",
    )
    top_runs, top = runs_above(tops, n_groups, 0)
    first = top.first()
    root = first["node"].hex() if first else ""
    top_steps = steps_of(asked(tops, n_groups, 0, ["name"]), top_runs, ["name"], TOP)
    paths = write_once(
        tops.join(top_steps, "name", "left").select(
            F.col("name").alias("g"), F.col("node").alias("subroot"), F.col("steps").alias("top")
        ),
        "paths",
    )

    chunks = nodes.withColumn("chunk", F.col("idx"))
    own = steps_of(asked(chunks, -(-most // CHUNK), CHUNK_LEVELS, ["chunk"]), runs, ["g", "chunk"])
    fetched = chunks.select("g", "chunk", "n").join(own, ["g", "chunk"], "left").join(paths, "g")
    kind = own.schema["steps"].dataType
    nothing = F.array().cast(kind)
    stream = leaves.select(
        "g", "chunk", "pos", "n", "key", "leaf", "other",
        F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(kind).alias("steps"),
    ).unionByName(
        fetched.select(
            "g", "chunk", F.lit(-1).cast("bigint").alias("pos"), "n",
            F.lit(None).cast(leaves.schema["key"].dataType).alias("key"),
            F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("other"),
            "subroot",
            F.concat(F.coalesce("steps", nothing), F.coalesce("top", nothing)).alias("steps"),
        )
    )
    texts = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = T.StructType(
        [
            T.StructField(order, leaves.schema["key"].dataType),
            *[T.StructField(c, T.StringType()) for c in texts],
            T.StructField("verified", T.BooleanType()),
        ]
    )

    def of_group(key: tuple, held: dict[str, list]) -> Iterator[tuple]:
        # The first row has what was fetched, the others are the leaves in order.
        subroot = held["subroot"][0].hex()
        steps = [(s["own"], _hexes(s["siblings"])) for s in held["steps"][0]]
        ids, hexes, others = held["key"][1:], _hexes(held["leaf"][1:]), held["other"][1:]
        levels = climb(hexes, len(widths(held["n"][0], CHUNK_LEVELS)))
        above = b"".join(x for _, siblings in steps for x in siblings)
        # All leaves that were not tampered with lead through the same nodes to one root.
        shared = fold(levels[-1][0], steps).decode()
        for i, proof in enumerate(expand(levels, above)):
            folded = shared
            if others[i] is not None:
                folded = refold(levels, i, others[i].hex().encode(), steps).decode()
            yield ids[i], hexes[i].decode(), subroot, root, proof.decode(), folded, folded == root

    return _streamed(stream, ["pos"], schema, of_group)
