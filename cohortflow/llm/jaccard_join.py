"""N-gram Jaccard join by a token-group matrix (operator 3).

Equal sets become one class.  Classes that share rare tokens are partitioned
into groups of similar ones around a hub; a group keeps the union of its
members' tokens.  The matrix of tokens and groups, kept for the tokens in which
two linked sets must meet, names the groups that a query may have links in; the
union bounds the overlap with any member, and only groups within the bound are
opened and compared member by member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.components import components
from cohortflow.llm.shingles import overlap, set_name, shingle, shingle_set, word_hashes
from cohortflow.llm.texts import slices, write_once

# Members of a group at most; larger ones are split, so that a task opens a bounded one.
GROUP = 64
# Queries that a task compares with a group, about; the group's members go along with each such lot.
ASKED = 512
# Tokens that two linked sets share at least among their meeting tokens, if they are that large.
SHARED = 4
# Slots of the sketch that tells common words from rare ones, and from how often on a task names a
# slot; the number of slots bounds what the driver gets and what travels to the tasks.
SLOT_BITS = 20
OFTEN = 8


def needed(size: int, percent: int) -> int:
    """Common tokens that a set of this size has at least with any set it is linked to."""
    return -(-percent * size // 100)


def shared_column(n: Column, percent: int) -> Column:
    """What a set of size n shares at least with a linked one among the meeting tokens of both."""
    return F.least(F.lit(SHARED), F.ceil(n * percent / 100))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    most = min(len(a), len(b))
    if not most or (100 + percent) * most < percent * (len(a) + len(b)):
        return False
    return (100 + percent) * overlap(a, b) >= percent * (len(a) + len(b))


def _sets(batch: pa.RecordBatch, words: int) -> tuple[list[bytes], list[np.ndarray]]:
    raws = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
    return raws, [shingle_set(w, words) for w in word_hashes(raws)]


def named_sets(docs: DataFrame, words: int, text: str) -> DataFrame:
    """(doc_id, name, n): the name and the size of every row's set; an empty set has no name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                _, sets = _sets(b, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                    ],
                    names=["doc_id", "name", "n"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, name binary, n bigint")


def packed_texts(docs: DataFrame, words: int, text: str) -> DataFrame:
    """(doc_id, name, packed): the texts, of equal sets in a batch only that of the smallest doc_id.

    So the smallest document of each name is always there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for b in slices(whole, 1):
                raws, sets = _sets(b, words)
                ids = b.column(0).to_pylist()
                first: dict[bytes, int] = {}
                for i, (s, doc) in enumerate(zip(sets, ids)):
                    if len(s) and doc is not None:
                        name = set_name(s)
                        if name not in first or doc < ids[first[name]]:
                            first[name] = i
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(list(first.values()), pa.int64())),
                        pa.array(list(first), pa.binary()),
                        pa.array([shrink(raws[i]) for i in first.values()], pa.binary()),
                    ],
                    names=["doc_id", "name", "packed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, name binary, packed binary")


def _words(packed: list[bytes]) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    return word_hashes([open_(p) for p in packed])


def _opened(packed: list[bytes], words: int) -> list[np.ndarray]:
    return [shingle_set(w, words) for w in _words(packed)]


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def word_weights(classes: DataFrame) -> np.ndarray:
    """How common words are, by slot of their number: eight times the binary logarithm of their count.

    Every text is counted.  A task names the slots that it has met OFTEN, so
    rare words weigh nothing; the driver gets at most two to SLOT_BITS sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            packed = b.column(0).to_pylist()
            for at in range(0, len(packed), 256):
                words = [_slots(w) for w in _words(packed[at : at + 256])]
                count += np.bincount(np.concatenate(words), minlength=len(count))
        out = np.flatnonzero(count >= OFTEN)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out, pa.int64()), pa.array(count[out], pa.int64())], names=["slot", "n"]
        )

    found = (
        classes.select("packed")
        .mapInArrow(run, "slot bigint, n bigint")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    weights = np.zeros(1 << SLOT_BITS, np.int16)
    weights[found["slot"].to_numpy(dtype=np.int64)] = np.round(
        8 * np.log2(1.0 + found["n"].to_numpy(dtype=float))
    )
    return weights


def rare_first(words: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
    """The distinct shingles in the one order of all tokens: by the weights of their words, then by number."""
    tokens, at = np.unique(shingle(words, k), return_index=True)
    w = weights[_slots(words)].astype(np.int64)
    k = min(k, len(words))
    total = sum((w[i : len(w) - k + 1 + i] for i in range(k)), np.zeros(len(w) - k + 1, np.int64))
    return tokens[np.argsort(total[at], kind="stable")]


def meeting_tokens(
    classes: DataFrame, weights: np.ndarray, words: int, percent: int
) -> DataFrame:
    """(token, root, n): the tokens of each class in which it must meet every class it is linked to.

    Two linked sets have at least ``needed`` tokens in common, so the first
    n - needed + k of either, in one order of all tokens, share k of them; k is
    SHARED, or less for sets that need not have so many in common.  Any order
    gives whole results; this one begins with shingles of rare words, which
    texts that aren't linked seldom share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, packed = b.column(0), b.column(1).to_pylist()
            for at in range(0, len(packed), 256):
                tokens, sizes = [], []
                for w in _words(packed[at : at + 256]):
                    s = rare_first(w, words, weights)
                    least = needed(len(s), percent)
                    tokens.append(s[: len(s) - least + min(SHARED, least)].view(np.int64))
                    sizes.append(len(s))
                which = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens), pa.int64()),
                        roots.slice(at, 256).take(pa.array(which)),
                        pa.array(np.asarray(sizes, np.int64)[which]),
                    ],
                    names=["token", "root", "n"],
                )

    kind = classes.schema["root"].dataType.simpleString()
    return classes.select("root", "packed").mapInArrow(run, f"token bigint, root {kind}, n bigint")


def _verified(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, packed_a, packed_b) that are linked."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                left = _opened(part.column(2).to_pylist(), words)
                right = _opened(part.column(3).to_pylist(), words)
                good = pa.array([linked(x, y, percent) for x, y in zip(left, right)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"]
                )

    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, f"a {kind}, b {kind}")


def shared_tokens(meeting: DataFrame, percent: int) -> DataFrame:
    """Rows of tokens that several classes have, of classes with as many of them as a link takes."""
    several = (
        meeting.groupBy("token")
        .agg(F.min("root").alias("a"), F.max("root").alias("b"))
        .where("a < b")
        .select("token")
    )
    rows = write_once(meeting.join(several, "token", "left_semi"), "shared")
    enough = rows.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    enough = enough.where(F.col("k") >= shared_column(F.col("least"), percent)).select("root")
    return write_once(rows.join(enough, "root", "left_semi"), "shared")


def hub_pairs(meeting: DataFrame, percent: int) -> DataFrame:
    """(root, hub): of the smallest classes under a class's tokens, the one it meets most often.

    Classes that meet none of them often enough for a link have no hub.
    """
    hubs = (
        meeting.groupBy("token")
        .agg(F.min("root").alias("hub"), F.max("root").alias("last"))
        .where("hub < last")
        .select("token", "hub")
    )
    met = (
        meeting.join(hubs, "token")
        .groupBy("root", "hub")
        .agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"))
        .where(F.col("k") >= shared_column(F.col("n"), percent))
    )
    best = F.max(F.struct("k", (-F.col("hub")).alias("minus"))).alias("best")
    return (
        met.where("root > hub")
        .groupBy("root")
        .agg(best)
        .select("root", (-F.col("best.minus")).alias("hub"))
    )


def open_groups(
    meeting: DataFrame, classes: DataFrame, grouped: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links (a, b) between classes of different components.

    ``grouped`` (root, hub, component) puts classes into groups around a hub; a
    class that is not in it is a group of its own.  A query is sent to a group if
    it shares as many meeting tokens with it as with a linked member, one of
    another component; the group's union then bounds the overlap with any of its
    members before they are looked at.
    """
    kind = classes.schema["root"].dataType.simpleString()
    rows = meeting.join(grouped, "root", "left").select(
        "token",
        "root",
        "n",
        F.coalesce("hub", "root").alias("hub"),
        F.coalesce("component", "root").alias("component"),
    )
    rows = write_once(rows, "placed")
    open_tokens = (
        rows.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("token")
    )
    rows = rows.join(open_tokens, "token", "left_semi")
    groups = rows.select("root", "hub", "component").distinct()
    sizes = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    part = F.pmod(F.xxhash64("root"), F.ceil(F.col("members") / GROUP))
    groups = write_once(
        groups.join(sizes, "hub").select("root", "hub", "component", part.alias("part")), "groups"
    )
    # The matrix: one row per token and group, however many members have the token.
    matrix = (
        rows.select("token", "root", "n")
        .join(groups, "root")
        .groupBy("token", "hub", "part")
        .agg(
            F.min("component").alias("low"), F.min("n").alias("least"), F.max("n").alias("most")
        )
    )
    queries = write_once(
        rows.select("token", "root", "n", F.col("component").alias("own"))
        .join(matrix, "token")
        .where(
            (F.col("own") > F.col("low"))
            & (100 * F.col("least") <= F.floor(100 * F.col("n") * 100 / percent))
            & (100 * F.col("most") >= percent * F.col("n"))
        )
        .groupBy("root", "own", "hub", "part")
        .agg(F.count(F.lit(1)).alias("k"), F.least(F.min("n"), F.min("least")).alias("n"))
        .where(F.col("k") >= shared_column(F.col("n"), percent))
        .select("root", "own", "hub", "part"),
        "queries",
    )
    # A hub of common passages may be asked by a large part of all classes, so the queries of a group
    # are dealt into lots.
    opened = queries.groupBy("hub", "part").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("lots"))
    opened = write_once(opened, "opened")
    lots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))
    members = groups.join(opened, ["hub", "part"]).withColumn("lot", lots).drop("lots")
    lot = F.pmod(F.xxhash64("root", F.lit("lot")), F.col("lots"))
    queries = queries.join(opened, ["hub", "part"]).withColumn("lot", lot)
    packed = classes.select("root", "packed")
    asked = queries.join(packed, "root").select(
        F.col("root").alias("asked"),
        "own",
        F.col("hub").alias("q_hub"),
        F.col("part").alias("q_part"),
        F.col("lot").alias("q_lot"),
        F.col("packed").alias("q_packed"),
    )
    members = write_once(members, "members").join(packed, "root")

    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        ids = members.column("root").to_pylist()
        of = members.column("component").to_pylist()
        sets = _opened(members.column("packed").to_pylist(), words)
        union = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        found: list[tuple] = []
        for batch in asked.to_batches(max_chunksize=256):
            at = {n: batch.column(n) for n in ("asked", "own", "q_packed")}
            queries = _opened(at["q_packed"].to_pylist(), words)
            for root, own, q in zip(at["asked"].to_pylist(), at["own"].to_pylist(), queries):
                if overlap(q, union) < needed(len(q), percent):
                    continue  # no member can be linked: the group stays closed
                found += [
                    (root, i)
                    for i, c, s in zip(ids, of, sets)
                    if c < own and linked(q, s, percent)
                ]
        schema = pa.schema(
            [("a", asked.schema.field("asked").type), ("b", asked.schema.field("asked").type)]
        )
        return pa.table([[a for a, _ in found], [b for _, b in found]], schema=schema)

    return (
        members.groupBy("hub", "part", "lot")
        .cogroup(asked.groupBy("q_hub", "q_part", "q_lot"))
        .applyInArrow(run, f"a {kind}, b {kind}")
    )


def _class_number() -> Column:
    """A number from 0 on that names the class of a set's name."""
    return F.shiftrightunsigned(F.xxhash64("name"), 1)


def _prepared(
    docs: DataFrame, words: int, percent: int, text: str, numbered: bool = False
) -> tuple[DataFrame, ...]:
    """Sets of all rows, roots of their classes, classes that may have links, their meeting tokens and hubs.

    A class goes by its root, or by its number: a document of several texts may
    be the root of several classes.
    """
    sets = write_once(named_sets(docs, words, text), "sets")
    roots = (
        sets.where("name IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("name")
        .agg(F.min("doc_id").alias("root"))
    )
    # One text per set, that of the smallest document.
    classes = (
        packed_texts(docs, words, text)
        .join(roots, "name")
        .where("doc_id = root")
        .select("name", "root", "packed")
        .dropDuplicates(["name"])
        .select((_class_number() if numbered else F.col("root")).alias("root"), "packed")
    )
    classes = write_once(classes, "classes")
    weights = word_weights(classes)
    meeting = write_once(meeting_tokens(classes, weights, words, percent), "meeting")
    meeting = shared_tokens(meeting, percent)
    hubs = write_once(hub_pairs(meeting, percent), "hubs")
    # Only these classes can have a link.  Their list grows with the corpus, so it is never broadcast.
    near = meeting.select("root").distinct().hint("merge")
    classes = write_once(classes.join(near, "root", "left_semi"), "near")
    return sets, roots, classes, meeting, hubs


def class_pairs(
    meeting: DataFrame, classes: DataFrame, hubs: DataFrame, words: int, percent: int
) -> DataFrame:
    """(a, b), a > b: every two different classes that are linked, once, each verified on the texts.

    Every class counts as a component of its own, so no link is left out as known.
    """
    paired = hubs.select(F.explode(F.array("root", "hub")).alias("root")).distinct()
    grouped = paired.join(hubs, "root", "left").select(
        "root", F.coalesce("hub", "root").alias("hub"), F.col("root").alias("component")
    )
    return open_groups(meeting, classes, write_once(grouped, "grouped"), words, percent)


def jaccard_links(docs: DataFrame, words: int = 3, percent: int = 90, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs`` (doc_id, text).

    As ``jaccard_groups``, but every link is sought.  ``n_links`` counts the
    other pairs of a document and a set of it that are linked with the row's,
    equal sets included; where a doc_id has one text, that is the number of
    documents linked with it.  Rows without shingles or without a doc_id have no
    links.  The links of a group of near copies grow with the square of its
    classes.
    """
    sets, roots, classes, meeting, hubs = _prepared(docs, words, percent, text, numbered=True)
    pairs = write_once(class_pairs(meeting, classes, hubs, words, percent), "pairs")
    named = sets.where("doc_id IS NOT NULL").select("name", "doc_id").distinct().join(roots, "name")
    named = write_once(named.withColumn("class", _class_number()), "named")
    sizes = named.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("root"))
    sizes = write_once(sizes, "sizes")
    of = sizes.select(F.col("class").alias("b"), "size")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(of, "b").groupBy(F.col("a").alias("class")).agg(F.sum("size").alias("further"))
    counts = sizes.join(near, "class", "left").select(
        "class", (F.col("size") - 1 + F.coalesce("further", F.lit(0))).alias("n_links")
    )
    documents = pairs
    for end in ("a", "b"):
        root = sizes.select(F.col("class").alias(end), F.col("root").alias(f"_{end}"))
        documents = documents.join(root, end)
    links = documents.select(F.col("_a").alias("a"), F.col("_b").alias("b")).unionByName(
        named.where("doc_id > root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    )
    found = components(write_once(links, "links"))
    rows = sets.select("doc_id", "n", F.when(F.col("name").isNotNull(), _class_number()).alias("class"))
    return (
        rows.join(found.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "doc_id", "left")
        .join(counts, "class", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("n_links"),
        )
    )


def jaccard_groups(
    docs: DataFrame, words: int = 3, percent: int = 90, text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= percent * union of
    their sets of word shingles; ``component_id`` is the smallest doc_id
    reachable by links.  No link between different sets is lost; links inside a
    component that is known already are not sought.

    Null and empty texts, and texts of white space, have no shingles and stand
    alone.  A repeated row gives a repeated result.  Rows of one doc_id with
    different texts are one document: what is linked with one is linked with
    all.  A null doc_id names no document; such a row is linked with nothing
    and has a null component.  An empty table gives no row, columns other than
    doc_id and the text are not read.
    """
    sets, roots, classes, meeting, hubs = _prepared(docs, words, percent, text)
    pairs = (
        hubs.select(F.col("root").alias("a"), F.col("hub").alias("b"))
        .join(classes.select(F.col("root").alias("a"), F.col("packed").alias("packed_a")), "a")
        .join(classes.select(F.col("root").alias("b"), F.col("packed").alias("packed_b")), "b")
    )
    named = sets.where("doc_id IS NOT NULL").select("name", "doc_id").join(roots, "name")
    copies = named.where("doc_id > root").select(
        F.col("doc_id").alias("a"), F.col("root").alias("b")
    )
    known = write_once(
        _verified(pairs, words, percent).unionByName(copies).distinct(), "links"
    )
    first = write_once(components(known), "components")
    paired = hubs.select(F.explode(F.array("root", "hub")).alias("root")).distinct()
    grouped = (
        paired.join(hubs, "root", "left")
        .join(first.select(F.col("node").alias("root"), F.col("root").alias("_c")), "root", "left")
        .select(
            "root",
            F.coalesce("hub", "root").alias("hub"),
            F.coalesce("_c", "root").alias("component"),
        )
    )
    further = open_groups(meeting, classes, write_once(grouped, "grouped"), words, percent)
    # Components become nodes: what the first round has joined needs no second look.
    of = first.select("node", F.col("root").alias("of"))
    raised = (
        further.join(of.withColumnRenamed("node", "a").withColumnRenamed("of", "of_a"), "a", "left")
        .join(of.withColumnRenamed("node", "b").withColumnRenamed("of", "of_b"), "b", "left")
        .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    )
    second = components(write_once(raised, "links"))
    final = (
        first.select("node", F.col("root").alias("mid"))
        .unionByName(
            second.select("node", F.col("node").alias("mid")).join(
                first.select("node"), "node", "left_anti"
            )
        )
        .join(second.select(F.col("node").alias("mid"), "root"), "mid", "left")
        .select("node", F.coalesce("root", "mid").alias("component_id"))
    )
    return (
        sets.select("doc_id", F.col("n").alias("n_shingles"))
        .join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id")
    )
