"""Benchmark decontamination: word seeds, then Smith-Waterman alignment (operator 4).

A match needs a least score, so it has a least number of equal words within a
greatest number of words of the text.  Of an item's words, rarest first, as many
are seeds as it takes for every match to hold several of them; texts are aligned
where that many lie close enough together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.shingles import word_hashes
from cohortflow.llm.texts import map_texts, slices

# Words of an item at least, and the least score of a match as a share of the item's own.
MIN_WORDS = 5
THRESHOLD = 0.6
# Of the equal words of the shortest match, one in so many must be seeds.
SEEDED = 5
# Alignment of words: what a pair of equal words adds, and what other pairs and gaps cost.
MATCH, MISMATCH, GAP = 2, 1, 1
# Bytes of test items that one pass over the documents takes; more items take more passes.
PASS_BYTES = 32 << 20
# Words of texts, pairs of a word and an item's seed, and cells of a row of the alignment that are
# worked on together; they bound the arrays.
WORDS_AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 20
CELLS_AT_ONCE = 1 << 20

# Marks next to words don't count: they become spaces.
_MARKS = bytes.maketrans(
    b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * len(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
)


def words_of(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Numbers of the words of texts, in lower case and without ASCII marks."""
    return word_hashes([(t or "").lower().encode("utf-8").translate(_MARKS) for t in texts], lower=False)


@dataclass(frozen=True)
class Items:
    """Test items of one pass, and how often the documents have each of their distinct words.

    ``least`` words make an item; shorter ones match nothing.
    """

    ids: list
    words: list[np.ndarray]
    least: int
    known: np.ndarray
    often: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[tuple], min_words: int) -> Items:
        words = words_of([t for _, t in rows])
        long = [w for w in words if len(w) >= min_words]
        known = np.unique(np.concatenate([*long, np.zeros(0, np.uint64)]))
        return cls([i for i, _ in rows], words, min_words, known, np.zeros(len(known), np.int64))

    def counted(self, often: np.ndarray) -> Items:
        return Items(self.ids, self.words, self.least, self.known, often)


def least_score(size: int, threshold: float) -> int:
    """The least score above 0 that is ``threshold`` of an item of so many words."""
    score = max(1, int(threshold * MATCH * size) - 1)
    while score / (MATCH * size) < threshold:
        score += 1
    return score


@dataclass(frozen=True)
class Seeds:
    """The words that are seeds, sorted, the items of each (from ``start``), and what a match of an item has.

    A score of C takes m >= C / MATCH equal words and leaves (MATCH * m - C) for
    what other pairs and gaps cost, so the match spans so many words of the text
    more than m at most: ``span``.  All but n - m of the item's n words are
    equal, so of any n - m + t of them at least t are: ``hits``.
    """

    word: np.ndarray
    start: np.ndarray
    item: np.ndarray
    hits: np.ndarray
    span: np.ndarray

    @classmethod
    def of(cls, items: Items, threshold: float) -> Seeds:
        hits, span = np.ones(len(items.words), np.int64), np.ones(len(items.words), np.int64)
        words, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(items.words):
            n = len(w)
            if n < max(1, items.least) or (score := least_score(n, threshold)) > MATCH * n:
                continue
            equal = -(-score // MATCH)
            hits[i] = -(-equal // SEEDED)
            span[i] = n + (MATCH * n - score) // min(MISMATCH, GAP)
            at = np.searchsorted(items.known, w)
            rare = at[np.argsort(items.often[at], kind="stable")]
            words.append(np.unique(rare[: n - equal + hits[i]]))
            of.append(np.full(len(words[-1]), i))
        at, item = np.concatenate(words), np.concatenate(of)
        order = np.argsort(at, kind="stable")
        seed, n = np.unique(at, return_counts=True)
        start = np.concatenate([[0], np.cumsum(n)])
        return cls(items.known[seed], start, item[order], hits, span)


def _found(table: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are in a sorted table, and where."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    which = np.flatnonzero(table[at] == words)
    return which, at[which]


def passes(items: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[tuple]]:
    """Distinct items (id, text) in lots of bounded size; each is collected when its pass begins."""
    rows = (
        items.where(F.col("text").isNotNull())
        .select("item_id", "text")
        .distinct()
        .withColumn("_size", F.octet_length("text").cast("bigint"))
        .withColumn("_key", F.xxhash64("item_id", "text"))
    )
    total = rows.agg(F.sum("_size")).first()[0] or 0
    lots = max(1, -(-2 * int(total) // pass_bytes))
    for lot in range(lots):
        found = rows.where(F.pmod("_key", F.lit(lots)) == lot).collect()
        if found:
            yield sorted(((r.item_id, r.text) for r in found), key=repr)


def counted(docs: DataFrame, items: Items, text: str) -> Items:
    """Items with the number of times that all documents have each of their words.

    It says which words make good seeds; the matches are the same for any numbers.
    """
    known = items.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(known), np.int64)
        for whole in batches:
            for b in slices(whole, 0):
                for w in _together(words_of(b.column(0).to_pylist())):
                    count += np.bincount(_found(known, np.concatenate(w))[1], minlength=len(known))
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hit, pa.int64()), pa.array(count[hit], pa.int64())], names=["word", "n"]
        )

    rows = (
        docs.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    )
    often = np.zeros(len(known), np.int64)
    for r in rows.collect():
        often[r.word] = r.n
    return items.counted(often)


def _together(words: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in order, in lots of at most WORDS_AT_ONCE words or one text."""
    at, held = 0, 0
    for t, w in enumerate(words):
        if t > at and held + len(w) > WORDS_AT_ONCE:
            yield words[at:t]
            at, held = t, 0
        held += len(w)
    if at < len(words):
        yield words[at:]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of an item with each row of ``windows``: score, first and last word.

    Smith-Waterman over words, all windows at once, a row of the table per word
    of the item.  A gap along the window is a running maximum of the score with
    the gap's slope taken off.  Among equal scores the first end counts.
    """
    n, width = windows.shape
    slope = np.arange(width + 1) * GAP
    score = np.zeros((n, width + 1), np.int32)
    begin = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (n, width + 1)).copy()
    best = np.zeros(n, np.int32)
    first, last = np.zeros(n, np.int32), np.full(n, -1, np.int32)
    rows = np.arange(n)
    here = np.arange(width + 1, dtype=np.int32)
    for w in item:
        step = np.where(windows == w, MATCH, -MISMATCH).astype(np.int32)
        cell, start = score - GAP, begin.copy()
        diagonal = score[:, :-1] + step
        better = diagonal >= cell[:, 1:]
        cell[:, 1:] = np.where(better, diagonal, cell[:, 1:])
        start[:, 1:] = np.where(better, begin[:, :-1], start[:, 1:])
        start = np.where(cell > 0, start, here)
        cell = np.maximum(cell, 0)
        raised = cell + slope
        top = np.maximum.accumulate(raised, axis=1)
        from_ = np.maximum.accumulate(np.where(raised == top, here, 0), axis=1)
        score = (top - slope).astype(np.int32)
        begin = np.take_along_axis(start, from_.astype(np.int64), axis=1)
        begin = np.where(score > 0, begin, here)
        end = score.argmax(axis=1)
        value = score[rows, end]
        more = value > best
        best = np.where(more, value, best)
        first = np.where(more, begin[rows, end], first)
        last = np.where(more, end - 1, last)
    return best, first, last


def windows_of(words: list[np.ndarray], seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """(item, text, from, to): the stretches of texts that hold all matches of the item.

    ``hits`` seeds of an item within ``span`` words open a stretch that takes in
    whatever match may hold them; stretches that overlap are one.
    """
    sizes = np.array([len(w) for w in words])
    widest = int(seeds.span.max(initial=0))
    # Places in one row of all texts, so far apart that no stretch reaches the next text.
    begin = np.cumsum(sizes + 2 * widest) - sizes - 2 * widest
    which, at = _found(seeds.word, np.concatenate(words))
    if not len(which):
        return
    text = np.repeat(np.arange(len(words)), sizes)[which]
    place = which + 2 * widest * text
    n = np.diff(seeds.start)[at]
    pairs = np.cumsum(n)
    lo = 0
    while lo < len(which):
        # Windows begin in lo:hi and end before ``to``.
        hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        to = int(np.searchsorted(place, place[hi - 1] + widest))
        m = n[lo:to]
        entry = np.repeat(seeds.start[at[lo:to]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        hit = np.repeat(np.arange(lo, to), m)
        item = seeds.item[entry]
        order = np.argsort(item, kind="stable")
        item, hit = item[order], hit[order]
        last = np.arange(len(item)) + seeds.hits[item] - 1
        inside = np.minimum(last, len(item) - 1)
        near = (last == inside) & (item[inside] == item) & (hit < hi)
        near &= place[hit[inside]] - place[hit] < seeds.span[item]
        first = np.flatnonzero(near)
        if len(first):
            item, span = item[first], seeds.span[item[first]]
            a, b = place[hit[inside[first]]] - span + 1, place[hit[first]] + span
            new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (a[1:] >= b[:-1])])
            end = np.r_[new[1:], len(first)] - 1
            of = text[hit[first[new]]]
            a = np.maximum(a[new] - begin[of], 0)
            b = np.minimum(b[end] - begin[of], sizes[of])
            yield from zip(item[new].tolist(), of.tolist(), a.tolist(), b.tolist())
        lo = hi


def matches_type(item_id: T.DataType) -> T.ArrayType:
    """Matches with ids of the items' own type."""
    return T.ArrayType(
        T.StructType(
            [
                T.StructField("item_id", item_id),
                T.StructField("score", T.DoubleType()),
                T.StructField("first_word", T.LongType()),
                T.StructField("last_word", T.LongType()),
            ]
        )
    )


def find_matches(
    texts: list, items: Items, min_words: int, threshold: float, seeds: Seeds | None = None
) -> list[list[dict]]:
    """Per text, the best alignment with each item that reaches the threshold, by item."""
    seeds = seeds or Seeds.of(items, threshold)
    words = words_of(texts)
    best: list[dict[int, dict]] = [{} for _ in texts]
    done = 0
    for lot in _together(words):
        asked: dict[int, list[tuple[int, int, int]]] = {}
        for i, t, a, b in windows_of(lot, seeds):
            asked.setdefault(i, []).append((b - a, t, a))
        for i, stretches in asked.items():
            stretches.sort()  # stretches of like width are aligned together
            _align_all(i, items, stretches, lot, threshold, best[done : done + len(lot)])
        done += len(lot)
    return [[found[i] for i in sorted(found)] for found in best]


def _align_all(
    i: int,
    items: Items,
    stretches: list[tuple[int, int, int]],
    words: list[np.ndarray],
    threshold: float,
    best: list[dict[int, dict]],
) -> None:
    """Align an item with stretches (width, text, from) and keep the best match of each text in ``best``."""
    item, at = items.words[i], 0
    while at < len(stretches):
        part = stretches[at : at + 64]
        part = part[: max(1, CELLS_AT_ONCE // part[-1][0])]
        at += len(part)
        table = np.zeros((len(part), part[-1][0]), np.uint64)
        inside = np.zeros(table.shape, bool)
        for r, (width, t, a) in enumerate(part):
            table[r, :width] = words[t][a : a + width]
            inside[r, :width] = True
        table[~inside] = _other(item)
        scores, first, last = align(item, table)
        for (_, t, a), s, x, y in zip(part, scores.tolist(), first.tolist(), last.tolist()):
            share = s / (MATCH * len(item))
            old = best[t].get(i)
            if share < threshold:
                continue
            if old is None or (share, -(a + y)) > (old["score"], -old["last_word"]):
                best[t][i] = {
                    "item_id": items.ids[i],
                    "score": share,
                    "first_word": a + x,
                    "last_word": a + y,
                }


def _other(item: np.ndarray) -> np.uint64:
    """A number that no word of the item has."""
    taken = set(item.tolist())
    return np.uint64(next(x for x in range(len(taken) + 1) if x not in taken))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = MIN_WORDS,
    threshold: float = THRESHOLD,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``keep`` and ``matches`` (item_id, score, first_word, last_word) of every row of ``docs``.

    ``items`` (item_id, text) are the benchmark.  A match is a local alignment of
    words whose score is ``threshold`` of the item's with itself; none is lost,
    wherever its words differ and however many documents have it.  Words are in
    lower case, ASCII marks don't count.  A text may match several items; of
    several alignments with one item the best counts, the first of equal ones.

    Null and empty texts match nothing; nor do items that are null or under
    ``min_words`` words, which can't be told from chance.  Repeated rows of
    ``docs`` give repeated results, repeated items count once, null ids stay
    null.  Without items, no row has a match; an empty table gives no row.
    ``matches`` may not be among ``keep``.  Items are taken in lots of bounded
    size, each in a pass over the texts.
    """
    found, kind = None, matches_type(items.schema["item_id"].dataType)
    for lot in passes(items, pass_bytes):
        table = counted(docs, Items.of(lot, min_words), text)

        def make(table: Items = table):
            seeds = Seeds.of(table, threshold)
            return lambda texts: [find_matches(texts, table, min_words, threshold, seeds)]

        if found is None:
            found = map_texts(docs, make, [T.StructField("matches", kind)], keep=[*keep, text], text=text)
        else:
            more = [T.StructField("_more", kind)]
            found = map_texts(found, make, more, keep=[*keep, text, "matches"], text=text)
            found = found.withColumn("matches", F.concat("matches", "_more")).drop("_more")
    if found is None:
        found = docs.select(*dict.fromkeys([*keep, text])).withColumn("matches", F.array().cast(kind))
    return found.select(*keep, "matches")
