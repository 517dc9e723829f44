"""Token counts by heap-and-linked-list byte-pair merging (operator 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.pieces import Vocabulary, chunks
from cohortflow.llm.texts import map_texts

# Chunks, and words, that a worker remembers before it starts afresh; a bound on memory, not on results.
REMEMBERED = 1_000_000
# Longer chunks and words are counted anew each time, so that what is remembered is bounded in bytes too.
LONGEST = 64

# What this worker process has counted, by the vocabulary's name; later tasks go on with it.
_known: dict[str, tuple[dict[str, int], dict[str, int]]] = {}


def counter(vocabulary: Vocabulary):
    """A function from a text to its number of tokens."""
    split, count = vocabulary.splitter(), vocabulary.count
    of_chunk, of_word = _known.setdefault(vocabulary.name, ({}, {}))

    def word(w: str) -> int:
        n = of_word.get(w)
        if n is None:
            n = count(w)
            if len(w) <= LONGEST:
                of_word[w] = n
        return n

    def total(text: str) -> int:
        parts = chunks(text)
        try:
            return sum(map(of_chunk.__getitem__, parts))
        except KeyError:
            for known in (of_chunk, of_word):
                if len(known) > REMEMBERED:
                    known.clear()
            new = {c: sum(map(word, split(c))) for c in set(parts).difference(of_chunk)}
            found = sum(new[c] if c in new else of_chunk[c] for c in parts)
            of_chunk.update((c, n) for c, n in new.items() if len(c) <= LONGEST)
            return found

    return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    A word's count is its start symbols less its merges; no ids are made.
    Null and empty texts have 0 bytes and 0 tokens.  Rows are taken one by one:
    a repeated row gives a repeated result, a null doc_id stays null, an empty
    table gives no row, other columns are not read.
    """

    def make():
        total = counter(vocabulary)

        def run(texts: list) -> list[list]:
            texts = [t or "" for t in texts]
            return [[len(t.encode("utf-8")) for t in texts], [total(t) for t in texts]]

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(docs, make, fields).withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
