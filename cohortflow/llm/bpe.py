"""Byte-pair encoding and decoding by a table of distinct words (operator 10).

Documents are dealt into blocks.  A block sends its distinct words (the runs
between white space) to the word table, which encodes each word once for the
whole corpus; the ids come back to the block and are put in the words'
positions.  Decoding looks ids up in the id-to-piece table, a dict in each task
of a block, and is no join of Spark.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortflow.llm.pieces import Vocabulary, chunks

# Bytes of text in a block, and the parts that the word table is dealt in.
BLOCK_BYTES = 16 << 20
WORD_PARTS = 512


def _pack(words: list[str]) -> bytes:
    """Words have no line feed in them, as it is white space."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join(words).encode("utf-8"))


def _unpack(blob: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8").split("\n")


def _part(word: str) -> int:
    """Spellings that differ in case and outer marks meet in one part, where their word is merged once."""
    return zlib.crc32(word.lower().strip(".,!?;:\"'()").encode("utf-8")) % WORD_PARTS


def block_count(docs: DataFrame, text: str = "text") -> int:
    """Blocks of about BLOCK_BYTES for all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // BLOCK_BYTES))


def blocks(docs: DataFrame, n_blocks: int, text: str = "text") -> DataFrame:
    """(doc_id, copies, block, packed): rows that repeat within a batch are one row with a count."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("copies", T.LongType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("packed", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            rows = Counter(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            raw = [(t or "").encode("utf-8") for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in rows], arrow.field(0).type),
                    pa.array(list(rows.values()), arrow.field(1).type),
                    pa.array(
                        [
                            zlib.crc32(r, zlib.crc32(str(d).encode())) % n_blocks
                            for (d, _), r in zip(rows, raw)
                        ],
                        arrow.field(2).type,
                    ),
                    pa.array([shrink(r) if r else b"" for r in raw], arrow.field(3).type),
                ],
                schema=arrow,
            )

    return docs.select("doc_id", text).mapInArrow(run, schema).repartition(n_blocks, "block")


def _text(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8") if packed else ""


def _dealt(words: set[str]) -> dict[int, list[str]]:
    """Words by the part of the word table they go to, each list in order."""
    parts: dict[int, list[str]] = {}
    for w in sorted(words):
        parts.setdefault(_part(w), []).append(w)
    return parts


def word_rows(dealt: DataFrame) -> DataFrame:
    """(part, block, words): a block's distinct words by the part that encodes them."""

    def run(table: pa.Table) -> pa.Table:
        seen: set[str] = set()
        for p in table.column("packed"):
            seen.update(chunks(_text(p.as_py())))
        parts = _dealt(seen)
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "part": pa.array(list(parts), pa.int32()),
                "block": pa.array([block] * len(parts), pa.int32()),
                "words": pa.array([_pack(w) for w in parts.values()], pa.binary()),
            }
        )

    return dealt.groupBy("block").applyInArrow(run, "part int, block int, words binary")


def word_ids(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(block, part, lengths, ids): the word table's answer to each row of ``word_rows``.

    All rows of a word meet in one part, so it is encoded once.  The words aren't
    sent back: the block knows their order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, encode = vocabulary.splitter(), vocabulary.encode
        table: dict[str, list[int]] = {}
        of_word: dict[str, list[int]] = {}
        part = None
        for b in batches:
            lengths, ids = [], []
            for p, blob in zip(b.column("part").to_pylist(), b.column("words").to_pylist()):
                if p != part:  # rows come in order of the parts
                    part, table, of_word = p, {}, {}
                found = []
                for w in _unpack(blob):
                    if w not in table:
                        out: list[int] = []
                        for x in split(w):
                            if x not in of_word:
                                of_word[x] = encode(x)
                            out += of_word[x]
                        table[w] = out
                    found.append(table[w])
                lengths.append(np.fromiter(map(len, found), "<u4", len(found)).tobytes())
                ids.append(np.asarray([i for f in found for i in f], "<u4").tobytes())
            shrink = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("block"),
                    b.column("part"),
                    pa.array([shrink(x) for x in lengths], pa.binary()),
                    pa.array([shrink(x) for x in ids], pa.binary()),
                ],
                names=["block", "part", "lengths", "ids"],
            )

    return (
        rows.repartition(n, "part")
        .sortWithinPartitions("part", "block")
        .mapInArrow(run, "block int, part int, lengths binary, ids binary")
    )


def _numbered(packed: list[bytes]) -> tuple[dict[str, int], list[np.ndarray]]:
    """A number for each distinct word of the texts, and the texts as numbers; words are not kept as often as they occur."""
    number: dict[str, int] = {}
    texts, held = [], 0
    for p in packed:
        words = chunks(_text(p))
        # A word's number is the place of its first occurrence in the block.
        texts.append(np.fromiter(map(number.setdefault, words, count(held)), np.int64, len(words)))
        held += len(words)
    return number, texts


def _joined(number: dict[str, int], answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place of each word by its number, and the start, the length and the ids of each place."""
    open_ = zstandard.ZstdDecompressor().decompress
    parts = _dealt(set(number))
    rows = sorted(zip(*[answers.column(c).to_pylist() for c in ("part", "lengths", "ids")]))
    place = np.zeros(max(number.values(), default=-1) + 1, np.int32)
    ordered = [number[w] for part, _, _ in rows for w in parts[part]]
    place[ordered] = np.arange(len(ordered))
    size, ids = (
        np.frombuffer(b"".join(open_(r[c]) for r in rows), "<u4").astype(np.int64) for c in (1, 2)
    )
    return place, np.cumsum(size) - size, size, ids


def encode_decode(
    docs: DataFrame, vocabulary: Vocabulary, with_outputs: bool = True, text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded of every row.

    Null and empty texts have no ids and decode to the empty text.  A repeated
    row gives a repeated result, a null doc_id stays null, an empty table gives
    no row, columns other than doc_id and the text are not read.
    """
    outputs = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("copies", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
            *(outputs if with_outputs else []),
        ]
    )
    arrow = to_arrow_schema(schema)
    id_to_piece = dict(vocabulary.piece_rows())

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        number, numbered = _numbered(texts.column("packed").to_pylist())
        place, start, size, ids = _joined(number, answers)
        del number
        pieces = list(map(id_to_piece.__getitem__, ids.tolist()))
        spelled = [" ".join(pieces[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]
        out: list[list] = [[] for _ in range(len(schema) - 2)]
        for words in numbered:
            at = place[words]
            n = size[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            of = ids[np.arange(total) + np.repeat(start[at] - (ends - n), n)] if total else ids[:0]
            decoded = " ".join([spelled[i] for i in at.tolist()])
            row = [
                total,
                hashlib.sha256(of.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                of.astype(np.int32),
                decoded,
            ]
            for column, value in zip(out, row):
                column.append(value)
        made = [pa.array(v, arrow.field(2 + i).type) for i, v in enumerate(out)]
        return pa.Table.from_arrays(
            [texts.column("doc_id").cast(arrow.field(0).type), texts.column("copies"), *made],
            schema=arrow,
        )

    dealt = blocks(docs, block_count(docs, text), text)
    answers = word_ids(word_rows(dealt), vocabulary)
    rows = (
        dealt.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(run, schema)
    )
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return rows.withColumn("copies", again).drop("copies")
