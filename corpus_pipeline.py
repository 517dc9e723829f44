"""Documents to token ids: rules, line dedup, near-duplicate groups, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; all but the last return the columns of ``docs``.  Stages carry the whole
row as one struct, so columns may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.bpe import encode_decode
from cohortflow.llm.decontaminate import contaminated
from cohortflow.llm.jaccard_join import jaccard_groups
from cohortflow.llm.line_dedup import dedup_lines
from cohortflow.llm.pieces import Vocabulary
from cohortflow.llm.quality_rules import ALL_RULES, CORPUS, apply_policy, ledger
from cohortflow.llm.texts import write_once
from cohortflow.session import configure

VOCABULARY = "word_bpe_49k.json"


# Rows that travel to a Python worker at once: a worker keeps the memory of its largest batch, and
# the stages share the workers.
BATCH_ROWS = 1000


def _configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return configure(spark)


def _named(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*_named(docs)).alias("_row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the corpus policy rejects; null and empty texts go."""
    _configured(spark)
    entries = apply_policy(ledger(_carried(docs), ALL_RULES, keep=["_row"]), CORPUS, kept="_kept")
    return entries.where("_kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated lines; a document of which nothing but white space is left goes.

    ``n_chars``, if there is one, follows the new text.  Null texts stay.
    """
    _configured(spark)
    rows = dedup_lines(_carried(docs), keep=["_row"])
    rows = rows.where("n_removed = 0 OR kept RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        length = F.length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("_row.n_chars"))
    old = {c: F.col("_row").getField(c) for c in docs.columns}
    return rows.select(*[new.get(c, old[c]).alias(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates: five words, similarity 0.8 or more.

    Rows without a doc_id or without words belong to no group and stay, rows of
    one doc_id stay or go together.
    """
    _configured(spark)
    groups = jaccard_groups(docs, words=5, percent=80)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_named(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts stay."""
    _configured(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated(_carried(docs), items, keep=["_row"])
    return found.where(F.size("matches") == 0).select("_row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text of every document."""
    _configured(spark)
    vocabulary = Vocabulary.load(public_tokenizers.path(VOCABULARY))
    return encode_decode(docs, vocabulary).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

# Rolling token merges and alignments are beyond SQL; the tests run the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
