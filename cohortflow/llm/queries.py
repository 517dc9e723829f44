"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import queries_more  # registers its queries  # noqa: F401
from cohortflow.llm.bpe import encode_decode
from cohortflow.llm.decontaminate import contaminated
from cohortflow.llm.jaccard_join import jaccard_groups, jaccard_links
from cohortflow.llm.language import fit_language, language_spans
from cohortflow.llm.line_dedup import MIN_BYTES, MIN_LINES, dedup_lines
from cohortflow.llm.measures import STRETCH
from cohortflow.llm.pieces import Vocabulary
from cohortflow.llm.quality_model import fit_quality, score_quality
from cohortflow.llm.quality_rules import BASE, PRODUCTION, apply_policy, ledger
from cohortflow.llm.registry import ORACLES, QUERIES, fold, query, table
from cohortflow.llm.secrets import secret_spans
from cohortflow.llm.suffix_dedup import remove_repeats
from cohortflow.llm.token_counts import token_counts

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> Vocabulary:
    return Vocabulary.load(public_tokenizers.path(VOCABULARY))


@query("op1_suffix_dedup")
def suffix_dedup(spark: SparkSession, base: str) -> DataFrame:
    rows = remove_repeats(table(spark, base, "documents"))
    return rows.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), p AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, i) AS place,
         lead(line, 1) OVER d AS line1, lead(line, {MIN_LINES - 1}) OVER d AS line2
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY place) > 1
              AND strlen(line) >= {MIN_BYTES} AS single,
         line2 IS NOT NULL
           AND row_number() OVER (PARTITION BY line, line1, line2 ORDER BY place) > 1 AS run
  FROM p
), g AS (
  SELECT doc_id, i, line,
         single OR max(run) OVER (PARTITION BY doc_id ORDER BY i
                                  ROWS BETWEEN {MIN_LINES - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM r
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts
  FROM g
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         count(*) FILTER (starts) AS n_runs,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_runs, 0) AS n_runs, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, base: str) -> DataFrame:
    rows = dedup_lines(table(spark, base, "documents"))
    return rows.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op3_jaccard_join")
def jaccard_join(spark: SparkSession, base: str) -> DataFrame:
    return jaccard_groups(table(spark, base, "documents"))


@query("op3_jaccard_links")
def jaccard_every_link(spark: SparkSession, base: str) -> DataFrame:
    return jaccard_links(table(spark, base, "documents"))


@query("op4_decontamination")
def decontamination(spark: SparkSession, base: str) -> DataFrame:
    found = contaminated(table(spark, base, "documents"), table(spark, base, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    docs, labels = table(spark, base, "documents"), table(spark, base, "labels")
    trees = fit_quality(docs, labels.where(~fold(3, 1)))
    return score_quality(docs, trees).select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


@query("op6_language_id")
def language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents")
    model = fit_language(docs.where(~fold(4, 2)))
    return language_spans(docs, model).select(
        "doc_id",
        fold(4, 2).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").cast("bigint").alias("n_spans"),
    )


@query("op7_token_counts")
def counts(spark: SparkSession, base: str) -> DataFrame:
    return token_counts(table(spark, base, "documents"), vocabulary())


WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
  FROM d
), windows AS (
  SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w
), eight AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + 7)) AS n FROM windows
), again AS (
  SELECT rid, count(DISTINCT p) AS n_repeat
  FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM eight WHERE n > 1) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS n_letters,
         coalesce(list_sum(list_transform(range(0, len(words), {STRETCH}),
             lambda i: len(list_distinct(words[i + 1:i + {STRETCH}])))), 0) AS n_stretch_words,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
         length(regexp_replace(text, '[^|]', '', 'g')) AS n_pipes
  FROM w LEFT JOIN again USING (rid)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CAST((n_words < 20)::INT
           + 2 * (100 * n_repeat_words > 30 * n_words)::INT
           + 4 * (100 * n_symbols > 5 * word_chars)::INT
           + 8 * (100 * n_dup_lines > 40 * n_lines)::INT
           + 16 * (100 * n_upper > 30 * n_letters)::INT
           + 32 * (100 * n_exclaims > 20 * n_words)::INT
           + 64 * (100 * n_pipes > 20 * n_words)::INT
           + 128 * (100 * n_stretch_words < 35 * n_words)::INT AS BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       failed = 0 AS kept, failed
FROM f
"""


@query("op8_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, base: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, base, "documents")), PRODUCTION)
    return entries.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        (F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"),
        "kept",
        "failed",
    )


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, base: str) -> DataFrame:
    return secret_spans(table(spark, base, "documents"))


@query("op10_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, base: str) -> DataFrame:
    return encode_decode(table(spark, base, "documents"), vocabulary(), with_outputs=False)
