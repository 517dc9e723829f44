"""Quality rules as a ledger of bitmasks (operator 8).

Every rule is evaluated once; the ledger keeps the measurements and one bit per
failed rule.  A policy is a version and a mask of the rules it enforces, so
policies and ablations read the ledger and never the texts again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.measures import MEASURES, MORE_MEASURES, measure, measure_more
from cohortflow.llm.texts import map_texts


@dataclass(frozen=True)
class Rule:
    """Fails where ``sql``, a condition on the measurements, holds; whole numbers only, so no rounding."""

    name: str
    sql: str


# A rule's bit is its place here; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    # Of the letters of any script, so that a few Latin capitals among others don't count.
    Rule("capitals", "100 * n_upper > 30 * n_letters"),
    Rule("exclaims", "100 * n_exclaims > 20 * n_words"),
    Rule("pipes", "100 * n_pipes > 20 * n_words"),
    # Over stretches of a fixed number of words, as the share of distinct words falls with a text's length.
    Rule("low_variety", "100 * n_stretch_words < 35 * n_words"),
)

# What the corpus pipeline evaluates.
ALL_RULES = RULES


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


BASE = Policy("base-1", mask(["few_words", "repeats"]))
PRODUCTION = Policy("production-2", mask([r.name for r in RULES]))
CORPUS = Policy("corpus-2", PRODUCTION.mask)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, MEASURES (long) and ``failed`` (long, bit i set where rule i fails), row by row.

    MORE_MEASURES are taken too if a rule names one of them.
    Null and empty texts measure 0 throughout and so fail ``few_words`` alone.
    A repeated row gives a repeated result, null ids stay null, an empty table
    gives no row; columns beside ``keep`` and the text are not read.
    """

    more = any(m in rule.sql for rule in rules for m in MORE_MEASURES)
    names = (*MEASURES, *MORE_MEASURES) if more else MEASURES

    def make():
        def run(texts: list) -> list:
            return list(zip(*((*measure(t), *measure_more(t)) if more else measure(t) for t in texts)))

        return run

    measured = map_texts(docs, make, [T.StructField(m, T.LongType()) for m in names], keep)
    bits: Column = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.sql), F.lit(1 << i)).otherwise(F.lit(0)))
    return measured.withColumn("failed", bits.cast("bigint"))


def apply_policy(entries: DataFrame, policy: Policy, kept: str = "kept") -> DataFrame:
    """Add ``kept``: no rule that the policy enforces has failed."""
    return entries.withColumn(kept, F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablation(entries: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per enforced rule: documents that fail it, that fail it alone, and that stay without it.

    One pass: ledger rows are counted by their masks first, of which there are
    at most two to the number of rules.
    """
    counts = (
        entries.select(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits"))
        .groupBy("bits")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    enforced = [(i, r.name) for i, r in enumerate(rules) if policy.mask >> i & 1]
    table = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    F.lit(1 << i).cast("bigint").alias("bit"),
                    F.lit(policy.mask & ~(1 << i)).cast("bigint").alias("rest"),
                )
                for i, name in enforced
            ]
        )
    )

    def total(where: Column) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(F.lit(0)))

    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    clear = F.col("bits").bitwiseAND(F.col("r.rest")) == 0
    return (
        counts.withColumn("r", table)
        .groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            total(hit).alias("n_failed"),
            total(hit & clear).alias("n_failed_alone"),
            total(clear).alias("n_kept_without"),
        )
    )
