"""Toxicity by a weighted grammar of insults, threats, targets, negation and reported speech (operator 12).

A word becomes a symbol and a weight by the lexicon; transducers for reported
speech, negation, targets and intent, composed into one (``transducers.py``),
read the symbols of a text and mark the insults and threats among them.  What
is scored are clauses: the kind and weight of the marked matches in each.  The
weights of words and kinds are learnt from labelled rows: those of words from
counts of documents per word and word beginning, each shrunk towards the shorter
beginning, those of kinds by a ridge regression with no negative weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm import transducers as t
from cohortflow.llm.texts import map_texts, write_once

# Labelled rows that a fit reads at most; they are those of the smallest hash of doc_id.
FIT_ROWS = 20_000

# Patterns of the lexicon at most; the most significant ones are kept.
LEXICON = 20_000

# A pattern is kept if its counts differ from those of the shorter one by this likelihood ratio.
SIGNIFICANT = 24.0

# Rows that the shorter pattern counts for, and an entry of the lists below.
SHRINK, LISTED = 2.0, 4.0
LISTED_SHARE = 0.8

# An insult's log odds over those of any document.
LEAST_WEIGHT = 1.0
THREAT_WEIGHT = 3.0

PREFIXES = range(4, 8)
LONGEST = 40

# Distinct words that are counted or remembered at once, each of up to LONGEST characters.
REMEMBERED = 200_000

# Common words of four languages.
TARGETS = "you your youre yours u ur du dich dir euch ihr tu te toi vous tes vos ti usted ustedes vosotros"
NEGATIONS = "not never no isnt arent wasnt dont nobody nicht kein keine nie niemals ne pas jamais nunca jamás"
REPORTS = (
    "said says wrote writes claimed claims called quoted quote alleged according reported sagte schrieb "
    "behauptete zitierte dit écrit déclaré affirmé dijo escribió afirmó citó"
)
INTENTS = (
    "will gonna going should must shall deserve deserves want wants werde wirst sollst musst vais vas "
    "devrais dois voy debes deberías mereces"
)
VIOLENCES = (
    "kill murder hurt beat destroy shoot stab strangle burn hang töten umbringen schlagen erschießen tuer "
    "frapper détruire matar golpear destruir"
)
INSULTS = (
    "idiot moron stupid dumb loser trash garbage scum pathetic worthless disgusting imbecile cretin vermin "
    "dummkopf trottel abschaum versager widerlich imbécile crétin minable ordure débile idiota imbécil "
    "estúpido basura escoria inútil"
)

KINDS = (
    "insult",
    "aimed_insult",
    "negated_insult",
    "reported_insult",
    "threat",
    "negated_threat",
    "reported_threat",
)
FEATURES = (*KINDS, "density", "strongest")

# What the fit leans to: how far each feature raises the log odds, and the log odds of no match.
LEANING = np.array([1.0, 1.3, 0.2, 0.3, 1.5, 0.2, 0.3, 0.3, 0.3])
LEANING_START = -3.0

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]|,|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SIGNS = {",": t.COMMA, **dict.fromkeys(".!?;:\n", t.BREAK), **dict.fromkeys('"“”„«»', t.QUOTE)}


def norm(word: str) -> str:
    return word.lower().replace("'", "").replace("’", "")


def _listed() -> dict[str, int]:
    out: dict[str, int] = {}
    for symbol, words in (
        (t.VIOLENCE, VIOLENCES), (t.INTENT, INTENTS), (t.REPORT, REPORTS),
        (t.NEGATION, NEGATIONS), (t.TARGET, TARGETS),
    ):
        out.update(dict.fromkeys(words.split(), symbol))
    return out


LISTS = _listed()
INSULT_LIST = frozenset(INSULTS.split())


def patterns(word: str) -> list[str]:
    """The beginnings of a word, shortest first, and the word itself with a ``$`` behind it."""
    out = [word[:k] for k in PREFIXES if k < len(word)]
    if len(word) <= LONGEST:
        out.append(word + "$")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Counts of toxic and other documents per pattern; ``total`` those of all."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    total: tuple[int, int] = (0, 0)

    def weight(self, word: str, less: tuple[int, int] = (0, 0)) -> float:
        """Log odds of a document with the word over those of any; ``less`` takes the document itself out."""
        n1, n0 = self.total
        base = (n1 + 1.0) / (n1 + n0 + 10.0)
        share, of = base, SHRINK
        for pattern in patterns(word):
            if pattern[:-1] in INSULT_LIST and pattern[-1] == "$":
                share, of = max(share, LISTED_SHARE), LISTED
            elif pattern not in self.counts:
                continue
            a, b = self.counts.get(pattern, less)
            a, b = max(0, a - less[0]), max(0, b - less[1])
            share = (a + of * share) / (a + b + of)
            of = SHRINK
        share = min(share, 1 - 1e-4)
        return math.log(share / (1 - share)) - math.log(base / (1 - base))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    start: float


class Scanner:
    """Finds the clauses of texts that match the grammar."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.table = t.compile_table(t.GRAMMAR)
        self.known: dict[tuple, tuple[int, float]] = {}

    def symbol(self, token: str, less: tuple[int, int]) -> tuple[int, float]:
        found = self.known.get((token, less))
        if found is None:
            found = (_SIGNS[token], 0.0) if token in _SIGNS else self._word(norm(token), less)
            if len(token) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token, less] = found
        return found

    def _word(self, word: str, less: tuple[int, int]) -> tuple[int, float]:
        if word in LISTS:
            return LISTS[word], THREAT_WEIGHT
        weight = self.lexicon.weight(word, less)
        return (t.INSULT, weight) if weight >= LEAST_WEIGHT else (t.OTHER, 0.0)

    def clauses(
        self, text: str, less: tuple[int, int] = (0, 0)
    ) -> tuple[list[tuple[str, int, int, float]], int]:
        """(kind, start, end, weight) of the matching clauses, in code points, and the text's tokens."""
        words = _TOKEN.findall(text)
        # Most texts have no word that a clause could be about; they need no second look.
        if not any(self.symbol(w, less)[0] in t.CORE for w in set(words)):
            return [], len(words)
        found, state, table = [], 0, self.table
        held: list[list] = []  # of this clause: letter, weight, start, end
        core = False
        for m in _TOKEN.finditer(text):
            symbol, weight = self.symbol(m.group(), less)
            state, letter = table[state][symbol]
            if symbol in t.CORE:
                held.append([letter, weight, m.start(), m.end()])
                core = True
            elif core:
                if letter & t.AIMED and held:
                    held[-1][0] |= t.AIMED
                    held[-1][3] = m.end()
                elif symbol == t.BREAK:
                    found += self._clause(held)
                    held, core = [], False
        if core:
            found += self._clause(held)
        return found, len(words)

    @staticmethod
    def _clause(held: list[list]) -> list[tuple[str, int, int, float]]:
        """The clause's match: the kind of its heaviest part, half the weight of the others added."""
        parts = []
        for letter, weight, first, last in held:
            if letter & t.SYMBOL == t.VIOLENCE:
                # A violent word alone is no threat: it needs an intent before and a target behind it.
                if not (letter & t.MEANT and letter & t.AIMED):
                    continue
                kind = 5 if letter & t.NEGATED else 6 if letter & t.REPORTED else 4
            elif letter & t.REPORTED:
                kind = 3
            elif letter & t.NEGATED:
                kind = 2
            else:
                kind = 1 if letter & t.AIMED else 0
            parts.append((weight, kind, first, last))
        if not parts:
            return []
        weight, kind = max(parts, key=lambda p: p[0])[:2]
        rest = sum(p[0] for p in parts) - weight
        return [(KINDS[kind], parts[0][2], parts[-1][3], weight + 0.5 * rest)]


def features(clauses: list[tuple[str, int, int, float]], tokens: int) -> list[float]:
    sums = dict.fromkeys(KINDS, 0.0)
    for kind, _, _, weight in clauses:
        sums[kind] += weight
    total = sum(sums.values())
    return [
        *(math.log1p(s) for s in sums.values()),
        math.log1p(100.0 * total / max(tokens, 1)),
        max((weight for _, _, _, weight in clauses), default=0.0),
    ]


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by coordinates, leaning to LEANING; no weight falls below zero."""
    w, start = LEANING.copy(), LEANING_START
    for _ in range(rounds if len(x) else 0):
        before = np.array([*w, start])
        for j in range(-1, x.shape[1]):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w + start, -40, 40)))
            h = p * (1 - p)
            if j < 0:
                start += (float((y - p).sum()) - 0.1 * (start - LEANING_START)) / (float(h.sum()) + 0.1)
            else:
                slope = float(x[:, j] @ (y - p)) - ridge * (w[j] - LEANING[j])
                w[j] = max(0.0, w[j] + slope / (float((x[:, j] ** 2) @ h) + ridge))
        if np.abs(np.array([*w, start]) - before).max() < 1e-6:
            break
    return w, start


def _counted(rows: DataFrame) -> DataFrame:
    """(pattern, n1, n0): toxic and other documents with a word of the pattern; the empty pattern counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(counts[0] | counts[1])
            columns = [keys, [counts[1][k] for k in keys], [counts[0][k] for k in keys]]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["pattern", "n1", "n0"],
            )

        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            for i, text in enumerate(batch.column("text").to_pylist()):
                seen = {""}
                for word in set(map(norm, _WORD.findall(text or ""))):
                    seen.update(patterns(word))
                counts[toxic[i]].update(seen)
                if len(counts[0]) + len(counts[1]) > REMEMBERED:
                    yield out()
        yield out()

    counted = rows.select("toxic", "text").mapInArrow(run, "pattern string, n1 long, n0 long")
    return counted.groupBy("pattern").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> Lexicon:
    """Patterns of (toxic, text) whose counts say something that the next shorter pattern doesn't."""
    counts = write_once(_counted(rows), "patterns")
    total = counts.where("pattern = ''").select("n1", "n0").first()
    if total is None:
        return Lexicon()
    length = F.length("pattern")
    stem = F.when(F.col("pattern").endswith("$"), F.col("pattern").substr(F.lit(1), length - 1))
    word = F.coalesce(stem, "pattern")
    # The word itself hangs on its longest beginning, a beginning on the one before.
    cut = F.least(F.length(word) - 1, F.lit(max(PREFIXES)))
    parent = F.when(cut >= min(PREFIXES), F.substring(word, F.lit(1), cut)).otherwise(F.lit(""))
    here = counts.where("n1 + n0 >= 4 AND pattern != ''").withColumn("parent", parent)
    above = counts.select(F.col("pattern").alias("parent"), F.col("n1").alias("p1"), F.col("n0").alias("p0"))
    joined = here.join(above, "parent")

    def term(n: str, p: str) -> Column:
        expected = (F.col("n1") + F.col("n0")) * (F.col(p) + 0.01) / (F.col("p1") + F.col("p0") + 0.02)
        return F.when(F.col(n) > 0, F.col(n) * F.ln(F.col(n) / expected)).otherwise(F.lit(0.0))

    # A beginning that hangs on all documents is kept if toxic ones have it more often than others.
    ratio = 2 * (term("n1", "p1") + term("n0", "p0"))
    kept = (
        joined.withColumn("ratio", ratio)
        .where(F.col("ratio") >= SIGNIFICANT)
        .orderBy(F.col("ratio").desc(), "pattern")
        .limit(size)
        .select("pattern", "n1", "n0")
        .collect()
    )
    return Lexicon({r["pattern"]: (r["n1"], r["n0"]) for r in kept}, (total["n1"], total["n0"]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from at most ``fit_rows`` labelled documents.

    ``labels`` (doc_id, toxic) holds the rows that may be learnt from; rows with
    a null are left out, repeated ones count once, and of two labels of one
    document both count.  Without labels the lists and leanings above decide.
    In the regression every document is scored with its own counts taken out.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(fit_rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = write_once(found.select("toxic", "text"), "labelled")
    lexicon = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            texts = batch.column("text").to_pylist()
            x = [
                features(*scanner.clauses(text or "", (1, 0) if y else (0, 1)))
                for y, text in zip(toxic, texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"]
            )

    measured = rows.mapInArrow(run, "y int, x array<double>").orderBy("y", "x").limit(2 * fit_rows).collect()
    x = np.array([r["x"] for r in measured], float).reshape(len(measured), len(FEATURES))
    weights, start = regress(x, np.array([r["y"] for r in measured], float))
    return Model(lexicon, weights, start)


def toxic_clauses(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted (1 from 0.3 on) and the matching clauses of every row of ``docs``.

    A clause has its kind, start, end (code points, end exclusive) and weight.
    Null and empty texts have no clause and the score of no match.  A repeated
    row gives a repeated result, a null doc_id stays null, an empty table gives
    no row, other columns are not read.
    """
    clause = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )

    def make():
        scanner = Scanner(model.lexicon)

        def run(texts: list) -> list:
            found = [scanner.clauses(text or "") for text in texts]
            x = np.array([features(*f) for f in found], float).reshape(len(found), len(FEATURES))
            score = 1.0 / (1.0 + np.exp(-np.clip(x @ model.weights + model.start, -700, 700)))
            names = ("kind", "start", "end", "weight")
            return [score, [[dict(zip(names, c)) for c in clauses] for clauses, _ in found]]

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("clauses", T.ArrayType(clause))]
    scored = map_texts(docs, make, fields)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
