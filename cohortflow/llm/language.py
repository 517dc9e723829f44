"""Language spans: scripts narrow the candidates, Viterbi labels the words (operator 6)."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.llm.texts import map_texts

# Documents that a fit reads at most; they are those of the smallest hash of doc_id.
FIT_DOCUMENTS = 8_000
# Words that a worker remembers before it starts afresh; a bound on memory, not on results.
REMEMBERED = 1_000_000
# Characters of the words that a worker remembers.
REMEMBERED_CHARS = 32 << 20
# A language uses a script if it has this share of the language's letters.
SCRIPT_SHARE = 0.01
# What a change of language from one word to the next costs, in units of log likelihood.
SWITCH = 12.0
UNKNOWN = "und"

# First code points of Unicode ranges and their scripts.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "other"), (0x20000, "han"),
)
_STARTS = [s for s, _ in SCRIPT_STARTS]


def script(letter: str) -> str:
    return SCRIPT_STARTS[bisect.bisect_right(_STARTS, ord(letter)) - 1][1]


def letters(word: str) -> str:
    """The letters of a word in lower case, other characters left out."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word.lower()))


def grams(word: str) -> list[str]:
    """Three-letter pieces of a word with its edges marked."""
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    grams: dict[str, int]
    table: np.ndarray  # a row per gram and one more for unseen ones, a column per language
    scripts: dict[str, np.ndarray]  # script: which languages use it
    prior: np.ndarray


def fit_language(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> LanguageModel:
    """Count three-letter pieces and scripts per language on a bounded sample of ``docs`` (doc_id, text, lang).

    Rows with a null text or lang are not learnt from.  Pieces are counted on
    the executors; the driver gets one row per language and piece of the sample.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    key = F.xxhash64("doc_id")
    chosen = usable.select("doc_id", key.alias("_key")).orderBy("_key", "doc_id").limit(fit_documents)
    # The largest hash of the sample, one number, is all that the second scan needs.
    last = chosen.agg(F.max("_key")).first()[0]
    sample = usable.where(key <= F.lit(last)) if last is not None else usable.limit(0)

    def run(batches):
        for b in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            seen: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[lang].update(text.split())
            for lang, words in seen.items():
                for word, n in words.items():
                    w = letters(word)
                    if w:
                        for g in grams(w):
                            found[lang][g] += n
                        found[lang][f"script:{script(w[0])}"] += n * len(w)
            rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                names=["lang", "gram", "n"],
            )

    counts = (
        sample.select("text", "lang")
        .mapInArrow(run, "lang string, gram string, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    languages = sorted({r.lang for r in counts})
    places = {lang: i for i, lang in enumerate(languages)}
    names = sorted({r.gram for r in counts if not r.gram.startswith("script:")})
    number = {g: i for i, g in enumerate(names)}
    table = np.zeros((len(names) + 1, len(languages)))
    of_script: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for r in counts:
        if r.gram.startswith("script:"):
            of_script[r.gram[7:]][places[r.lang]] += r.n
        else:
            table[number[r.gram], places[r.lang]] += r.n
    total = table.sum(axis=0)
    table = np.log((table + 0.5) / (total + 0.5 * len(table)))
    all_letters = sum(of_script.values(), np.zeros(len(languages)))
    scripts = {
        s: used for s, n in of_script.items() if (used := n >= SCRIPT_SHARE * all_letters).any()
    }
    prior = np.log((total + 1.0) / (total.sum() + len(languages)))
    return LanguageModel(languages, number, table, scripts, prior)


class Scorer:
    """Per-word scores and best paths; one for each worker process and model."""

    def __init__(self, model: LanguageModel, switch: float = SWITCH) -> None:
        self.model, self.switch = model, switch
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((1024, max(1, len(self.model.languages))), np.float32)
        self.n_letters = np.zeros(1024, np.int64)

    def learn(self, words: list[str]) -> None:
        """Score new words: candidates are the languages of the word's script, others fall far behind."""
        model = self.model
        unseen = len(model.grams)
        at = len(self.place)
        need = at + len(words)
        if need > len(self.scores):
            grown = max(need, 2 * len(self.scores))
            self.scores = np.resize(self.scores, (grown, self.scores.shape[1]))
            self.n_letters = np.resize(self.n_letters, grown)
        plain = [letters(w) for w in words]
        flat: list[int] = []
        sizes: list[int] = []
        get = model.grams.get
        for w in plain:
            g = [get(x, unseen) for x in grams(w)] if w else []
            flat += g
            sizes.append(len(g))
        rows = np.zeros((len(words), self.scores.shape[1]))
        size = np.asarray(sizes, np.int64)
        full = np.flatnonzero(size)
        if len(full):
            starts = (np.cumsum(size) - size)[full]
            rows[full] = np.add.reduceat(model.table[flat], starts, axis=0)
            for i in full.tolist():
                if not plain[i].isascii() and (s := script(plain[i][0])) != "latin":
                    self.narrow(rows, i, s)
            if (latin := model.scripts.get("latin")) is not None and not latin.all():
                ascii_ = [i for i in full.tolist() if script(plain[i][0]) == "latin"]
                rows[ascii_] -= np.where(latin, 0.0, 1e3)
        self.scores[at:need] = rows
        self.n_letters[at:need] = [len(w) for w in plain]
        self.place.update(zip(words, range(at, need)))
        self.chars += sum(map(len, words))

    def narrow(self, rows: np.ndarray, i: int, name: str) -> None:
        used = self.model.scripts.get(name)
        if used is None:
            rows[i] = 0.0  # no language learnt has this script: the word says nothing
        else:
            rows[i] -= np.where(used, 0.0, 1e3)

    def paths(self, texts: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Best language and letters of every word, per text."""
        if len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        words = [(t or "").split() for t in texts]
        new: dict[str, None] = {}
        for w in words:
            new.update((x, None) for x in set(w).difference(self.place))
        if new:
            self.learn(sorted(new))
        at = [np.fromiter(map(self.place.__getitem__, w), np.int64, len(w)) for w in words]
        order = sorted(range(len(at)), key=lambda i: -len(at[i]))
        lengths = np.array([len(at[i]) for i in order], np.int64)
        steps = int(lengths[0]) if len(lengths) else 0
        # Words by time, the documents that are still running first; a step is one slice.
        running = np.searchsorted(-lengths, -np.arange(steps), side="left")
        first = np.cumsum(running) - running
        flat = np.zeros(int(running.sum()), np.int64)
        for rank, i in enumerate(order):
            flat[first[: len(at[i])] + rank] = at[i]
        score = self.scores[flat]
        n_lang = score.shape[1]
        number = np.min_scalar_type(-n_lang)  # a signed type that holds every language's number
        back = np.zeros(score.shape, number)
        state = np.tile(self.model.prior.astype(np.float32), (len(order), 1))
        stay = np.arange(n_lang, dtype=number)
        for t in range(steps):
            k, a = int(running[t]), int(first[t])
            v = state[:k]
            best = v.argmax(axis=1)
            jump = v.max(axis=1)[:, None] - self.switch
            back[a : a + k] = np.where(v >= jump, stay, best[:, None])
            state[:k] = np.maximum(v, jump) + score[a : a + k]
        label = np.zeros(len(flat), number)
        now = state.argmax(axis=1) if n_lang else np.zeros(len(order), np.int64)
        for t in range(steps - 1, -1, -1):
            k, a = int(running[t]), int(first[t])
            label[a : a + k] = now[:k]
            now[:k] = back[np.arange(a, a + k), now[:k]]
        out: list[np.ndarray] = [np.zeros(0, number)] * len(at)
        for rank, i in enumerate(order):
            out[i] = label[first[: len(at[i])] + rank]
        return out, [self.n_letters[a] for a in at]


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)


def language_spans(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, first word, word after the last) of every row of ``docs``.

    Words are runs between white space.  ``lang_pred`` is the language with the
    most letters, the first by name at a tie, and ``score`` its share of them.
    A text that is null or has no letter, or any text under a model that has
    learnt nothing, gives ``und``, 0.0 and no spans.  A repeated row gives a
    repeated result, a null doc_id stays null, an empty table gives no row,
    other columns are not read.
    """

    def make():
        names = model.languages
        scorer = Scorer(model, switch) if names else None

        def one(label: np.ndarray, n: np.ndarray) -> tuple:
            total = int(n.sum())
            if not total:
                return UNKNOWN, 0.0, []
            by = np.bincount(label, n, len(names))
            top = int(by.argmax())
            full = np.flatnonzero(n)  # words without letters belong to the span around them
            cut = np.flatnonzero(np.diff(label[full])) + 1
            starts = [0, *full[cut].tolist()]
            ends = [*starts[1:], len(label)]
            spans = [
                {"lang": names[label[max(a, int(full[0]))]], "start": a, "end": b}
                for a, b in zip(starts, ends)
            ]
            return names[top], min(1.0, float(by[top]) / total), spans

        def run(texts: list) -> list:
            if scorer is None:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts)]
            return list(zip(*map(one, *scorer.paths(texts))))

        return run

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", SPANS),
    ]
    return map_texts(docs, make, fields)
