"""Operators 11 to 13 against brute force and on odd input."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortflow.llm import bit_planes, merkle
from cohortflow.llm import transducers as t
from cohortflow.llm.toxicity import (
    FEATURES,
    LEANING,
    LEANING_START,
    Lexicon,
    Scanner,
    features,
    fit_toxicity,
    learn_lexicon,
    patterns,
    regress,
    toxic_clauses,
)

# ---- clusters by bit planes


def test_planes_round_trip_and_distances():
    rng = np.random.default_rng(1)
    x, c = rng.integers(0, 700, (300, 64)), rng.integers(0, 700, (5, 64))
    words = bit_planes.planes(x, 10)
    assert words.shape == (300, 10) and words.dtype == np.uint64
    assert (bit_planes.values(words) == x).all()
    want = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (bit_planes.distances(words, (x * x).sum(axis=1), c) == want).all()


def brute_clusters(rows, k=16, rounds=3):
    """Rows of (id, integers), every step written out."""
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in rows if i is not None)
    centroids = [list(q) for _, q in start[:k]]

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        of = [nearest(q)[0] for _, q in rows]
        for j in range(len(centroids)):
            mine = [q for (_, q), c in zip(rows, of) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *nearest(q)) for i, q in rows]
    sums = [sum(d for _, c, d in out if c == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, c, d, sums[c], sum(sums), names[c]) for i, c, d in out), key=lambda r: (str(r[0]), r)
    )


def floored(v):
    return [int(np.floor(64 * x)) for x in v]


def clustered(frame, **more):
    rows = bit_planes.cluster_vectors(frame, **more).collect()
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), r))


SCHEMA = "vec_id bigint, embedding array<float>, cluster string, words string, key string, q string"


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in base[i % 6]]) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(60)]  # a very common vector, ties throughout
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (700, [-0.0] * 64)]
    odd = [
        (900, None),
        (901, []),
        (902, [0.1] * 63),
        (903, [0.1] * 65),
        (904, [None] + [0.1] * 63),
        (905, [float("nan")] + [0.1] * 63),
        (906, [float("-inf")] + [0.1] * 63),
    ]
    frame = spark.createDataFrame([(i, v, *["clash"] * 4) for i, v in rows + odd], SCHEMA).repartition(5)
    as_float = [(i, floored(np.array(v, np.float32).astype(float))) for i, v in rows]
    assert clustered(frame) == brute_clusters(as_float)


def test_clusters_of_few_or_no_vectors(spark):
    one = [1.0] * 64
    frame = spark.createDataFrame([(i, v, *["x"] * 4) for i, v in [(1, one), (2, one)]], SCHEMA)
    assert [r[1:5] for r in clustered(frame)] == [(0, 0, 0, 0), (0, 0, 0, 0)]
    assert clustered(frame.limit(0)) == []
    nameless = spark.createDataFrame([(None, one, *["x"] * 4)], SCHEMA)
    assert clustered(nameless) == [(None,) * 6]


def test_clusters_of_very_wide_components(spark):
    wide = [float(2**30)] + [0.0] * 63
    frame = spark.createDataFrame([(1, wide, *["x"] * 4), (2, [0.0] * 64, *["x"] * 4)], SCHEMA)
    with pytest.raises(ValueError, match="bits"):
        clustered(frame)


# ---- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row]
    return sha(*parts)


def reduced(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def way(levels, at):
    """For each level but the last: the place in the run, and the siblings."""
    out = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        run = nodes[first : first + 8]
        out.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= 8
    return out


def brute_manifest(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = [r for r in rows if r[2] == lang]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (mine, reduced([leaf(r) for r in mine]))
    top = reduced([trees[lang][1][-1][0] for lang in langs])
    root = top[-1][0] if langs else None
    out = []
    for place, lang in enumerate(langs):
        mine, levels = trees[lang]
        for at, row in enumerate(mine):
            steps = way(levels, at) + way(top, place)
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                text = "".join(c.lower() if c.isascii() else c for c in row[4])
                node = leaf((*row[:4], text))
            for own, siblings in steps:
                node = sha(*siblings[:own], node, *siblings[own:])
            proof = sha(*(x for _, siblings in steps for x in siblings))
            out.append((row[0], leaf(row), levels[-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, pos string, node string"


def manifested(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(parts)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return sorted(map(tuple, merkle.manifest(docs, tampered=hit).collect()), key=str)


def test_manifest_of_odd_rows(spark):
    rows = [
        (1, "s", "en", 3, "ABC"),
        (2, None, None, None, None),
        (3, "", "", 0, ""),
        (4, "ü", "de", -5, "ÄÖ Straße"),
        (4, "ü", "de", -5, "ÄÖ Straße"),
        (4, "u", "de", -5, "Other text, same id"),
        (None, "s", "en", 1, "No ID"),
        (None, "s", "en", 1, "No ID"),
        (5, "s", "\U0001f600", 1, "X" * 300_000),
        (6, "s", "zz", 1, "\U0001f469‍ ſ İ K"),
        (9, "s", None, 7, "Lower"),
    ]
    assert manifested(spark, rows) == brute_manifest(rows)
    assert manifested(spark, [rows[0]]) == brute_manifest([rows[0]])
    assert manifested(spark, []) == []


def test_manifest_of_many_chunks_and_groups(spark):
    """A group of three chunks, the last of one leaf; copies of one row; many small groups."""
    rows = [(i, "s", "hot", i, f"Text {i}") for i in range(2 * merkle.CHUNK - 49)]
    rows += [(7, "s", "hot", 7, "Text 7")] * 50
    rows += [(i, "t", f"g{i % 70}", 0, f"T{i}") for i in range(10_000, 10_300)]
    rows += [(-i, None, None, None, None) for i in range(9)]
    assert manifested(spark, rows, 7) == brute_manifest(rows)


# ---- toxicity


def kinds(text, lexicon=Lexicon({}, (100, 900))):
    return [(k, text[a:b]) for k, a, b, _ in Scanner(lexicon).clauses(text)[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("You are an idiot.", [("aimed_insult", "idiot")]),
        ("An idiot passed by", [("insult", "idiot")]),
        ("moron like you", [("aimed_insult", "moron like you")]),
        ("You are not an idiot.", [("negated_insult", "idiot")]),
        ("No, you idiot!", [("aimed_insult", "idiot")]),
        ("He said you are an idiot. Moron!", [("reported_insult", "idiot"), ("insult", "Moron")]),
        ('The label "idiot" is old', [("reported_insult", "idiot")]),
        ("I will kill you", [("threat", "kill you")]),
        ("I will not kill you", [("negated_threat", "kill you")]),
        ("She said he will kill you", [("reported_threat", "kill you")]),
        ("You will kill the process", []),
        ("They kill weeds", []),
        ("stupid, worthless thing. Fine.", [("insult", "stupid, worthless")]),
        ("", []),
        ("... !!! \n\n", []),
    ],
)
def test_grammar(text, want):
    assert kinds(text) == want


def test_composition_reads_what_the_first_writes():
    """The compiled table says the same as the transducers run one after the other."""
    rng = random.Random(2)
    table = t.compile_table(t.GRAMMAR)
    row, state = 0, t.GRAMMAR.start
    for symbol in rng.choices(list(t.SYMBOLS), k=5000):
        row, letter = table[row][symbol]
        state, want = t.GRAMMAR.step(state, symbol)
        assert letter == want


def test_a_clause_weighs_its_parts():
    one = Scanner(Lexicon({}, (100, 900)))
    single = one.clauses("idiot")[0][0][3]
    assert one.clauses("idiot moron")[0][0][3] == pytest.approx(1.5 * single)
    x = features(*one.clauses("idiot. moron"))
    assert len(x) == len(FEATURES) and x[0] == pytest.approx(np.log1p(2 * single))


def test_patterns():
    assert patterns("abc") == ["abc$"]
    assert patterns("abcdefghi") == ["abcd", "abcde", "abcdef", "abcdefg", "abcdefghi$"]
    assert patterns("x" * 50) == ["x" * k for k in range(4, 8)]


def test_lexicon_counts_documents(spark):
    rows = [(1, "Blorgon blorgish, blorgish"), (0, "fine blorgon text"), (1, None), (0, "")] * 30
    rows += [(0, f"harmless words {i}") for i in range(200)]
    lexicon = learn_lexicon(spark.createDataFrame(rows, "toxic int, text string").repartition(4))
    assert lexicon.total == (60, 260)
    assert lexicon.counts["blor"] == (30, 30)
    # The shortest beginning that tells the two words apart; longer ones say nothing new.
    assert lexicon.counts["blorgi"] == (30, 0) and "blorgis" not in lexicon.counts
    assert lexicon.weight("blorgish") > lexicon.weight("blorgon") > lexicon.weight("harmless")
    # Without the document itself the evidence is less.
    assert lexicon.weight("blorgish", (1, 0)) < lexicon.weight("blorgish")


def test_regression_leans_and_has_no_negative_weight():
    w, start = regress(np.zeros((0, len(FEATURES))), np.zeros(0))
    assert (w == LEANING).all() and start == LEANING_START
    rng = np.random.default_rng(3)
    x = np.zeros((400, len(FEATURES)))
    x[:, 0], x[:, 2] = rng.random(400) * 3, rng.random(400) * 3
    y = (x[:, 0] - x[:, 2] > 0).astype(float)
    w, start = regress(x, y)
    assert w.min() >= 0 and w[0] > LEANING[0] and w[2] < 0.05


def corpus(n, seed):
    """Words of syllables; toxic ones hold forms of two made-up stems."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randint(1, 5)):
                stem = rng.choice(["zorvax", "quelmi"])
                words[rng.randrange(len(words))] = stem + rng.choice(syllables)
        rows.append((i, " ".join(words).capitalize() + ".", toxic))
    return rows


def test_held_out_rows(spark):
    rows = corpus(900, 4)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxic_clauses(docs, model).collect()}
    right = [got[i] == y for i, _, y in rows if i % 3 == 0]
    assert sum(right) / len(right) > 0.99


def test_toxicity_of_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(odd, none)
    assert model.lexicon.counts == {} and model.start == LEANING_START
    rows = toxic_clauses(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxic_clauses(nothing, model).collect() == []
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert fit_toxicity(odd, nulls).lexicon.total == (1, 1)


def test_toxicity_of_a_very_long_text(spark):
    model = fit_toxicity(
        spark.createDataFrame([], "doc_id long, text string"),
        spark.createDataFrame([], "doc_id long, toxic int"),
    )
    text = "word " * 400_000 + "you idiot. " + "x" * 1_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = toxic_clauses(docs, model).collect()
    assert [(c["kind"], text[c["start"] : c["end"]]) for c in row["clauses"]] == [("aimed_insult", "idiot")]


def test_registered_toxicity(spark):
    """Held-out labels of the registered query: clean documents stay, English insults are found."""
    base = "/root/testdata/sf0.01"
    rows = entry.queries()["op12_toxicity"](spark, base)
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    lang = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang")
    found = rows.join(labels, "doc_id").join(lang, "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in found if r["toxic"] == 0]
    english = [r["predicted"] for r in found if r["toxic"] == 1 and r["lang"] == "en"]
    assert len(clean) > 50 and sum(clean) <= 0.03 * len(clean)
    assert len(english) >= 5 and sum(english) >= 0.9 * len(english)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted", "n_clauses"]
