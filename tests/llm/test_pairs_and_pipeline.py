"""Operators over many texts, and the pipeline, against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cohortflow.llm import jaccard_join as jaccard
from cohortflow.llm.components import components
from cohortflow.llm.decontaminate import Items, align, contaminated, find_matches
from cohortflow.llm.jaccard_join import jaccard_groups, jaccard_links
from cohortflow.llm.line_dedup import dedup_lines
from cohortflow.llm.shingles import shingle_set, word_hashes
from tests.llm import brute


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# Lines -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_lines_by_brute_force(spark, min_lines):
    rng = np.random.default_rng(min_lines)
    kinds = ["a", "", "b", "a longer line that counts by itself", "c", "zwei", "another long line, just for one"]
    rows = [
        (i if i < 39 else None, "\n".join(rng.choice(kinds, rng.integers(1, 12)).tolist())) for i in range(40)
    ] + [(50, None), (51, ""), (52, "a\n" * 2000)]
    rows += rows[:4]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id bigint, text string, runs string, place string")
    got = dedup_lines(frame.repartition(5), min_lines, 30).collect()
    want = brute.lines(rows, min_lines, 30)
    assert Counter(tuple(r) for r in got) == Counter((d, *want[(d, t)]) for d, t in rows)


def test_lines_of_odd_rows(odd, nothing):
    got = dedup_lines(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in pairs(odd))
    texts = {r.doc_id: r.kept for r in got if r.doc_id not in (7, None)}
    assert texts[2] is None and texts[3] == "" and texts[1].startswith("The house")
    assert sorted(r.kept for r in got if r.doc_id == 7) == ["", "Another text under the same id."]
    assert dedup_lines(nothing).collect() == []


# Groups ------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)]
    links += [(5, 5), (3, 9), (9, 3), (None, 4), (200, 201), (201, 202), (202, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = {i: 100 for i in range(100, 141)} | {i: 3 for i in (3, *range(7, 40))}
    assert got == want | {i: 200 for i in (200, 201, 202)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_shingle_sets_follow_the_words():
    texts = ["a B c", "A  b\tc", "a b c d", "", " \n", "x", "x y", "é É", "ab c", "a bc"]
    for k in (1, 2, 3):
        sets = [frozenset(shingle_set(w, k).tolist()) for w in word_hashes([t.encode() for t in texts])]
        plain = [brute.shingles(t, k) for t in texts]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])


@pytest.mark.parametrize("words,percent,group", [(3, 90, 64), (5, 80, 2), (1, 50, 3)])
def test_groups_by_brute_force(spark, monkeypatch, words, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "ASKED", group)
    rng = np.random.default_rng(percent)
    texts: list[str | None] = [None, "", " ", "one", "one two", "One two"]
    common = rng.choice(60, 25).tolist()
    for _ in range(90):
        if len(texts) > 12 and rng.random() < 0.6:
            base = (texts[rng.integers(6, len(texts))] or "").split()
            for _ in range(rng.integers(0, 4)):
                base[rng.integers(0, len(base))] = f"w{rng.integers(0, 400)}"
            texts.append(" ".join(base))
        else:
            own = [f"w{i}" for i in rng.integers(0, 400, rng.integers(4, 70))]
            texts.append(" ".join([f"w{i}" for i in common] * int(rng.integers(0, 2)) + own))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    rows += [(500, rows[20][1]), (500, rows[40][1]), rows[30], (None, rows[30][1]), (None, None)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, name string, root int")
    got = Counter(tuple(r) for r in jaccard_groups(frame.repartition(3), words, percent).collect())
    want = brute.groups(rows, words, percent)
    assert got == want
    assert len({c for *_, c in want}) < len(texts) - 5


def test_groups_of_odd_rows(odd, nothing):
    got = Counter(tuple(r) for r in jaccard_groups(odd).collect())
    assert got == brute.groups(pairs(odd), 3, 90)
    assert jaccard_groups(nothing).collect() == []


def test_registered_groups(spark, base, sample):
    got = Counter(tuple(r) for r in entry.queries()["op3_jaccard_join"](spark, base).collect())
    assert got == brute.groups([(d, t) for d, t, _ in sample], 3, 90)


def links(rows, k, percent):
    """Rows (doc_id, n_shingles, component_id, n_links) by comparing all with all."""
    sets = {(d, brute.shingles(t, k)) for d, t in rows if d is not None and brute.words(t)}
    count = {
        (d, s): sum((e, t) != (d, s) and 100 * len(s & t) >= percent * len(s | t) for e, t in sets) for d, s in sets
    }
    of = {d: c for d, _, c in brute.groups(rows, k, percent)}
    shingled = [(d, brute.shingles(t, k)) for d, t in rows]
    return Counter((d, len(s), of[d], count.get((d, s), 0)) for d, s in shingled)


@pytest.mark.parametrize("words,percent,group", [(3, 80, 64), (2, 50, 3)])
def test_every_link_by_brute_force(spark, odd, monkeypatch, words, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "ASKED", group)
    rng = np.random.default_rng(percent)
    rows = []
    for d in range(80):  # two groups of near copies around a text, and texts of their own
        own = [f"w{i}" for i in rng.integers(0, 300, 40)]
        base = [f"{'ab'[d % 2]}{i}" for i in range(40)]
        for _ in range(rng.integers(0, 3)):
            base[rng.integers(0, 40)] = f"w{rng.integers(0, 300)}"
        rows.append((d, " ".join(own if d % 5 == 0 else base)))
    rows += [(90, rows[1][1]), (90, rows[2][1]), rows[3], (None, rows[3][1]), (91, ""), (92, None), (93, "one")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in jaccard_links(frame.repartition(3), words, percent).collect())
    assert got == links(rows, words, percent)
    assert max(n for *_, n in got) > 5
    if group > 3:
        assert Counter(tuple(r) for r in jaccard_links(odd).collect()) == links(pairs(odd), 3, 90)
        assert jaccard_links(odd.limit(0)).collect() == []


# Decontamination ---------------------------------------------------------------------------------


def test_alignment_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(1, 12)).astype(np.uint64)
        windows = rng.integers(1, 6, (5, rng.integers(1, 25))).astype(np.uint64)
        scores, first, last = align(item, windows)
        for s, a, b, w in zip(scores, first, last, windows):
            assert s == brute.score(item.tolist(), w.tolist())
            if s:
                assert brute.score(item.tolist(), w[a : b + 1].tolist()) == s


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            out.append(f"new{rng.integers(0, 99)}")
        elif r < 2 * share / 3:
            out += [w, "added"]
        elif r > share:
            out.append(w)
    return out


def test_edited_copies_are_found(spark, odd, nothing):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(12, 60)))) for i in range(12)]
    rows, planted = [], {}
    for d in range(60):
        text = rng.choice(vocabulary, rng.integers(0, 300)).tolist()
        if d % 3 == 0:
            i = d % 12
            copy = edited(rng, items[i][1].split(), (d % 5) * 0.04)
            at = rng.integers(0, len(text) + 1)
            text[at:at] = [w.upper() + "," for w in copy]
            planted[d] = i
        rows.append((d, " ".join(text)))
    rows += [(100, items[0][1] + " x " + items[1][1]), (101, None), (102, "")]
    rows += [(200 + i, f"some own words {i} and " + items[5][1]) for i in range(40)]
    bench = spark.createDataFrame(items + [items[3], (77, None), (78, "too short"), (79, "")], "item_id bigint, text string")
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, item_id string")
    want = brute.leaks(rows, items)
    assert sum((d, i) in want for d, i in planted.items()) >= 0.9 * len(planted)
    for pass_bytes in (1 << 20, 600):
        found = contaminated(frame.repartition(3), bench, pass_bytes=pass_bytes).collect()
        got = {(r.doc_id, m.item_id): m.score for r in found for m in r.matches}
        assert got == pytest.approx(want) and len(found) == len(rows)
    none = contaminated(odd, bench.limit(0)).collect()
    assert Counter(r.doc_id for r in none) == Counter(d for d, _ in pairs(odd)) and not any(r.matches for r in none)
    assert not any(r.matches for r in contaminated(odd, bench).collect())
    assert contaminated(nothing, bench).collect() == []


@pytest.mark.parametrize("copies", [30, 300])
def test_an_edited_variant_in_many_documents(spark, copies):
    words = [f"w{i}" for i in range(30)]
    variant = " ".join("other" if i % 6 == 5 else w for i, w in enumerate(words))
    frame = spark.createDataFrame([(d, f"own {d} {variant} end") for d in range(copies)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    found = contaminated(frame.repartition(3), bench).collect()
    # The last word is replaced, so the passage ends before it: 25 words of 30, four others within.
    assert [[(m.item_id, m.score) for m in r.matches] for r in found] == [[(1, 46 / 60)]] * copies


def test_copies_edited_everywhere_are_found(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([5, 6, 7, 10, 15, 15, 20, 25, 40])]
    rows = []
    for d in range(90):
        i, copy = d % 9, items[d % 9][1].split()
        if d < 9:
            copy = ["other" if at % 5 == 4 else w for at, w in enumerate(copy)]
        elif d < 18:
            copy = [x for w in copy for x in (w, "other")][:-1]  # no two words of the item are next to each other
        else:
            copy = edited(rng, copy, 0.1 + 0.05 * (d % 7))
        own = rng.choice(vocabulary, 40).tolist()
        rows.append((d, " ".join(own[:20] + copy + own[20:])))
    want = brute.leaks(rows, items, seed=1)
    assert len(want) > len(brute.leaks(rows, items)) + 9 and (9, 0) in want
    assert all((d, d) in want for d in range(9))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, m.item_id): m.score for r in found for m in r.matches} == pytest.approx(want)


def test_registered_leaks(spark, base, sample, duck):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r.doc_id, r.item_id): r.score for r in entry.queries()["op4_decontamination"](spark, base).collect()}
    want = brute.leaks([(d, t) for d, t, _ in sample], items)
    assert got == pytest.approx(want) and want


def test_matches_name_the_passage():
    items = Items.of([(9, "alpha beta gamma delta epsilon zeta")], 5)
    text = "x y ALPHA, beta gamma. delta epsilon zeta z"
    [[m]] = find_matches([text], items, 5, 0.6)
    assert (m["item_id"], m["score"], m["first_word"], m["last_word"]) == (9, 1.0, 2, 7)


# Pipeline ----------------------------------------------------------------------------------------


def by_hand(rows, items):
    """The rows that each stage but the last leaves, as {stage: {doc_id: text}}; ids are distinct."""
    out = {}
    docs = {d: t for d, t in rows if not brute.rejected(t)}
    out["quality_rules"] = docs
    kept = brute.lines(list(docs.items()))
    docs = {d: kept[(d, t)][3] for d, t in docs.items()}
    docs = {d: t for d, t in docs.items() if brute.words(t) or not kept[(d, out["quality_rules"][d])][1]}
    out["line_dedup"] = docs
    groups = brute.groups(list(docs.items()), 5, 80)
    docs = {d: docs[d] for d, _, c in groups if c == d}
    out["jaccard_join"] = docs
    bad = {d for d, _ in brute.leaks(list(docs.items()), items)}
    out["decontamination"] = {d: t for d, t in docs.items() if d not in bad}
    return out


def test_pipeline_by_brute_force(spark, base, sample, duck):
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    want = by_hand([(d, t) for d, t, _ in sample], items)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == want[name], name
        assert all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    left = want["decontamination"]
    assert 0 < len(left) < len(sample)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    assert {d: r.ids for d, r in got.items()} == {
        d: library.encode(t, add_special_tokens=False).ids for d, t in left.items()
    }
    assert "pipeline" in entry.queries()


def test_rules_of_the_pipeline_keep_long_and_non_latin_texts(spark, base):
    rng = np.random.default_rng(3)
    ranks = np.arange(1, 20_001)
    long = " ".join(f"w{i}" for i in rng.choice(ranks, 120_000, p=1 / ranks / (1 / ranks).sum()))
    cyrillic = " ".join(f"слово{chr(0x430 + i)} текст{chr(0x44F - i)}" for i in range(25)) + " NASA"
    junk = " ".join(rng.choice(["buy", "now", "here"], 3000))
    shout = " ".join("".join(chr(65 + x) for x in rng.integers(0, 26, 6)) for _ in range(60))
    rows = [(1, long), (2, cyrillic), (3, junk), (4, shout)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, base).collect()} == {1, 2}


def test_stages_of_odd_rows(spark, odd, nothing, base):
    for frame in (odd, nothing):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, frame, base).collect()
            docs = stage(spark, docs, base)
            if name not in ("quality_rules", "bpe"):
                assert docs.columns == frame.columns
            assert frame is odd or rows == []
        assert docs.count() <= frame.count()


def test_items_with_text_ids(spark):
    item = "which of these seven words is the longest one of all"
    docs = spark.createDataFrame([(1, f"well {item} so"), (2, "nothing of the kind")], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", item), (None, "another item of at least five words")], "item_id string, text string")
    got = {r.doc_id: [(m.item_id, m.score) for m in r.matches] for r in contaminated(docs, items).collect()}
    assert got == {1: [("q-1", 1.0)], 2: []}


def test_stages_of_dotted_names(spark, base):
    rows = [(1, "The quick brown fox jumps over the lazy dog while the cat sleeps under a warm red blanket today. " * 2, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `c``d` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base)
        assert docs.columns == ["doc_id", "text", "a.b", "c`d"]
    assert docs.count() in (0, 1)
