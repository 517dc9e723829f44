"""Removal of repeated strings against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from cohortflow.llm import suffix_dedup
from cohortflow.llm.suffix_dedup import Rolling, blocks_of, merge, remove_repeats, repeated_places, runs


def brute(texts, size):
    """n_bytes, n_removed, n_spans, kept of every text."""
    raws = [(t or "").encode() for t in texts]
    starts = defaultdict(int)
    for r in raws:
        for i in range(len(r) - size + 1):
            starts[r[i : i + size]] += 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if starts[r[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append((len(r), int(gone.sum()), len(runs(gone)[0]), bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def make_texts(rng, n, letters, size):
    texts, shared = [], []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            kind = rng.integers(0, 4)
            if kind == 0 and shared:
                s = shared[rng.integers(0, len(shared))]
                a = rng.integers(0, max(1, len(s) // 2))
                parts.append(s[a : a + rng.integers(1, len(s) + 1)])
            elif kind == 1:
                unit = "".join(rng.choice(list(letters), rng.integers(1, 6)))
                parts.append(unit * int(rng.integers(1, 2 * size)))
            else:
                s = "".join(rng.choice(list(letters), rng.integers(1, 4 * size)))
                shared.append(s)
                parts.append(s)
        texts.append("".join(parts))
    return texts


def test_merged_transforms_find_equal_strings():
    rng = np.random.default_rng(3)
    for size in (8, 20):
        blocks = [t.encode() for t in make_texts(rng, 60, "ab", size) if len(t) >= size]
        intervals, counts = repeated_places(blocks, size, Rolling(), shard_bytes=200)
        names: dict[bytes, set] = defaultdict(set)
        seen = Counter()
        for b, of in zip(blocks, intervals):
            assert len(of) == len(b) - size + 1
            for i, x in enumerate(of.tolist()):
                names[b[i : i + size]].add(x)
                seen[b[i : i + size]] += 1
        assert all(len(v) == 1 for v in names.values())
        assert len({next(iter(v)) for v in names.values()}) == len(names)
        assert all(counts[next(iter(v))] == seen[k] for k, v in names.items())


def test_merge_of_one_entry_each():
    entry_, interval = merge([np.array([5]), np.array([5]), np.array([7])], 4)
    assert sorted(entry_.tolist()) == [0, 1, 2] and len(set(interval.tolist())) == 2


def test_blocks_hold_every_place():
    rng = np.random.default_rng(4)
    for text in make_texts(rng, 30, "abc", 20):
        pieces, names, first, last, weight = blocks_of(text.encode(), 20, 6, Rolling())
        places = [p for a, b in zip(first, last) for p in range(a, b + 1)]
        assert places == list(range(max(0, len(text) - 19)))


@pytest.mark.parametrize("of_a_piece", [2 << 20, 500, 30])
def test_rows_by_brute_force(spark, odd, monkeypatch, of_a_piece):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", of_a_piece)
    monkeypatch.setattr(suffix_dedup, "MERGE_BYTES", 20_000)
    rng = np.random.default_rng(6)
    texts = make_texts(rng, 80, "abé ", 20) + [None, "", "short"]
    texts += texts[:3]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    frame = spark.createDataFrame(
        [(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, row string, packed string"
    )
    got = Counter(tuple(r) for r in remove_repeats(frame.repartition(4), 20).collect())
    want = brute([t for _, t in rows], 20)
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want))


def test_odd_rows_and_empty_table(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t if i != 5 else None for i, t in rows], 200)))
    want = Counter({k: n for k, n in want.items() if k[0] != 5})
    got = remove_repeats(odd).collect()
    assert Counter(tuple(r) for r in got if r.doc_id != 5) == want
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got if r.doc_id == 5] == [(300_000, 300_000, 1, b"")]
    assert remove_repeats(nothing).collect() == []


def test_registered(spark, base, sample):
    got = {r.doc_id: r for r in entry.queries()["op1_suffix_dedup"](spark, base).collect()}
    for (i, _, _), (n, removed, spans, kept) in zip(sample, brute([t for _, t, _ in sample], 200)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    """A passage that thousands of texts have, each between other words; runs of one letter of any length."""
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 20_000)
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    passage = "".join(rng.choice(letters, 60))
    texts = [
        "".join(rng.choice(letters, rng.integers(0, 40))) + passage + "".join(rng.choice(letters, rng.integers(0, 40)))
        for _ in range(4000)
    ]
    texts += ["z" * int(rng.integers(30, 400)) for _ in range(300)] + ["xy" * int(rng.integers(20, 300)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(frame, 40).collect()}
    want = brute(texts, 40)
    assert [got[i] for i in range(len(texts))] == want
