"""The fits and paths of operators 5 and 6 against plain loops, and the registered links of operator 3."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from cohortflow.llm.language import LanguageModel, Scorer, grams
from cohortflow.llm.quality_model import fit
from tests.llm.test_pairs_and_pipeline import links

# Boosted trees -----------------------------------------------------------------------------------


def plain_fit(x, y, n_trees, depth, rate, bins, smooth, least):
    """Trees as nested tuples, every split sought by trying all of them on all rows."""
    n, width = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    margin = np.full(n, np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    trees = []

    def grow(rows, level, g, h):
        if level == depth:
            return ("leaf", rate * g[rows].sum() / (h[rows].sum() + smooth))
        best = (1e-12, None, None)
        for f in range(width):
            for e in edges[f]:
                left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                if len(left) < least or len(right) < least:
                    continue
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + smooth) for r in (left, right))
                gain -= g[rows].sum() ** 2 / (h[rows].sum() + smooth)
                if gain > best[0] + 1e-12:
                    best = (gain, f, e)
        _, f, e = best
        if f is None:
            return ("all", grow(rows, level + 1, g, h))
        return ("split", f, e, grow(rows[x[rows, f] <= e], level + 1, g, h), grow(rows[x[rows, f] > e], level + 1, g, h))

    def value(tree, row):
        if tree[0] == "leaf":
            return tree[1]
        if tree[0] == "all":
            return value(tree[1], row)
        return value(tree[3] if row[tree[1]] <= tree[2] else tree[4], row)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(n), 0, y - p, p * (1 - p))
        trees.append(tree)
        margin = margin + np.array([value(tree, r) for r in x])
    return margin, trees, value


@pytest.mark.parametrize("depth,bins", [(1, 8), (2, 8), (3, 5)])
def test_trees_are_those_of_an_exhaustive_search(depth, bins):
    rng = np.random.default_rng(depth)
    x = rng.normal(size=(120, 3))
    x[:, 2] = rng.integers(0, 3, 120)
    y = (x[:, 0] * 1.5 + (x[:, 2] == 1) + rng.normal(size=120) * 0.3 > 0.4).astype(float)
    made = fit(x, y, n_trees=6, depth=depth, rate=0.3, bins=bins, smooth=1.0, least=4)
    margin, trees, value = plain_fit(x, y, 6, depth, 0.3, bins, 1.0, 4)
    np.testing.assert_allclose(made.score(x), 1 / (1 + np.exp(-margin)), atol=1e-9)
    fresh = rng.normal(size=(200, 3))
    fresh[:, 2] = rng.integers(0, 3, 200)
    want = np.array([sum(value(t, r) for t in trees) for r in fresh]) + made.start
    np.testing.assert_allclose(made.score(fresh), 1 / (1 + np.exp(-want)), atol=1e-9)
    first = trees[0]
    assert first[0] == "split" and (made.feature[0, 0], made.threshold[0, 0]) == (first[1], first[2])


# Language paths ----------------------------------------------------------------------------------


def plain_path(scores, prior, switch):
    """The best path by trying every step from every language."""
    n, k = scores.shape
    best, back = prior.copy(), []
    for t in range(n):
        step = np.array([[best[a] - (switch if a != b else 0) for a in range(k)] for b in range(k)])
        back.append(step.argmax(axis=1))
        best = step.max(axis=1) + scores[t]
    now, out = int(best.argmax()), []
    for t in range(n - 1, -1, -1):
        out.append(now)
        now = int(back[t][now])
    return out[::-1], float(best.max())


@pytest.mark.parametrize("switch", [0.5, 3.0, 12.0])
def test_paths_are_those_of_a_plain_viterbi(switch):
    rng = np.random.default_rng(7)
    words = sorted({"".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(80)})
    number = {g: i for i, g in enumerate(sorted({g for w in words for g in grams(w)}))}
    names = ["aa", "bb", "cc"]
    table, prior = rng.normal(size=(len(number) + 1, 3)) * 2, rng.normal(size=3)
    model = LanguageModel(names, number, table, {"latin": np.ones(3, bool)}, prior)
    scorer = Scorer(model, switch)
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(50)] + [None, ""]
    labels, _ = scorer.paths(texts)
    for text, got in zip(texts, labels):
        split = (text or "").split()
        if not split:
            assert len(got) == 0
            continue
        scores = np.array([table[[number[g] for g in grams(w)]].sum(axis=0) for w in split])
        want, best = plain_path(scores, prior, switch)
        mine = prior[got[0]] - 0.0 + sum(scores[t, x] for t, x in enumerate(got))
        mine -= switch * sum(a != b for a, b in zip(got[:-1], got[1:]))
        # The prior may be left at the first step, at the price of a switch.
        mine = max(mine, max(prior) - switch + mine - prior[got[0]])
        assert got.tolist() == want or mine == pytest.approx(best, abs=1e-4)


# Links -------------------------------------------------------------------------------------------


def test_registered_links(spark, base, sample):
    got = Counter(tuple(r) for r in entry.queries()["op3_jaccard_links"](spark, base).collect())
    assert got == links([(d, t) for d, t, _ in sample], 3, 90)
