"""Neighbour graphs of series against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortflow.operators import neighbours as N
from cohortflow.operators import series as S


def brute_distance(x, y):
    table = np.full((len(x) + 1, len(y) + 1), np.inf)
    table[0, 0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1, j + 1] = (a - b) ** 2 + min(table[i, j], table[i, j + 1], table[i + 1, j])
    return np.sqrt(table[-1, -1])


def brute_edges(rows, k):
    out = {}
    for i, x in rows:
        far = sorted((brute_distance(x, y), j) for j, y in rows if j != i)
        out[i] = far[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(4)


def ragged(n, seed, groups=4):
    rng = np.random.default_rng(seed)
    shapes = [np.cumsum(rng.normal(size=20)) for _ in range(groups)]
    return [
        (int(i), [float(x) for x in shapes[i % groups][: rng.integers(12, 21)] + rng.normal(size=1) * 0.3 + rng.normal(size=20)[:1] * 0.1])
        for i in range(n)
    ]


def test_pairwise_distances_and_bounds():
    rng = np.random.default_rng(1)
    xs = [rng.normal(size=rng.integers(1, 40)).tolist() for _ in range(60)]
    ys = [rng.normal(size=rng.integers(1, 40)).tolist() for _ in range(60)]
    (a, la), (b, lb) = N._padded(xs), N._padded(ys)
    want = np.array([brute_distance(x, y) for x, y in zip(xs, ys)])
    far = np.full(60, np.inf)
    np.testing.assert_allclose(N.warp_pairs(a, la, b, lb, far), want)
    assert (N.least_distances(a, la, b, lb) <= want + 1e-12).all()
    limit = want * np.where(np.arange(60) % 2, 1.01, 0.9)
    got = N.warp_pairs(a, la, b, lb, limit)
    assert np.isinf(got[::2]).all()
    np.testing.assert_allclose(got[1::2], want[1::2])


def test_exact_neighbours_equal_all_pairs(spark):
    rows = ragged(70, 3) + [(200, [1.0]), (201, [1.0]), (202, [5.0]), (203, [1.0, 1.0])]
    odd = [(300, []), (301, None), (302, [1.0, float("nan")]), (303, [None])]
    got = N.nearest_series(frame(spark, rows + odd), 5, exact=True).collect()
    want = brute_edges(rows, 5)
    assert {(r["src"], r["dst"], r["rank"]) for r in got} == {
        (i, j, p + 1) for i, far in want.items() for p, (_, j) in enumerate(far)
    }
    for r in got:
        assert r["distance"] == pytest.approx(want[r["src"]][r["rank"] - 1][0], abs=1e-9)


def test_exact_search_over_many_tiles(spark, monkeypatch):
    """Small tiles, few askers at a time, far series, copies over more than a tile and rows without an id."""
    for name, value in (("TILE", 8), ("QUERIES", 5)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, rng.exponential(20, rng.integers(1, 6)).tolist()) for i in range(70)]
    rows += [(100 + i, [3.0, 4.0, 5.0]) for i in range(24)] + [(300, [900.0, 2.0]), (301, [7.0])]
    got = N.nearest_series(frame(spark, rows + [(None, [3.0, 4.0, 5.0])]), 4, exact=True).collect()
    want = brute_edges(rows, 4)
    assert {(r["src"], r["dst"], r["rank"]) for r in got} == {
        (i, j, p + 1) for i, far in want.items() for p, (_, j) in enumerate(far)
    }


def test_copies_in_a_tile_are_met_as_one():
    """Of members that are alike the least ids count, and those that ask alike ask once."""
    ids, v = np.arange(3000), [[1.0, 2.0]] * 2999 + [[1.0, 2.5]]
    kinds, held = N._alike(ids[::-1], v[::-1], 4)
    assert {tuple(k): list(i) for k, i in zip(kinds, held)} == {(1.0, 2.0): [0, 1, 2, 3], (1.0, 2.5): [2999]}
    members = pd.DataFrame({"id": ids, "v": v, "radius": 0.0, "is_member": True})
    asks = pd.DataFrame({"id": [1, 2999, 7000], "v": [[1.0, 2.0], [1.0, 2.5], [1.0, 2.0]], "radius": np.inf, "is_member": False})
    got = N._nearest_in(pd.concat([members, asks]), 3)
    assert {tuple(r) for r in got.itertuples(index=False)} == {
        (1, 0, 0.0), (1, 2, 0.0), (1, 3, 0.0), (7000, 0, 0.0), (7000, 1, 0.0), (7000, 2, 0.0),
        (2999, 0, 0.5), (2999, 1, 0.5), (2999, 2, 0.5),
    }


def test_pairs_of_a_unit_share_their_series():
    """A series comes once for all pairs of the unit; an id that two series have stands for both."""
    series = {1: [[1.0, 2.0, 3.0]], 2: [[4.0, 5.0, 6.0]], 3: [[1.0, 2.0, 2.0, 3.0, 4.0], [1.0]]}
    sent = [(i, i, 0.0, v, False) for i in (3, 1, 2) for v in series[i]]
    asked = [(1, 2, np.inf, None, True), (1, 3, np.inf, None, True), (2, 3, 2.0, None, True)]
    unit = pd.DataFrame(asked + sent, columns=["a", "b", "limit", "v", "is_pair"])
    got = sorted(tuple(r) for r in N._measure(unit).itertuples(index=False))
    want = sorted((a, b, brute_distance(x, y)) for a, b, *_ in asked[:2] for x in series[a] for y in series[b])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    np.testing.assert_allclose([d for *_, d in got], [d for *_, d in want])


def test_recall_without_the_exact_pass(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24)).cumsum(axis=1)
    rows = [(i, (base[i % 12] + rng.normal(size=24) * 0.6).tolist()) for i in range(360)]
    df = frame(spark, rows)
    dense = S.dtw_blocks(df).collect()
    table = {}
    for r in dense:
        cells = np.asarray(r["cells"]).reshape(len(r["left"]), len(r["right"]))
        for x, i in enumerate(r["left"]):
            for y, j in enumerate(r["right"]):
                table[i, j] = table[j, i] = cells[x, y]
    got = N.nearest_series(df, 8).collect()
    truth = {i: set(sorted((j for j in range(360) if j != i), key=lambda j: (table[i, j], j))[:8]) for i in range(360)}
    hits = sum(r["dst"] in truth[r["src"]] for r in got)
    assert len(got) == 360 * 8 and hits / len(got) >= 0.9
    for r in got[:200]:
        assert r["distance"] == pytest.approx(table[r["src"], r["dst"]])


def test_candidates_are_bounded_however_alike_the_series(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(600)]
    pairs = N.beside_each_other(N.described(frame(spark, rows)), 1, reach=4, orders=3)
    assert pairs.count() <= 600 * 4 * 3
    edges = N.nearest_series(frame(spark, rows[:40]), 3, exact=True).collect()
    assert all(r["distance"] == 0 for r in edges)
    assert {(r["src"], r["dst"]) for r in edges} == {
        (i, j) for i in range(40) for j in [x for x in range(40) if x != i][:3]
    }


def test_labels_of_separated_groups(spark):
    rng = np.random.default_rng(8)
    shapes = [np.sin(np.arange(30) / s) * 4 for s in (2.0, 4.0, 9.0)]
    rows = [(i, (shapes[i % 3] + rng.normal(size=30) * 0.4).tolist()) for i in range(90)]
    df = frame(spark, rows)
    near, sigma = N.graph_affinity(N.nearest_series(df, 8))
    assert sigma > 0
    got = {r["id"]: r["label"] for r in N.graph_labels(near, 3).collect()}
    assert got == {i: i % 3 for i in range(90)}
    dense, _ = S.rbf_affinity(S.dtw_blocks(df))
    assert got == {r["id"]: r["label"] for r in S.spectral_labels(dense).collect()}


def test_eigenvectors_of_a_small_graph(spark):
    """Two cliques with one weak link: the second vector parts them; it is an eigenvector of the dense matrix."""
    rng = np.random.default_rng(4)
    edges = [(i, j, float(rng.uniform(0.5, 1))) for g in (0, 10) for i in range(g, g + 10) for j in range(i + 1, g + 10)]
    edges.append((0, 10, 0.05))
    labels = {r["id"]: (r["label"], r["converged"]) for r in N.graph_labels(spark.createDataFrame(edges, "a long, b long, weight double"), 2).collect()}
    assert labels == {i: (int(i >= 10), True) for i in range(20)}


def test_few_series(spark):
    assert N.nearest_series(frame(spark, [(1, [1.0])]), 3).collect() == []
    two = N.nearest_series(frame(spark, [(1, [1.0]), (2, [4.0, 5.0])]), 3, exact=True)
    assert sorted(tuple(r) for r in two.collect()) == [(1, 2, 5.0, 1), (2, 1, 5.0, 1)]
    near, _ = N.graph_affinity(two)
    assert {r["id"]: r["label"] for r in N.graph_labels(near, 3).collect()} == {1: 0, 2: 1}
    with pytest.raises(ValueError):
        N.graph_affinity(two.where(F.lit(False)))
