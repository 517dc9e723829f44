"""Nearest series by warping distance, and spectral clusters of their graph (SER2 to SER4).

The matrix of all distances grows with the square of the series; a graph of the
k nearest ones of each grows with series times k.  First neighbours come from
orders along coarse averages, better ones from the neighbours of neighbours.
``exact`` looks in tiles of like series, wherever lower bounds of the distance
leave room for a nearer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.operators.quantiles import exact_quantiles
from cohortflow.operators.series import cut_embedding
from cohortflow.session import keep

# Stretches of a series that are averaged for the orders, and the orders, each along other weights of them.
COARSE = 8
ORDERS = 8
# Next series in an order that are candidates.
REACH = 6
# Series of an order, or neighbourhoods, whose pairs are measured as one unit.
STRETCH = 256
HOODS = 64
# Cells of path matrices that are worked on together, and diagonals between looks at what can be given up.
CELLS = 1 << 21
LOOK = 16
# Least series of a tile of the exact search, bits of the grid in each of its directions, and series
# that ask in a tile at once; a little more room than a radius, for rounding.
TILE = 256
BITS = 5
QUERIES = 4096
ROOM = 1 + 1e-9
# Columns beyond the wanted ones in the search for eigenvectors, and products between two looks at them.
SPARE = 6
PRODUCTS = 3


def described(series: DataFrame) -> DataFrame:
    """(id, v) with the ends, extremes and coarse averages of each series, written.

    Series that are empty or hold a NULL or NaN are left out.
    """
    values = F.col("v").cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))
    known = series.where(F.size("v") > 0).where(fine).select(F.col("id").cast("bigint").alias("id"), values.alias("v"))
    n = F.size("v")

    def stretch(j: int) -> Column:
        start, end = F.floor(n * j / COARSE), F.floor(n * (j + 1) / COARSE)
        start = F.least(start, n - 1).cast("int")
        part = F.slice("v", start + 1, F.greatest(end.cast("int") - start, F.lit(1)))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)

    return keep(
        known.select(
            "id", "v", n.alias("n"), F.col("v")[0].alias("first"), F.element_at("v", -1).alias("last"),
            F.array_min("v").alias("low"), F.array_max("v").alias("high"),
            F.array(*[stretch(j) for j in range(COARSE)]).alias("coarse"),
        ),
        "series",
    )


def beside_each_other(known: DataFrame, seed: int, reach: int = REACH, orders: int = ORDERS) -> DataFrame:
    """Pairs (a, b, unit), a < b, of series that stand within ``reach`` places in one of the orders.

    The unit is a stretch of an order that has them.

    Places are those within a part of a range partitioning, so no order is held
    in one task, and however many series are alike, each has few candidates.
    """
    rng = np.random.default_rng(seed)
    weights = np.vstack([np.ones(COARSE), rng.normal(size=(max(0, orders - 1), COARSE))])
    scores = [
        sum((F.col("coarse")[j] * float(w) for j, w in enumerate(row)), F.lit(0.0)) for row in weights
    ]
    placed = known.select("id", F.posexplode(F.array(*scores)).alias("o", "score"))
    placed = placed.repartitionByRange("o", "score", "id").sortWithinPartitions("o", "score", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, ids, passed = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        stretches = TaskContext.get().partitionId() << 32
        for batch in batches:
            o = np.concatenate([o, batch.column("o").to_numpy().astype(np.int64)])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            kept = max(0, len(ids) - batch.num_rows)
            found = []
            for step in range(1, min(reach, len(ids) - 1) + 1):
                # Pairs whose later member is new in this batch.
                at = np.arange(max(kept, step), len(ids))
                at = at[o[at] == o[at - step]]
                found.append(np.column_stack([ids[at - step], ids[at], stretches + (passed + at - kept) // STRETCH]))
            pairs = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            ends, unit = pairs[:, :2], pairs[:, 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), pa.array(unit)], names=["a", "b", "unit"]
            )
            passed += batch.num_rows
            o, ids = o[-reach:], ids[-reach:]

    pairs = placed.select("o", "id").mapInArrow(run, "a bigint, b bigint, unit bigint").where("a < b")
    return pairs.groupBy("a", "b").agg(F.min("unit").alias("unit"))


def warp_pairs(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Warping distances of the rows of a with those of b, one by one; infinite beyond a row's limit.

    Pairs advance together along the diagonals of their path matrices.  Every
    path crosses one of two neighbouring diagonals, so a pair whose cells there
    are all beyond its limit is given up.
    """
    out = np.full(len(a), np.inf)
    alive = np.arange(len(a))
    square = limit * limit
    rows, width = a.shape[1], b.shape[1]
    down, back = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T[::-1])
    two, one = np.full((rows + 1, len(a)), np.inf), np.full((rows + 1, len(a)), np.inf)
    two[0] = 0.0
    last = la + lb - 2
    for d in range(int(last.max(initial=-1)) + 1):
        lo, hi = max(0, d - width + 1), min(rows, d + 1)
        now = np.full((rows + 1, len(alive)), np.inf)
        gap = down[lo:hi] - back[width - 1 - d + lo : width - 1 - d + hi]
        best = np.minimum(np.minimum(one[lo:hi], one[lo + 1 : hi + 1]), two[lo:hi])
        now[lo + 1 : hi + 1] = best + gap * gap
        ended = np.flatnonzero(last[alive] == d)
        out[alive[ended]] = now[la[alive[ended]], ended]
        if d == 0:
            two[0] = np.inf
        two, one = one, now
        if d % LOOK == LOOK - 1:
            going = (np.minimum(two.min(axis=0), one.min(axis=0)) <= square[alive]) & (last[alive] > d)
            if going.mean() < 0.7:
                alive = alive[going]
                down, back = down[:, going], back[:, going]
                two, one = np.ascontiguousarray(two[:, going]), np.ascontiguousarray(one[:, going])
                if not len(alive):
                    break
    out[out > square] = np.inf
    return np.sqrt(out)


def least_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of padded rows: ends meet ends, and no point meets beyond the other's range."""
    inside_a = np.arange(a.shape[1]) < la[:, None]
    inside_b = np.arange(b.shape[1]) < lb[:, None]

    def beyond(x: np.ndarray, inside: np.ndarray, y: np.ndarray, of: np.ndarray) -> np.ndarray:
        low = np.where(of, y, np.inf).min(axis=1)[:, None]
        high = np.where(of, y, -np.inf).max(axis=1)[:, None]
        over = np.maximum(x - high, 0) + np.maximum(low - x, 0)
        return (np.where(inside, over, 0.0) ** 2).sum(axis=1)

    rows = np.arange(len(a))
    start = (a[:, 0] - b[:, 0]) ** 2
    end = (a[rows, la - 1] - b[rows, lb - 1]) ** 2
    ends = np.where((la == 1) & (lb == 1), start, start + end)
    return np.sqrt(np.maximum(ends, np.maximum(beyond(a, inside_a, b, inside_b), beyond(b, inside_b, a, inside_a))))


def _padded(rows: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max())))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def _measure(unit: pd.DataFrame) -> pd.DataFrame:
    """Distances of the pairs of a unit, from the series that came with them."""
    paired = unit["is_pair"].to_numpy()
    pairs, held = unit[paired], unit[~paired].sort_values("a")
    ids, rows = held["a"].to_numpy(), held["v"].to_list()
    a, b, limit = (pairs[c].to_numpy() for c in ("a", "b", "limit"))
    # An id that more than one series has stands for each of them.
    from_a, from_b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    of_a, of_b = np.searchsorted(ids, a, side="right") - from_a, np.searchsorted(ids, b, side="right") - from_b
    ways = of_a * of_b
    at = np.repeat(np.arange(len(pairs)), ways)
    way = np.arange(len(at)) - np.repeat(np.cumsum(ways) - ways, ways)
    left, right = from_a[at] + way // of_b[at], from_b[at] + way % of_b[at]
    lengths = np.array([len(v) for v in rows])
    sizes = lengths[left] * lengths[right]
    out, start = np.full(len(at), np.inf), 0
    while start < len(at):
        held_cells = np.cumsum(sizes[start:])
        some = slice(start, start + max(1, int(np.searchsorted(held_cells, CELLS, side="right"))))
        x, lx = _padded([rows[i] for i in left[some]])
        y, ly = _padded([rows[i] for i in right[some]])
        most = limit[at[some]]
        near = np.flatnonzero(least_distances(x, lx, y, ly) <= most)
        if len(near):
            out[start + near] = warp_pairs(x[near], lx[near], y[near], ly[near], most[near])
        start = some.stop
    good = np.isfinite(out)
    return pd.DataFrame({"a": a[at[good]], "b": b[at[good]], "distance": out[good]})


def measured(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs (a, b, limit, unit) that are not further apart than their limit.

    A series goes once to each unit that has pairs of it, not along with each pair.
    """
    needed = pairs.select("unit", F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = needed.join(known.select("id", "v"), "id").select(
        "unit", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("limit"), "v",
        F.lit(False).alias("is_pair"),
    )
    asked = pairs.select(
        "unit", "a", "b", "limit", F.lit(None).cast("array<double>").alias("v"), F.lit(True).alias("is_pair")
    )
    work = asked.unionByName(sent).repartition(_tasks(known), "unit")
    return work.groupBy("unit").applyInPandas(_measure, "a bigint, b bigint, distance double")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "distance").unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "distance")
    )


def _first(edges: DataFrame, k: int, by: str = "src", other: str = "dst") -> DataFrame:
    """The k nearest of each series, the smaller id first at one distance."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("distance", other))
    return edges.withColumn("rank", rank).where(F.col("rank") <= k)


def _radius(edges: DataFrame, k: int) -> DataFrame:
    """(id, radius): the distance that a nearer series must not exceed; infinite with under k neighbours."""
    full = F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf")))
    return edges.groupBy(F.col("src").alias("id")).agg(full.alias("radius"))


def _limited(pairs: DataFrame, radius: DataFrame) -> DataFrame:
    """Pairs with the larger radius of their two series as limit."""
    ra = radius.select(F.col("id").alias("a"), F.col("radius").alias("_ra"))
    rb = radius.select(F.col("id").alias("b"), F.col("radius").alias("_rb"))
    far = F.lit(float("inf"))
    limit = F.greatest(F.coalesce("_ra", far), F.coalesce("_rb", far))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", "unit", limit.alias("limit"))


ENDS = ("first", "last", "low", "high")


def _tiled(known: DataFrame, total: int) -> DataFrame:
    """Series with a tile: a few hundred that are alike in their ends and extremes, or the root of all where that is more.

    Series go along a curve through the grid of the quantiles of the four numbers, which is
    cut into tiles inside the parts of a range partitioning.
    """
    size = max(TILE, int(np.sqrt(total)))
    steps = [i / 2**BITS for i in range(1, 2**BITS)]
    code = F.lit(0)
    cuts = known.stat.approxQuantile(list(ENDS), steps, 0.25 / 2**BITS)
    for place, (name, cut) in enumerate(zip(ENDS, cuts)):
        level = sum(((F.col(name) > F.lit(c)).cast("int") for c in sorted(set(cut))), F.lit(0))
        for bit in range(BITS):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(level, bit).bitwiseAND(F.lit(1)), bit * len(ENDS) + place))
    placed = known.select("id", "v", "n", *ENDS, code.alias("code"))
    placed = placed.repartitionByRange(_tasks(known), "code", "id").sortWithinPartitions("code", "id")
    number = F.monotonically_increasing_id()
    part, row = F.shiftright(number, 33), number.bitwiseAND(F.lit(2**33 - 1))
    tile = F.shiftleft(part, 33) + F.floor(row / size)
    return keep(placed.withColumn("tile", tile).drop("code"), "tiles")


def _tasks(df: DataFrame) -> int:
    """Tasks of work that a small number of bytes may ask for."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _asked(rows: DataFrame, radius: DataFrame) -> DataFrame:
    """(tile, id, v, radius): each series with the other tiles that may hold one within its radius.

    The tiles' boxes, as many as the root of the number of series at most, meet every series.
    """
    span = [c(f).alias(f"{side}_{f}") for f in ENDS for side, c in (("from", F.min), ("to", F.max))]
    boxes = rows.groupBy("tile").agg(*span).withColumnRenamed("tile", "_tile")
    wide = rows.select("id", "v", "n", *ENDS, "tile").join(radius, "id")

    def gap(f: str) -> Column:
        off = F.greatest(F.col(f"from_{f}") - F.col(f), F.col(f) - F.col(f"to_{f}"), F.lit(0.0))
        return off * off

    # A series of one point may meet another by a single step.
    ends = gap("first") + F.when(F.col("n") == 1, 0.0).otherwise(gap("last"))
    near = F.greatest(ends, gap("low"), gap("high")) <= F.col("radius") * F.col("radius") * ROOM
    met = wide.join(F.broadcast(boxes), (F.col("tile") != F.col("_tile")) & near)
    return met.select(F.col("_tile").alias("tile"), "id", "v", "radius")


def _alike(ids: np.ndarray, rows: list, most: int) -> tuple[list, list[np.ndarray]]:
    """Different series, each with the ``most`` smallest ids that have it."""
    held: dict[bytes, list] = {}
    for i in np.argsort(ids, kind="stable"):
        held.setdefault(np.asarray(rows[i], dtype=float).tobytes(), []).append(ids[i])
    return [np.frombuffer(b) for b in held], [np.unique(x)[:most] for x in held.values()]


def _nearest_in(unit: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest members of a tile, within its radius, for each series that asks there."""
    inside = unit["is_member"].to_numpy()
    there = unit[inside]
    asks = unit[~inside]
    out: list[tuple] = []
    if len(there) and len(asks):
        # One more of each kind than wanted, as a series does not count for itself.
        members, ids = _alike(there["id"].to_numpy(), list(there["v"]), k + 1)
        y, ly = _padded(members)
        edge = [np.array([f(m) for m in members]) for f in (lambda m: m[0], lambda m: m[-1], np.min, np.max)]
        kinds: dict[bytes, list[int]] = {}
        for at, v in enumerate(asks["v"]):
            kinds.setdefault(np.asarray(v, dtype=float).tobytes(), []).append(at)
        limits, names = asks["radius"].to_numpy(), asks["id"].to_numpy()
        queries = [np.frombuffer(b) for b in kinds]
        reach = np.array([limits[at].max() for at in kinds.values()])
        x, lx = _padded(queries)
        mine = [np.array([f(q) for q in queries]) for f in (lambda q: q[0], lambda q: q[-1], np.min, np.max)]
        found: list[list] = [[] for _ in queries]
        step = max(1, (1 << 20) // len(members))
        for start in range(0, len(queries), step):
            some = slice(start, start + step)
            gaps = [(q[some, None] - m[None, :]) ** 2 for q, m in zip(mine, edge)]
            single = (lx[some, None] == 1) & (ly[None, :] == 1)
            bound = np.maximum(np.where(single, gaps[0], gaps[0] + gaps[1]), np.maximum(gaps[2], gaps[3]))
            qs, ms = np.nonzero(bound <= (reach[some, None] ** 2) * ROOM)
            qs += start
            few = max(1, CELLS // (x.shape[1] * y.shape[1]))
            for low in range(0, len(qs), few):
                q, m = qs[low : low + few], ms[low : low + few]
                d = warp_pairs(x[q], lx[q], y[m], ly[m], reach[q] * ROOM)
                good = np.isfinite(d)
                for i, j, far in zip(*_best(q[good], m[good], d[good], k + 1)):
                    found[i].append((far, j))
        for q, ats in enumerate(kinds.values()):
            ends = sorted((far, i) for far, j in found[q] for i in ids[j])
            for at in ats:
                others = (e for e in ends if e[1] != names[at])
                out += [(names[at], i, far) for (far, i), _ in zip(others, range(k))]
    return pd.DataFrame(out, columns=["src", "dst", "distance"])


def _best(q: np.ndarray, m: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs whose distance is among the ``most`` smallest ones of their query; equal ones all stay."""
    order = np.lexsort((d, q))
    q, m, d = q[order], m[order], d[order]
    start = np.searchsorted(q, q, side="left")
    last = np.minimum(start + most - 1, np.searchsorted(q, q, side="right") - 1)
    good = d <= d[last]
    return q[good], m[good], d[good]


def _search(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance) of the nearest members of the tiles in which series ask, at most QUERIES at a time."""
    asked = keep(asked, "asked")
    units = asked.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("units"))
    # All that are alike ask together.
    number = F.pmod(F.xxhash64("v"), F.col("units"))
    asking = asked.join(units, "tile").select(
        "tile", number.alias("unit"), "id", "v", "radius", F.lit(False).alias("is_member")
    )
    members = rows.join(units, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("units") - 1)).alias("unit"), "id", "v",
        F.lit(0.0).alias("radius"), F.lit(True).alias("is_member"),
    )
    work = asking.unionByName(members).repartition(_tasks(rows), "tile", "unit")
    return work.groupBy("tile", "unit").applyInPandas(
        lambda unit: _nearest_in(unit, k), "src bigint, dst bigint, distance double"
    )


def exact_neighbours(known: DataFrame, total: int, k: int) -> DataFrame:
    """(src, dst, distance, rank): the k nearest of all series, each sought in its own tile, then where its radius reaches."""
    rows = _tiled(known.where("id IS NOT NULL"), total)
    own = rows.select("tile", "id", "v", F.lit(float("inf")).alias("radius"))
    near = keep(_first(_search(rows, own, k), k), "own")
    short = rows.select("id").distinct().join(_radius(near, k), "id", "left")
    radius = short.select("id", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    far = _search(rows, _asked(rows, radius), k)
    return keep(_first(near.select("src", "dst", "distance").unionByName(far), k), "edges")


def nearest_series(
    series: DataFrame, k: int = 10, rounds: int = 6, exact: bool = False, seed: int = 42
) -> DataFrame:
    """(src, dst, distance, rank): the k nearest series of each of (id, v), by warping distance.

    Every round measures the neighbours of neighbours, reverse ones included,
    over edges that the last round found, until hardly any edge changes; that
    finds nearly all nearest ones.  ``exact`` seeks them in tiles of like series
    instead, first in a series' own tile, then in all that lower bounds leave within the
    distance found there, so nothing is missed; how many they are lies in
    the data.  Equal distances go by the smaller id.  A series alone has no row.
    """
    known = described(series)
    total = known.count()
    if total < 2:
        return known.select(
            F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")
        ).limit(0)
    if exact:
        return exact_neighbours(known, total, k).select("src", "dst", "distance", "rank")
    pairs = keep(beside_each_other(known, seed), "pairs")
    seen = pairs.select("a", "b")
    found = keep(measured(pairs.withColumn("limit", F.lit(float("inf"))), known), "measured")
    edges = keep(_first(_both_ways(found), k).withColumn("new", F.lit(True)), "edges")
    for _ in range(rounds):
        back = _first(edges.drop("rank"), k, "dst", "src")
        ways = edges.select(F.col("src").alias("via"), F.col("dst").alias("end"), "new").unionByName(
            back.select(F.col("dst").alias("via"), F.col("src").alias("end"), "new")
        )
        ways = ways.groupBy("via", "end").agg(F.max("new").alias("new"))
        one = ways.select("via", F.col("end").alias("a"), F.col("new").alias("_na"))
        two = ways.select("via", F.col("end").alias("b"), F.col("new").alias("_nb"))
        near = one.join(two, "via").where("a < b AND (_na OR _nb)")
        # Pairs of one neighbourhood are measured together.
        near = near.groupBy("a", "b").agg(F.min("via").alias("via"))
        unit = F.pmod(F.xxhash64("via"), F.lit(total // HOODS + 1)).alias("unit")
        fresh = keep(near.join(seen, ["a", "b"], "left_anti").select("a", "b", unit), "fresh")
        seen = seen.unionByName(fresh.select("a", "b"))
        more = measured(_limited(fresh, _radius(edges, k)), known)
        old = edges.select("src", "dst", "distance", F.lit(False).alias("new"))
        better = old.unionByName(_both_ways(more).withColumn("new", F.lit(True)))
        edges = keep(_first(better, k), "edges")
        if edges.where("new").count() <= 0.001 * k * total:
            break
    return edges.select("src", "dst", "distance", "rank")


def graph_affinity(edges: DataFrame, sigma: float | None = None) -> tuple[DataFrame, float]:
    """(a, b, weight), a < b: Gaussian weights of a graph's edges, and the sigma used.

    Sigma is the median length of the edges, floored at epsilon; an edge counts
    if one of its ends has it.
    """
    ends = (F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = keep(edges.groupBy(*ends).agg(F.min("distance").alias("distance")), "pairs")
    if sigma is None:
        middle = exact_quantiles(pairs, [], "distance", {"m": 0.5}).first()
        if middle is None:
            raise ValueError("the graph has no edges")
        sigma = max(float(middle["m"]), float(np.finfo(float).eps))
    weight = F.exp(-(F.col("distance") * F.col("distance")) / (2.0 * sigma * sigma))
    return pairs.select("a", "b", weight.alias("weight")), sigma


def _crossed(vectors: DataFrame, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross products of the columns x with themselves and with y: a small matrix per task, summed by Spark."""
    columns = [f"x{c}" for c in range(q)], [f"y{c}" for c in range(q)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((q, q)), np.zeros((q, q))
        for batch in batches:
            x, y = (np.column_stack([batch.column(c).to_numpy() for c in names]) for names in columns)
            g, h = g + x.T @ x, h + x.T @ y
        cells = pa.array(np.arange(q * q, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(g.ravel()), pa.array(h.ravel())], names=["cell", "g", "h"])

    rows = vectors.select(*columns[0], *columns[1]).mapInArrow(run, "cell int, g double, h double")
    out = np.zeros((2, q * q))
    for r in rows.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out[:, r["cell"]] = r["g"], r["h"]
    return out[0].reshape(q, q), out[1].reshape(q, q)


def _turned(vectors: DataFrame, columns: list[str], turn: np.ndarray, names: list[str]) -> DataFrame:
    """id and the columns times a small matrix; names beyond its width get directions that start anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            x = np.column_stack([batch.column(c).to_numpy() for c in columns]) @ turn
            fresh = [np.cos(ids.to_numpy() * (12.9898 + c)) for c in range(turn.shape[1], len(names))]
            made = [np.ascontiguousarray(x[:, c]) for c in range(x.shape[1])] + fresh
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, made)], names=["id", *names])

    kinds = ", ".join(f"{n} double" for n in names)
    return vectors.select("id", *columns).mapInArrow(run, f"id bigint, {kinds}")


def graph_labels(
    affinity: DataFrame,
    k: int = 3,
    seed: int = 42,
    starts: int = 3,
    max_rounds: int = 25,
    tol: float = 1e-6,
    max_iter: int = 100,
) -> DataFrame:
    """Spectral clusters of a graph (a, b, weight): (id, label, converged), labels numbered by smallest id.

    The leading eigenvectors of (I + D^-1/2 A D^-1/2) / 2 come from products of
    the table of edges with a table of k + SPARE columns; a small eigenproblem on
    their cross products turns the columns after each PRODUCTS products.
    """
    both = affinity.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").unionByName(
        affinity.select(F.col("b").alias("i"), F.col("a").alias("j"), "weight")
    )
    degrees = keep(both.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("d")), "degrees")
    n = degrees.count()
    if n < 2:
        raise ValueError("spectral clustering needs at least two series")
    k = min(k, n)
    q = min(k + SPARE, n)
    di = degrees.select(F.col("id").alias("i"), F.col("d").alias("_di"))
    dj = degrees.select(F.col("id").alias("j"), F.col("d").alias("_dj"))
    # An edge of no weight at this sigma has no part in the sums.
    scaled = F.coalesce(F.try_divide(F.col("weight"), F.sqrt(F.col("_di") * F.col("_dj"))), F.lit(0.0))
    matrix = keep(both.join(di, "i").join(dj, "j").select("i", "j", scaled.alias("w")), "matrix")
    names = [f"x{c}" for c in range(q)]

    def times(vectors: DataFrame) -> DataFrame:
        ends = matrix.join(vectors.withColumnRenamed("id", "j"), "j")
        sums = ends.groupBy(F.col("i").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_{c}") for c in names])
        half = [((F.col(c) + F.col(f"_{c}")) / 2).alias(c) for c in names]
        return vectors.join(sums, "id").select("id", *half)

    # The first direction is known: the roots of the degrees.
    start = [F.xxhash64("id", F.lit(seed), F.lit(c)) / 2.0**63 for c in range(1, q)]
    x = degrees.select("id", F.sqrt("d").alias("x0"), *[v.alias(n) for v, n in zip(start, names[1:])])
    values, settled, turn = np.zeros(k), False, np.eye(q)
    for _ in range(max_rounds):
        y = x
        for _ in range(PRODUCTS):
            y = times(y)
        y = y.select("id", *[F.col(c).alias(f"y{i}") for i, c in enumerate(names)])
        both_sides = keep(x.join(y, "id"), "vectors")
        g, h = _crossed(both_sides, q)
        # Directions that the columns hardly hold are dropped from the small problem.
        size, basis = np.linalg.eigh((g + g.T) / 2)
        sound = size > 1e-12 * size.max()
        white = basis[:, sound] / np.sqrt(size[sound])
        value, inner = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
        order = np.argsort(-value)
        turn = white @ inner[:, order]
        top = value[order][:k]
        settled = len(top) == k and bool(np.abs(top - values).max() < tol)
        if settled:
            break
        values = top if len(top) == k else np.zeros(k)
        x = _turned(both_sides, [f"y{i}" for i in range(q)], turn, names)
    used = min(k, turn.shape[1])
    last = _turned(both_sides, names, turn[:, :used], [f"v{c}" for c in range(used)])
    vectors = [F.col(f"v{c}") for c in range(used)]
    # A series of no weight at all lies at the origin.
    rows = [F.coalesce(F.try_divide(v, F.sqrt("d")), F.lit(0.0)) for v in vectors]
    embedded = keep(last.join(degrees, "id").select("id", F.array(*rows).alias("v")), "embedded")
    return cut_embedding(embedded, used, settled, seed, starts, max_iter)
