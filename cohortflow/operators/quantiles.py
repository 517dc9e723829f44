"""Exact quantiles from a mergeable sketch and one counting pass.

A sketch per key, merged from those of all tasks, bounds each wanted position by
two values.  One pass then counts the rows between these brackets as a whole and
the values inside them one by one, so what is shuffled and put in order is a
share of the rows that the sketch's size fixes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortflow.session import keep

# Size parameter of the sketches; a bracket holds about 0.6 % of the rows, or up to 1400.
SKETCH = 8192

# Half width of a bracket in normalized rank errors, each of which holds in 99 % of cases:
# a miss is beyond 10 standard deviations, and raises an error.
SAFETY = 4.0


def rank_error(k: int) -> float:
    """Normalized rank error of a KLL sketch of size parameter k, as its authors have fitted it."""
    return 2.296 / k**0.9723


def _fences(q1: Column, q3: Column, q1_far: Column, q3_far: Column) -> tuple[Column, Column]:
    """Lower and upper fence; with bounds of the quartiles, bounds of the fences, rounding included."""
    return q1 - (q3_far - q1) * 1.5, q3 + (q3 - q1_far) * 1.5


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    also: Mapping[str, Column] | None = None,
    whiskers: bool = False,
    sketch: int = SKETCH,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key; ``n`` counts the values.

    NULL and NaN values and rows with a NULL key are left out.  ``also`` names
    further aggregates of the same rows.  ``whiskers`` adds the furthest values
    within 1.5 interquartile ranges of the quartiles named q1 and q3: the fences
    are bracketed like the quantiles, so no further pass is needed.  Without
    keys there is one row, or none for no value.
    """
    by, names, more = list(keys), list(probs), dict(also or {})
    known = [F.col(k).isNotNull() for k in by]
    src = reduce(DataFrame.where, known, df).withColumn("_v", F.col(value).cast("double"))
    src = src.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    n, v = F.col("n"), F.col("_v")
    share = SAFETY * rank_error(sketch)
    # A position and its neighbours lie within 2 / n of the wanted rank, which is less than the
    # share from this many rows on; of fewer rows the bracket holds all.
    enough = n * share >= 2
    ranks = [r for p in probs.values() for r in (max(0.0, p - 2 * share), min(1.0, p + 2 * share))]
    bounds = F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, ranks)))
    found = (
        src.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(v).alias("_least"),
            F.max(v).alias("_most"),
            F.kll_sketch_agg_double("_v", sketch).alias("_sketch"),
            *[c.alias(name) for name, c in more.items()],
        )
        .where(n > 0)
        .select(*by, "n", *more, "_least", "_most", bounds.alias("_b"))
    )

    def bound(i: int, end: str) -> Column:
        return F.when(enough & F.lit(0 < ranks[i] < 1), F.col("_b")[i]).otherwise(F.col(end))

    bracket = {q: (bound(2 * i, "_least"), bound(2 * i + 1, "_most")) for i, q in enumerate(names)}
    if whiskers:
        (a, b), (c, d) = bracket["q1"], bracket["q3"]
        first, last = _fences(a, c, b, d), _fences(b, d, a, c)
        bracket["_low"], bracket["_high"] = (first[0], last[0]), (first[1], last[1])
    ends = [f"_{side}_{q}" for q in bracket for side in ("from", "to")]
    found = keep(
        found.select(*by, "n", *more, *[c.alias(e) for e, c in zip(ends, sum(bracket.values(), ()))]),
        "brackets",
    )

    if by:
        placed = src.select(*by, "_v").join(found.select(*by, *ends), by)
    else:
        # One row, or none: its bounds become literals.
        row = found.first()
        placed = src.select("_v").withColumns(
            {e: F.lit(row[e] if row else None).cast("double") for e in ends}
        )
    started = sum(((v >= F.col(f"_from_{q}")).cast("int") for q in bracket), F.lit(0))
    inside = reduce(or_, [(v >= F.col(f"_from_{q}")) & (v <= F.col(f"_to_{q}")) for q in bracket])
    # Rows of one cell that no bracket holds lie above those that one does.
    cells = placed.groupBy(*by, started.alias("_cell"), F.when(inside, v).alias("_x")).agg(
        F.count(F.lit(1)).alias("_m"), F.min(v).alias("_min"), F.max(v).alias("_max")
    )
    upto = (
        Window.partitionBy(*by)
        .orderBy("_cell", F.col("_x").asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = cells.withColumn("_to", F.sum("_m").over(upto))
    few = found.select(*by, "n", *more)
    ordered = ordered.join(few, by) if by else ordered.crossJoin(F.broadcast(few))

    def position(p: float) -> Column:
        return (n - 1) * F.lit(float(p))

    def pick(at: Column) -> Column:
        here = (at >= F.col("_to") - F.col("_m")) & (at < F.col("_to"))
        return F.max(F.when(here, F.col("_x")))

    picked = ordered.groupBy(*by).agg(
        F.any_value(n).alias("n"),
        *[F.any_value(name).alias(name) for name in more],
        *[pick(F.floor(position(p))).alias(f"_lo_{q}") for q, p in probs.items()],
        *[pick(F.ceil(position(p))).alias(f"_hi_{q}") for q, p in probs.items()],
    )
    missed = F.raise_error(F.lit("a sketch's bracket missed a quantile; run it again"))

    def between(q: str, p: float) -> Column:
        lo, hi = (F.coalesce(F.col(f"_{s}_{q}"), missed.cast("double")) for s in ("lo", "hi"))
        return lo + (hi - lo) * (position(p) - F.floor(position(p)))

    out = picked.select(*by, "n", *[between(q, p).alias(q) for q, p in probs.items()], *more)
    if not by:
        out = out.where("n IS NOT NULL")
    if not whiskers:
        return out
    low, high = _fences(F.col("q1"), F.col("q3"), F.col("q1"), F.col("q3"))
    fenced = ordered.select(*by, "_min", "_max").join(out, by)
    ends_of = fenced.groupBy(*by).agg(
        F.min(F.when(F.col("_min") >= low, F.col("_min"))).alias("whisker_lo"),
        F.max(F.when(F.col("_max") <= high, F.col("_max"))).alias("whisker_hi"),
    )
    return out.join(ends_of, by)
