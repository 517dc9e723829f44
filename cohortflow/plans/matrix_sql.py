"""Models with several covariates in SQL: matrices are lists, solved by sweeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def swept(matrix: str, m: int, p: int) -> str:
    """An m x m matrix, row by row in a list, swept on its first p pivots.

    What is left holds the inverse, the solution in the last column and the
    remainder in the last cell.
    """
    k, d = "CAST(y[1] AS BIGINT)", f"a[CAST(y[1] AS BIGINT) * {m + 1} + 1]"
    cell = f"""CASE WHEN e // {m} = {k} AND e % {m} = {k} THEN 1 / {d}
        WHEN e // {m} = {k} THEN a[e + 1] / {d}
        WHEN e % {m} = {k} THEN -a[e + 1] / {d}
        ELSE a[e + 1] - a[(e // {m}) * {m} + {k} + 1] * a[{k} * {m} + e % {m} + 1] / {d} END"""
    pivots = ", ".join(f"[{i}::DOUBLE]" for i in range(p))
    return f"list_reduce([{pivots}], lambda a, y: list_transform(range({m * m}), lambda e: {cell}), {matrix})"


def mixed_ctes(z: Mapping[str, str], frame: str) -> dict[str, str]:
    """Random-intercept model of y by maximum likelihood; ``z`` names the columns after the intercept.

    The variance ratio is found by bisection on the slope of the profile likelihood.
    """
    p = len(z) + 1
    m = p + 1
    columns = ", ".join(f"({c})::DOUBLE" for c in ["1", *z.values(), "y"])
    names = ", ".join(f"'{n}'" for n in ["Intercept", *z])

    def solved(source: str) -> str:
        minus = f"list_transform(range({m}), lambda i: CASE WHEN i < {p} THEN -s[i * {m} + {m}] ELSE 1 END)"
        change = f"list_sum(list_transform(range({m * m}), lambda e: d[e + 1] * v[e // {m} + 1] * v[e % {m} + 1]))"
        return f"""SELECT *, {change} AS change, s[{m * m}] AS rss FROM (SELECT *, {minus} AS v FROM (
            SELECT *, {swept("q", m, p)} AS s FROM (SELECT lo, hi, step, theta, list(q ORDER BY c) AS q,
                list(d ORDER BY c) AS d, sum(lv) AS logv, sum(dv) AS dlogv, sum(o) AS obs, sum(g) AS n_groups FROM (
                SELECT lo, hi, step, theta, c, sum(w - theta / (1 + size * theta) * b) AS q,
                    sum(-b / pow(1 + size * theta, 2)) AS d,
                    sum(CASE WHEN c = 0 THEN groups * ln(1 + size * theta) ELSE 0 END) AS lv,
                    sum(CASE WHEN c = 0 THEN groups * size / (1 + size * theta) ELSE 0 END) AS dv,
                    sum(CASE WHEN c = 0 THEN groups * size ELSE 0 END) AS o,
                    sum(CASE WHEN c = 0 THEN groups ELSE 0 END) AS g
                FROM (SELECT *, (lo + hi) / 2 / (1 - (lo + hi) / 2) AS theta FROM {source}), cells GROUP BY ALL)
            GROUP BY lo, hi, step, theta)))"""

    return {
        "zrows": f"SELECT patient_id, [{columns}] AS z FROM {frame}",
        "cells": f"""SELECT size, c, count(*)::DOUBLE AS groups, sum(w) AS w, sum(a * b) AS b FROM (
            SELECT patient_id, c, count(*)::DOUBLE AS size, sum(z[c // {m} + 1] * z[c % {m} + 1]) AS w,
            sum(z[c // {m} + 1]) AS a, sum(z[c % {m} + 1]) AS b FROM zrows, range({m * m}) t(c) GROUP BY 1, 2)
            GROUP BY 1, 2""",
        "search": f"""SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step
            UNION ALL SELECT CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END,
            step + 1 FROM (SELECT *, -change * obs / rss - dlogv > 0 AS up
                FROM ({solved("(SELECT * FROM search WHERE step < 60)")}))""",
        "fitted": f"""SELECT *, {p} AS p, scale * theta AS group_var,
            -0.5 * (obs * ln(2 * pi() * scale) + logv + obs) AS loglik
            FROM (SELECT *, rss / obs AS scale FROM ({solved("(SELECT * FROM search WHERE step = 60)")}))""",
        # Second derivatives by the variance ratio, and the observed information of ratio and scale.
        "curved": f"""SELECT list(e2 ORDER BY c) AS e2, sum(CASE WHEN c = 0 THEN lv2 END) AS lv2 FROM (
            SELECT c, sum(2 * size * b / pow(1 + size * theta, 3)) AS e2,
            sum(-groups * size * size / pow(1 + size * theta, 2)) AS lv2 FROM cells, fitted GROUP BY c)""",
        "pulls": f"""SELECT *, list_transform(range({p}), lambda i:
            list_sum(list_transform(range({m}), lambda j: d[i * {m} + j + 1] * v[j + 1]))) AS pull
            FROM fitted, curved""",
        "informed": f"""SELECT *, 0.5 * (lv2 + r2 / scale) AS i11, -0.5 * change / pow(scale, 2) AS i12,
            0.5 * obs / pow(scale, 2) AS i22 FROM (SELECT *,
            list_sum(list_transform(range({m * m}), lambda e: e2[e + 1] * v[e // {m} + 1] * v[e % {m} + 1]))
            - 2 * list_sum(list_transform(range({p * p}), lambda e:
                pull[e // {p} + 1] * s[(e // {p}) * {m} + e % {p} + 1] * pull[e % {p} + 1])) AS r2 FROM pulls)""",
        "tested": f"""SELECT *, coef / se AS z FROM (SELECT [{names}][i + 1] AS term, s[i * {m} + {m}] AS coef,
            sqrt(scale * s[i * {m} + i + 1]) AS se FROM fitted, range({p}) t(i))""",
    }


def cox_ctes(x: Sequence[str], frame: str) -> dict[str, str]:
    """Proportional hazards with Efron ties: Newton steps, one row per event and tie."""
    p = len(x)
    m = p + 1
    columns = ", ".join(f"({c})::DOUBLE" for c in ["1", *x])
    dot = f"list_sum(list_transform(range({p}), lambda i: beta[i + 1] * x[i + 2]))"
    both = f"x[c // {m} + 1] * x[c % {m} + 1]"
    z = f"list_transform(range({m * m}), lambda e: risk[e + 1] - l / d * tied[e + 1])"
    # The information with the gradient of the log of the risk sums as last column.
    cell = f"""list_transform(range({m * m}), lambda e:
        CASE WHEN e // {m} < {p} AND e % {m} < {p}
            THEN z[(e // {m} + 1) * {m} + e % {m} + 2] / z[1] - z[e // {m} + 2] * z[e % {m} + 2] / (z[1] * z[1])
        WHEN e // {m} < {p} THEN -z[e // {m} + 2] / z[1] ELSE 0 END)"""

    def summed(source: str) -> str:
        return f"""SELECT step, beta, list(v ORDER BY c) AS a, sum(CASE WHEN c = 0 THEN logs END) AS logs FROM (
            SELECT step, beta, c, sum(k[c + 1]) + any_value(CASE WHEN c // {m} < {p} AND c % {m} = {p}
                THEN own[c // {m} + 2] ELSE 0 END) AS v, sum(-ln(z[1])) AS logs
            FROM (SELECT *, {cell} AS k FROM (SELECT *, {z} AS z FROM (
                SELECT *, unnest(range(CAST(d AS BIGINT)))::DOUBLE AS l FROM (
                    SELECT step, beta, t, d, list(risk ORDER BY c) AS risk, list(tied ORDER BY c) AS tied FROM (
                        SELECT step, beta, deaths.t, d, c, sum(exp({dot}) * {both}) AS risk,
                        sum(CASE WHEN subjects.t = deaths.t AND e = 1 THEN exp({dot}) * {both} ELSE 0 END) AS tied
                        FROM {source}, deaths, subjects, range({m * m}) r(c) WHERE subjects.t >= deaths.t
                        GROUP BY ALL) GROUP BY step, beta, t, d)))), range({m * m}) r(c), dead GROUP BY step, beta, c)
            GROUP BY step, beta"""

    zero = ", ".join(["0.0::DOUBLE"] * p)
    moved = f"list_transform(range({p}), lambda i: beta[i + 1] + s[i * {m} + {m}])"
    names = ", ".join(f"'{c}'" for c in x)
    return {
        "subjects": f"SELECT T AS t, E AS e, [{columns}] AS x FROM {frame}",
        "deaths": "SELECT t, count(*)::DOUBLE AS d FROM subjects WHERE e = 1 GROUP BY 1",
        "dead": f"""SELECT list(v ORDER BY i) AS own FROM (SELECT i, sum(x[i + 1]) AS v FROM subjects, range({m}) r(i)
            WHERE e = 1 GROUP BY 1)""",
        "newton": f"""SELECT 0 AS step, [{zero}] AS beta UNION ALL SELECT step + 1, {moved}
            FROM (SELECT *, {swept("a", m, p)} AS s FROM ({summed("(SELECT * FROM newton WHERE step < 20)")}))""",
        "null_model": summed("(SELECT * FROM newton WHERE step = 0)"),
        "cox": f"SELECT *, {swept('a', m, p)} AS s FROM ({summed('(SELECT * FROM newton WHERE step = 20)')})",
        "tested": f"""SELECT *, coef / se AS z FROM (SELECT [{names}][i + 1] AS term, beta[i + 1] AS coef,
            sqrt(s[i * {m} + i + 1]) AS se,
            logs + list_sum(list_transform(range({p}), lambda j: beta[j + 1] * own[j + 2])) AS loglik
            FROM cox, dead, range({p}) r(i))""",
    }
