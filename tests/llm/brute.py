"""Slow and plain versions of the operators, for small frames."""

from __future__ import annotations

import re
from collections import Counter

from cohortflow.llm.measures import MORE_MEASURES, measure, measure_more
from cohortflow.llm.quality_rules import RULES

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def words(text, lower=True):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in SPACE.split(text) if w]


def rejected(text):
    m = dict(zip("n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct_words n_upper n_lower n_digits n_exclaims n_pipes n_stops".split(), measure(text)))
    m |= zip(MORE_MEASURES, measure_more(text))
    return any(eval(r.sql, {}, m) for r in RULES)  # the rules are plain conditions in both languages


def lines(rows, min_lines=3, min_bytes=30):
    """{(doc_id, text): (n_lines, n_removed, n_runs, kept)} of rows with distinct ids, in order of the ids."""
    seen_lines, seen_runs, out = set(), set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[(doc, text)] = (0, 0, 0, None)
            continue
        parts = text.split("\n")
        gone = [False] * len(parts)
        for i, line in enumerate(parts):
            if line in seen_lines and len(line.encode()) >= min_bytes:
                gone[i] = True
            seen_lines.add(line)
            run = tuple(parts[i : i + min_lines])
            if len(run) == min_lines:
                if run in seen_runs:
                    gone[i : i + min_lines] = [True] * min_lines
                seen_runs.add(run)
        n_runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = "\n".join(p for p, g in zip(parts, gone) if not g)
        out[(doc, text)] = (len(parts), sum(gone), n_runs, kept)
    return out


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def groups(rows, k, percent):
    """Sorted rows (doc_id, n_shingles, component_id)."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for x, (a, s) in enumerate(sets):
        for b, t in sets[:x]:
            if a is not None and b is not None and s and t:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return Counter((d, len(s), None if d is None else find(d)) for d, s in sets)


def plain(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "").lower())


def score(a, b, match=2, mismatch=1, gap=1):
    """Best local alignment of two word lists."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y else -mismatch), row[j + 1] - gap, new[j] - gap))
        row = new
        best = max(best, *row)
    return best


def leaks(rows, items, threshold=0.6, seed=5):
    """{(doc_id, item_id): share} over whole texts."""
    out = {}
    for d, text in rows:
        w = words(plain(text), lower=False)
        runs = {tuple(w[i : i + seed]) for i in range(len(w) - seed + 1)}
        for i, item in items:
            v = words(plain(item), lower=False)
            if any(tuple(v[j : j + seed]) in runs for j in range(len(v) - seed + 1)):
                share = score(v, w) / (2 * len(v))
                if share >= threshold:
                    out[(d, i)] = share
    return out
