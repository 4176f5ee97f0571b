"""Awkward rows and plain reference code for the operators of the subpackage."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, uid long, mark string, h string, n string, key string"
CLASH = (None, None, "x", "y", "z", "w")


def documents(spark, rows):
    """``rows``: (doc_id, text[, source]); the further columns clash with names used inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, *CLASH) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def shingle_set(text, width, pattern):
    words = re.findall(pattern, lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def near_components(rows, width, num, den):
    """{row number: smallest doc_id reachable} by comparing all pairs."""
    sets = [shingle_set(t, width, SPACED) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(rows))], [len(s) for s in sets]
