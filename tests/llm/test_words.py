"""Repeated substrings, spelling variants and ranked search: against brute force, and awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from taxograft.llm import lexical, repeats, spelling
from tests.llm.helpers import documents, lower


def plain_repeats(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for (doc_id, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def repeated_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + [f"é{i}ß" for i in range(50)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, rows = words(300), words(45), []
    for i in range(60):
        text = words(rng.randrange(1, 200))
        if i % 3 == 0:
            text += passage + words(rng.randrange(0, 50))
        if i % 5 == 0:
            edited = list(base)
            for _ in range(rng.randrange(0, 4)):
                edited[rng.randrange(len(edited))] = "#"
            text = "".join(edited)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 500), (104, "a" * 150), (None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(105, words(200) + "xyz" * 120 + words(20)), (106, "b" * 201), (107, "c" * 200), (108, ("q" * 77 + "r") * 9)]
    return [*rows, (109, words(30_000) + base + words(20_000) + passage)]


@pytest.mark.parametrize(("seed", "length"), [(1, 200), (2, 64)])
def test_repeats_equal_brute_force(spark, seed, length):
    rows = repeated_rows(seed)
    got = repeats.remove_repeats(documents(spark, rows), length).collect()
    assert sorted(map(tuple, got), key=str) == plain_repeats(rows, length)


def test_repeats_give_spans_and_bytes(spark):
    shared = "".join(random.Random(3).choice("abcdefgh ") for _ in range(260))
    rows = [(1, "before " + shared), (2, shared + "é after"), (3, None)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(documents(spark, rows), keep_bytes=True).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(7, 267)] and bytes(got[1]["kept"]) == b"before "
    assert [tuple(s) for s in got[2]["spans"]] == [(0, 260)] and bytes(got[2]["kept"]) == "é after".encode()
    assert got[3]["spans"] == [] and bytes(got[3]["kept"]) == b""
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(documents(spark, rows), 20)


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in close.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(close[w]), words[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    bases = ["aaaaaa", "abcabc", "Straße", "élèves", "ÉLÈVES", "letter", "mississippi"]
    rows = []
    for i in range(900):
        words = []
        for _ in range(rng.randrange(1, 12)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (kind > 0)] = rng.choice("abezéàÿ") if kind < 2 else ""
            words.append("".join(w))
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(None, "letter " * 2_000), (None, None), (7, ""), (7, "letter"), (7, "letter"), (9, "planet " * 300 + "planat " * 40 + "plonat " * 6), (8, "ab " * 60_000 + "x" * 3_000 + " " + "y" * 200_000)]
    got = spelling.spelling_variants(documents(spark, rows)).collect()
    want = plain_variants(plain_words(rows))
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want) > 30 and any(r[1] != r[2] and r[1] for r in want)
    assert spelling.spelling_variants(documents(spark, [])).count() == 0


def test_forms_are_followed_to_the_end(spark):
    chain = [("w%03d" % i, "w%03d" % (i + 1)) for i in range(20)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w020" for w, _ in chain}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_rank(docs, items, k):
    terms = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    have = [c for _, c in terms if c]
    n_docs, n_terms = len(have), sum(sum(c.values()) for c in have)
    out = []
    for item, text in items:
        found = []
        asked = set(TERM.findall(lower(text or "")))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for c in have) + 1))) for t in asked}
        for d, c in terms:
            if c:
                m = 10 + 90 * sum(c.values()) * n_docs // n_terms
                score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
                if score > 0:
                    found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if e[1] else e[2], -e[0]) for i, e in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 3_000}" for _ in range(4_000)] + ["Élan", "ÀB"]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, words(rng.choice([1, 3, 30, 200]))) for i in range(700)]
    docs += [(900 + i, docs[5][1]) for i in range(15)] + [(None, docs[5][1]), (None, None), (5, ""), (5, docs[5][1]), (5, docs[5][1]), (950, "--"), (951, words(60_000))]
    items = [(i, words(rng.choice([1, 8, 40]))) for i in range(25)] + [(30, docs[5][1]), (30, docs[5][1]), (31, None), (32, "nowhere"), (None, docs[9][1])]
    return docs, items


@pytest.mark.parametrize(("pass_terms", "block"), [(100_000, 1024), (200, 100)])
def test_ranking_equals_brute_force(spark, pass_terms, block):
    docs, items = ranked_rows(6)
    asked = spark.createDataFrame([(*r, None, "x") for r in items], "item_id long, text string, item long, h string")
    got = lexical.rank(documents(spark, docs), asked, 10, pass_terms, block).collect()
    assert sorted(map(tuple, got), key=str) == plain_rank(docs, items, 10)


def test_ranking_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.rank(documents(spark, [(1, "a")]), none).count() == 0
    assert lexical.rank(documents(spark, []), some).count() == 0
    assert lexical.rank(documents(spark, [(1, None), (2, "...")]), some).count() == 0
    assert lexical.rank(documents(spark, [(1, "c")]), some).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize(("common", "share"), [(0, 0.25), (40, 0.7)])
def test_subtrees_are_pruned_and_bounds_hold(common, share):
    """Groups of documents, alike or with many other terms: subtrees are passed over, nothing is lost."""
    rng = np.random.default_rng(8)
    dim, per = 320, 64
    rows = []
    for group in range(16):
        for _ in range(per):
            own = {group * 20 + t: 10**9 + int(rng.integers(0, 10**6)) for t in range(20) if not common or rng.random() < 0.8}
            rows.append({**{int(t): int(rng.integers(1, 10**8)) for t in rng.integers(0, dim, common)}, **own})
    sizes = np.array([len(r) for r in rows])
    terms = np.concatenate([sorted(r) for r in rows])
    values = np.concatenate([[r[t] for t in sorted(r)] for r in rows]).astype(np.int64)
    tree = lexical.Tree(lexical.Rows(list(range(len(rows))), sizes, terms, values), dim)
    asked = [np.arange(g * 20, g * 20 + 15) for g in range(16)]
    bounds = tree.bounds(asked)
    for node, leaf in tree.leaves.items():
        for i, q in enumerate(asked):
            mark = np.zeros(dim, dtype=bool)
            mark[q] = True
            assert bounds[i, node] >= leaf.exact(mark).max()
    best = [lexical.Best(10, 0) for _ in asked]
    scored = lexical.search_tree(tree, asked, best)
    assert scored < len(asked) * len(tree.leaves) * share
    for i, q in enumerate(asked):
        scores = sorted(((sum(r.get(t, 0) for t in q), -d) for d, r in enumerate(rows)), reverse=True)[:10]
        assert sorted(((s, d) for s, _, d in best[i].heap), reverse=True) == scores
