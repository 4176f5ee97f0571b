"""Kernels and single-text operators against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxograft.llm import kernels as K
from taxograft.llm import licenses, pii
from tests.llm.helpers import PLAIN, SPACED, documents, lower, shingle_set

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB cé\t.1😀-", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from([(SPACED, K.NON_SPACE), (PLAIN, K.ALNUM)]), st.integers(1, 4), st.integers(1, 64))
def test_words_and_shingles(texts, kind, width, size):
    pattern, table = kind
    seen, counts, sets = {}, [], []
    for _, _, raw, offsets in K.chunks(pa.array(texts, pa.string()), size):
        words = K.Words(raw, offsets, table)
        counts += words.per_text.tolist()
        values, offs = K.distinct(*K.shingles(words, width), words.n_texts)
        sets += [frozenset(values[offs[i] : offs[i + 1]].tolist()) for i in range(words.n_texts)]
    assert counts == [len(re.findall(pattern, lower(t or ""))) for t in texts]
    for text, got in zip(texts, sets, strict=True):
        want = shingle_set(text, width, pattern)
        assert len(got) == len(want)

        assert seen.setdefault(want, got) == got
    assert len(set(seen.values())) == len(seen)


def test_a_word_longer_than_a_piece():
    long = "x" * (K.PIECE * 2 + 5)
    hashes = []
    for text in (f"{long} tail", f"a {long}", f"{long}y"):
        (_, _, raw, offsets), = K.chunks(pa.array([text]))
        hashes.append(K.Words(raw, offsets, K.ALNUM).hashes)
    assert hashes[0][0] == hashes[1][1] != hashes[2][0]


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.sort(base[:800]), np.sort(base[100:])
    low = K.minima(np.concatenate([a, b]), np.array([0, 800, 1600]), 512)
    assert abs((low[0] == low[1]).mean() - 700 / 900) < 0.08


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(
    ["a@b.c", "x.y%z@mail-1.example.com", "@", "a", ".", "-", "+", " ", "é", "10.0.0.1", "999.1.1.1", "007.0.0.255", "4111 1111 1111 1111",
     "4111-1111-1111-111", "+49 (30) 1234567", "+1", "1", "23", "(", "_", "%", "\n", "b.co"]
), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs_are_linear():
    for text in ("a" * 2_000_000 + "@", "1" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a@" * 500_000):
        pii.base_spans(text)


def test_terms_that_reveal_an_entity(spark):
    filler = ["the plain words of page number %d say little" % i for i in range(60)]
    rows = [(i, f"{filler[i]}\nask zorblax about bob@example.com the plain way") for i in range(4)]
    rows += [(i, filler[i]) for i in range(4, 60)]
    found = {r["doc_id"]: r["spans"] for r in pii.report(documents(spark, rows)).collect()}
    for i in range(4):

        named = [s.split(":") for s in found[i].split(",")]
        words = {rows[i][1][int(b) : int(e)] for k, b, e in named if k == "term"}
        assert "zorblax" in words and "plain" not in words and "the" not in words
        assert [rows[i][1][int(b) : int(e)] for k, b, e in named if k == "email"] == ["bob@example.com"]
    assert all(found[i] == "" for i in range(4, 60))
    clean = {r["doc_id"]: r["clean_text"] for r in pii.sanitise(documents(spark, rows)).collect()}
    assert "zorblax" not in clean[0] and "<email>" in clean[0] and "plain words" in clean[0] and " the plain" in clean[0]
    assert clean[30] == filler[30]


@pytest.mark.parametrize("sent", [pii.SENT_TERMS, 0])
def test_revealing_terms_are_marked_in_all_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(pii, "SENT_TERMS", sent)
    filler = ["the plain words of page number %d say little" % i for i in range(400)]
    rows = [(i, f"Zorblax wrote bob@example.com the {filler[i]} {filler[i]} once more zorblax and zorblax@example.com") for i in range(2)]
    rows += [(2, f"{filler[2]} said ZORBLAX alone"), (None, "zorblax"), (None, "zorblax"), (3, None)]
    rows += [(i, filler[i]) for i in range(4, 400)]
    got = pii.report(documents(spark, rows)).where("n_term > 0").collect()
    texts = {(r[0], r[1]) for r in rows}
    marked = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0,
         [t[int(b) : int(e)] for k, b, e in (s.split(":") for s in r["spans"].split(",")) if k == "term" and t[int(b) : int(e)].lower() == "zorblax"])
        for r in got for d, t in texts if d == r["doc_id"]
    )
    assert marked == [
        (False, 0, ["Zorblax", "zorblax"]), (False, 1, ["Zorblax", "zorblax"]), (False, 2, ["ZORBLAX"]),
        (True, 0, ["zorblax"]), (True, 0, ["zorblax"]),
    ]
    clean = pii.sanitise(documents(spark, rows)).collect()
    assert len(clean) == len(rows) and not any("zorblax" in r["clean_text"].lower() for r in clean)
    assert {r["doc_id"]: r["clean_text"] for r in clean}[2] == f"{filler[2]} said XXXXXXX alone"


def test_the_window_holds_its_words_however_far_apart():
    gap = " _ - a " * 60
    listed = [f"word{i}" for i in range(20)]
    text = gap.join([*listed[:10], "bob@example.com", *listed[10:]])
    near = pii.near_terms(text, pii.base_spans(text), 8)
    assert [t for _, t, _, _ in near] == listed[2:18] and all(text[b:e] == t for _, t, b, e in near)
    many = "1.2.3.4 " * 50_000  # as many spans without a word between them
    assert pii.near_terms(many, pii.base_spans(many), 8) == []
    many = "left " + " ".join(["10.0.0.100"] * 500) + " right"  # a later word is found across other spans
    assert {t for _, t, _, _ in pii.near_terms(many, pii.base_spans(many), 8)} == {"left", "right"}


def test_pii_edges(spark):
    rows = [(1, None), (1, ""), (None, "me@x.org"), (None, "me@x.org"), (2, "é😀 +49 30 1234567 " + "w " * 50_000), (2, "me@x.org")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_email"], r["n_phone"], r["spans"]) for r in pii.report(documents(spark, rows)).collect())
    assert got == sorted([
        (False, 1, 0, 0, ""), (False, 1, 0, 0, ""), (True, 0, 1, 0, "email:0:8"), (True, 0, 1, 0, "email:0:8"),
        (False, 2, 0, 1, "phone:3:17"), (False, 2, 1, 0, "email:0:8"),
    ])
    assert pii.report(documents(spark, [])).count() == 0
    digest = {r["base_sha256"] for r in pii.report(documents(spark, [(1, None)])).collect()}
    assert digest == {hashlib.sha256(b"").hexdigest()}


def plain_licenses(text):
    words = re.findall(PLAIN, lower(text or ""))
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_against_plain_code(spark, folder):
    rng = random.Random(5)
    bits = ["CC", "by", "cc", "BY-NC", "4.0", "general", "Public", "LICENSE", "all", "rights", "reserved", "é", "...", "\n", "apache", "2", "mit"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1001, "!!"), (None, "CC BY"), (1002, "x " * 70_000 + "All rights reserved. " * 3_000)]
    rows += [(2000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = sorted(
        ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
         for r in licenses.scan_licenses(documents(spark, rows)).collect()), key=key)
    assert got == sorted(((d, *plain_licenses(t)) for d, t in rows), key=key)


def test_license_rules_and_suppression(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0",
        "GNU General Public License version 2 or any later version": "gpl,gpl-2.0+",
        "the MIT License": "mit",
        "nothing of the kind": "",
    }
    rows = list(enumerate(cases))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert {rows[i][1]: got[i][0] for i in got} == cases
    assert got[5][1] == 0.0 and all(0 < got[i][1] <= 1 for i in range(5))
    table = [licenses.Rule("b", "a b c", "long", 1), licenses.Rule("b", "b", "short", 1), licenses.Rule("b", "b c", "better", 0)]
    _, found = licenses.detections(documents(spark, [(1, "a b c b")]), table)
    kept = {(r["start"], table[r["rule"]].label) for r in licenses.survivors(found, table).where("NOT suppressed").collect()}
    assert kept == {(0, "long"), (1, "better"), (3, "short")}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0
    assert len(licenses.rules()) > 300


@pytest.mark.parametrize("word", ["permission", "spdx", "apache"])
def test_every_rule_needs_its_keyword(word):
    for rule in licenses.rules():
        literal = re.sub(r"\(\?:[^()]*\)\??|\[[^]]*\]\S*", " ", rule.pattern)
        assert rule.keyword in rule.pattern or rule.keyword in literal


def alternatives(pattern):
    """Texts that a pattern accepts: every branch, option and listed letter, of a range its first one."""
    sre = re._parser

    def expand(nodes):
        out = [""]
        for op, arg in nodes:
            if op is sre.LITERAL:
                more = [chr(arg)]
            elif op is sre.IN:
                more = [chr(x) if o is sre.LITERAL else chr(x[0]) for o, x in arg]
            elif op is sre.BRANCH:
                more = [t for branch in arg[1] for t in expand(branch)]
            elif op is sre.SUBPATTERN:
                more = expand(arg[-1])
            else:
                assert op in (sre.MAX_REPEAT, sre.MIN_REPEAT), op
                low, high, sub = arg
                inner = expand(sub)
                more = ["", *inner] if (low, high) == (0, 1) else [inner[0] * low, inner[0] * min(low + 1, int(high))]
            out = [a + b for a in out for b in dict.fromkeys(more)]
        return out

    return [t for t in expand(sre.parse(pattern)) if "+" not in t]  # never in the words of a text


def test_every_alternative_of_every_rule_is_found(spark):
    table, rows = licenses.rules(), []
    for i, rule in enumerate(table):
        texts = alternatives(rule.pattern)
        # Creative Commons has thousands of combinations for each rule, all with its keyword
        rows += [(i, t) for t in (texts[:: len(texts) // 20 + 1] if "creative" in rule.keyword else texts)]
        assert all(set(t.split()) & {rule.keyword, *rule.also} for t in texts), rule
    docs, found = licenses.detections(documents(spark, rows), table)
    hit = docs.join(found, "row").where("doc_id = rule").select("row").distinct().count()
    assert hit == len(rows) > 3_000


def test_licenses_without_the_first_keyword(spark):
    cases = {
        "the Expat License": "mit", "an X11 licence": "mit", "Open RAIL License": "openrail", "responsible rail licence": "openrail",
        "This work is copyrighted.": "copyright", "GPLv3 or later": "gpl-3.0+", "LGPL2 or later": "lgpl-2.0+",
        "It may not be copied in any form without the prior written permission": "reserved",
        "must not be distributed without consent": "reserved", "may not be republished without permission": "reserved",
    }
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(documents(spark, list(enumerate(cases)))).collect()}
    assert [got[i][0] for i in range(len(cases))] == list(cases.values()) and all(score > 0 for _, score in got.values())
