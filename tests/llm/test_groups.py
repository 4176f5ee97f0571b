"""Duplicates, leaks, mixing: against brute force, and awkward rows."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from taxograft.llm import decontaminate, exact_dup, mixing, near_dup
from taxograft.llm.common import components
from taxograft.llm.queries import QUERIES
from tests.llm.helpers import PLAIN, documents, near_components, shingle_set


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return words


def family_rows(seed, sizes):
    rng, rows = random.Random(seed), []
    for f, size in enumerate(sizes):
        base = [f"w{f}x{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(size):
            base_ = edited(rng, base, rng.choice([0, 0, 1, 2, 3, 5]))
            if rng.random() < 0.3:
                base = base_
            rows.append(" ".join(base_))
    rng.shuffle(rows)
    return [(100 + 3 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "t", "rows"), [(3, Fraction(17, 20), 5), (5, Fraction(4, 5), 4)])
def test_near_duplicates_equal_brute_force(spark, width, t, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 16)  # several blocks
    monkeypatch.setattr(near_dup, "COLUMNS", 64)
    data = family_rows(4, [1] * 20 + [2] * 10 + [7] * 6 + [90])
    data += [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "null id here"), (8, "null id here"), (None, "alone and nameless")]
    got = near_dup.near_duplicates(documents(spark, data), width, t, 26, rows).collect()
    comp, size = near_components(data, width, t.numerator, t.denominator)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((d, n, c if n else d) for (d, _), n, c in zip(data, size, comp, strict=True)), key=key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)
    assert [r["kept"] for r in got if r["doc_id"] is None and r["component_id"] is None] == [True]


def test_near_duplicates_of_the_given_table(spark, folder):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    comp, size = near_components(data, 3, 17, 20)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in QUERIES["op7_minhash_near_dedup"](spark, folder).collect()}
    assert got == {d: (n, c, d == c) for (d, _), n, c in zip(data, size, comp, strict=True)}


def test_near_duplicates_edges(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0
    rows = [(7, "a b c d e f g")] * 3 + [(9, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (None, None)]
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got) == {
        (7, 7, True): 3, (9, 7, False): 1, (None, 7, False): 1, (None, None, True): 2}


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(5)
    long = [f"l{rng.randrange(10**9)}" for _ in range(120_000)]
    rows = [(3, " ".join(long)), (2, " ".join(edited(rng, long, 4_000))), (1, " ".join(edited(rng, long, 9_000))), (0, " ".join(long[:90_000]))]
    got = near_dup.near_duplicates(documents(spark, rows)).collect()
    comp, size = near_components(rows, 5, 4, 5)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(
        (d, n, c) for (d, _), n, c in zip(rows, size, comp, strict=True))


def around(spark, rows):
    return spark.createDataFrame(rows, "pivot long, cid long, comp long, n long, sig array<long>")


def signature(rng):
    return [rng.getrandbits(64) - 2**63 for _ in range(4)]


def test_unlike_classes_of_a_bucket_send_no_sets(spark):
    rng = random.Random(6)
    rows = [(0, i, i, rng.randrange(50, 400), signature(rng)) for i in range(20_000)]
    assert near_dup.suspects(around(spark, rows), Fraction(4, 5), 128).count() == 0
    same = signature(rng)
    rows += [(0, 30_000, 30_000, 100, same), (0, 30_001, 30_001, 81, same), (0, 30_002, 30_002, 79, same), (0, 30_003, 30_000, 100, same)]
    got = near_dup.suspects(around(spark, rows), Fraction(4, 5), 128).select("cid").distinct().collect()
    # 79 is too small beside 100, but not beside 81
    assert {r["cid"] for r in got} == {30_000, 30_001, 30_002, 30_003}


@pytest.mark.parametrize("t", [Fraction(17, 20), Fraction(4, 5), Fraction(1)])
def test_every_pair_within_the_threshold_meets_in_one_tile(spark, t, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 7)
    rng = random.Random(7)
    sizes = [rng.choice([1, 4, 5, 16, 17, 20, 25, 80, 100, 125, 10**6, 10**6 * 5 // 4]) for _ in range(60)]
    same = signature(rng)
    rows = [(9, i, i, n, same) for i, n in enumerate(sizes)] + [(8, 70, 1, 5, same), (8, 71, 1, 5, same), (8, 72, 1, 5, same)]
    met = Counter()
    tiles = defaultdict(list)
    for r in near_dup.suspects(around(spark, rows), t, 128).collect():
        tiles[tuple(r[c] for c in near_dup.TILE)].append(r)
    for members in tiles.values():
        pairs = {frozenset((a["cid"], b["cid"])) for a in members if a["left"] for b in members if b["right"] and a["cid"] != b["cid"]}
        met.update(pairs)
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if t.denominator * min(sizes[i], sizes[j]) >= t.numerator * max(sizes[i], sizes[j])}
    assert want <= set(met) and set(met.values()) == {1}


def test_links_of_a_tile_equal_brute_force(monkeypatch):
    """Hashes above 2^63, vocabularies of many column pieces, links that share no piece border."""
    monkeypatch.setattr(near_dup, "COLUMNS", 50)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 1_500, dtype=np.uint64)
    sets = []
    for _ in range(12):
        base = rng.choice(pool, rng.integers(40, 400), replace=False)
        sets += [np.unique(np.concatenate([base[: len(base) - cut], rng.choice(pool, add)])) for cut, add in ((0, 0), (6, 2), (9, 0), (30, 5))]
    rows = pd.DataFrame({
        "left": [i % 2 == 0 for i in range(48)], "right": [i % 3 != 0 for i in range(48)], "cid": range(48), "comp": range(48),
        "n": [len(s) for s in sets], "items": [s.view(np.int64) for s in sets],
    })
    got = near_dup._links(Fraction(17, 20))(rows)
    linked = lambda i, j: 20 * len(np.intersect1d(sets[i], sets[j])) >= 17 * len(np.union1d(sets[i], sets[j]))
    want = {(i, j) for i in range(0, 48, 2) for j in range(48) if j % 3 and i != j and linked(i, j)}
    found = set(zip(got["a"], got["b"], strict=True))
    assert found and found <= want

    def least(pairs):
        up = list(range(48))
        for _ in range(48):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert least(found) == least(want)


def test_one_row_of_each_near_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words, x]) for x in "abc"]
    rows = [(7, t) for t in texts] + [(9, texts[0] + " d"), (7, "quite another text with the same id"), (7, ""), (None, "nameless")]
    left = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(d or 0 for d, _ in got) == [0, 7, 7, 7] and sum(t in texts for _, t in got) == 1
    assert {(7, "quite another text with the same id"), (7, ""), (None, "nameless")} <= set(got)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates_edges(spark):
    rows = [(5, "a b"), (3, "ab"), (4, " a  b "), (None, "a  b  "), (9, None), (8, " \t"), (None, "x"), (7, "y"), (7, "y"), (6, "A b"),
            (2, "z" * 300_000), (1, "z " * 300_000)]
    got = exact_dup.exact_duplicates(documents(spark, rows), runs=8, fan_in=2).collect()
    seen = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    assert seen == {
        (5, 4, 4, False): 1, (3, 4, 4, False): 1, (4, 4, 4, True): 1, (None, 4, 4, False): 1, (9, 8, 2, False): 1, (8, 8, 2, True): 1,
        (None, None, 1, True): 1, (7, 7, 2, True): 1, (7, 7, 2, False): 1, (6, 6, 1, True): 1, (2, 1, 2, False): 1, (1, 1, 2, True): 1,
    }
    assert exact_dup.exact_duplicates(documents(spark, [])).count() == 0


def items(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "item_id long, text string, row long")


def plain_leaks(docs, bench):
    out = []
    for d, t in docs:
        have = shingle_set(t, 5, PLAIN)
        for i, b in bench:
            q = shingle_set(b, 5, PLAIN)
            if q and 5 * len(q & have) >= 4 * len(q):
                out.append((d, i, len(q), len(q & have)))
    return Counter(out)


@pytest.mark.parametrize("sent", [decontaminate.SENT_BYTES, 0])
def test_leaks_equal_brute_force(spark, sent):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(50)}"
    bench = [(i, " ".join(word() for _ in range(rng.choice([5, 9, 14, 40, 60])))) for i in range(25)]
    bench += [(90, None), (91, ""), (92, "two words"), (None, bench[0][1]), (93, bench[0][1])]
    docs = []
    for i in range(120):
        words = [word() for _ in range(rng.choice([3, 50, 400]))]
        if i % 2:
            passage = edited(rng, bench[rng.randrange(25)][1].split(), rng.choice([0, 0, 1, 2]))
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((i, ("; " if i % 3 else " ").join(words).upper()))
    docs += [(500, "Two, words!"), (501, "just two words"), (None, bench[3][1]), (None, bench[3][1]), (502, None), (503, "u " * 90_000 + bench[4][1])]
    got = decontaminate.leaks(documents(spark, docs), items(spark, bench), sent=sent).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got) == plain_leaks(docs, bench)


def test_leaks_empty(spark):
    some = documents(spark, [(1, "a b c d e f")])
    assert decontaminate.leaks(some, items(spark, [])).count() == 0
    assert decontaminate.leaks(documents(spark, []), items(spark, [(1, "a b c d e f")])).count() == 0


def test_sketch_size_misses_nothing():
    for n in range(1, 300):
        assert decontaminate.sketch_size(n, Fraction(4, 5)) > n - -(-4 * n // 5)


def test_only_sketched_items_are_candidates(spark):
    """What many items share is not searched by, and no pair is made of it."""
    common = " ".join(f"c{i}" for i in range(14))
    bench = [(i, f"{common} " + " ".join(f"i{i}x{j}" for j in range(30))) for i in range(40)]
    docs = [(i, f"{common} " + " ".join(f"d{i}x{j}" for j in range(60))) for i in range(50)] + [(99, bench[7][1])]
    parts = decontaminate.item_shingles(items(spark, bench), 5, Fraction(4, 5))
    kept = decontaminate.sketches(parts)
    sizes = {r["item"]: (r["n"], r["count"]) for r in kept.groupBy("item", "n").count().collect()}
    assert set(sizes.values()) == {(40, decontaminate.sketch_size(40, Fraction(4, 5)))}
    hits = decontaminate.document_shingles(documents(spark, docs), 5)
    assert decontaminate.candidates(hits, kept, Fraction(4, 5)).count() == 1
    got = decontaminate.leaks(documents(spark, docs), items(spark, bench)).collect()
    assert [(r["doc_id"], r["item_id"], r["n_shared"]) for r in got] == [(99, 7, 40)]
    # without their sketches the items are not found
    nothing = decontaminate.candidates(hits, kept.where("item < 0"), Fraction(4, 5))
    assert nothing.count() == 0


def fluid(blocks, weights, t):
    """Targets at time ``t``: shares by weight, sources leave when they have their blocks."""
    have, left, now = [Fraction(0)] * len(blocks), set(range(len(blocks))), Fraction(0)
    w = [Fraction(x) for x in weights]
    while left and now < t:
        total = sum(w[s] for s in left)
        step = min([t - now] + [(blocks[s] - have[s]) * total / w[s] for s in left])
        for s in left:
            have[s] += step * w[s] / total
        now += step
        left = {s for s in left if have[s] < blocks[s]}
    return have


@pytest.mark.parametrize("seed", range(6))
def test_every_prefix_is_less_than_one_block_off(seed):
    rng = random.Random(seed)
    blocks = [rng.choice([1, 2, 9, 40]) for _ in range(rng.choice([1, 2, 7, 12]))]
    weights = [rng.choice([1.0, 0.5, 2**0.5, 0.001, 3.7]) for _ in blocks]
    dealt = [0] * len(blocks)
    for slot, s, i, release, deadline, _ in mixing.deal(blocks, weights):
        assert i == dealt[s] and release <= slot < deadline
        dealt[s] += 1
        assert all(abs(d - x) < 1 for d, x in zip(dealt, fluid(blocks, weights, slot + 1), strict=True))
    assert dealt == blocks


def test_many_slots_and_sources_without_drift():
    rng = random.Random(1)
    blocks = [rng.randrange(1, 40) for _ in range(5_000)]
    blocks[0] = 50_000
    weights = [n**0.5 * rng.choice([1.0, 3.14159, 1e-3]) for n in blocks]
    slots = 0
    for slot, _, _, release, deadline, _ in mixing.deal(blocks, weights):
        assert release <= slot < deadline  # the windows are those of the exact weights
        slots += 1
    assert slots == sum(blocks) > 100_000


def test_mixing_deals_every_row_once_and_on_time(spark):
    rng = random.Random(3)
    rows = [(i, "t", rng.choice(["big", "big", "big", "mid", "small", None])) for i in range(900)]
    rows += [(None, None, "mid")] * 7 + [(5, "t", "small")] * 4
    weights = {"big": 0.5, "mid": 0.3, "small": 0.15, None: 0.05}
    got = mixing.mix(documents(spark, rows), weights, block=8).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((d, s) for d, _, s in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r["slot"]].add((r["source"], r["block"]))
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(v) == 1 for v in by_slot.values())
    first = [next(iter(by_slot[s]))[0] for s in range(40)]  # all sources still have blocks
    total = sum(map(Fraction, weights.values()))
    for n in range(1, 41):
        c = Counter(first[:n])
        assert all(abs(c[k] - Fraction(w) * n / total) < 1 for k, w in weights.items())


def test_mixing_of_many_sources(spark):
    rows = [(i, "t", f"host{i % 2_500}" if i % 3 else "hot") for i in range(9_000)]
    got = mixing.mix(documents(spark, rows), block=4).collect()
    assert len({(r["slot"], r["place"]) for r in got}) == len(got) == 9_000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    n = Counter(s for _, _, s in rows)
    share = n["hot"] ** 0.5 / sum(x**0.5 for x in n.values())
    assert all(r["weight"] == pytest.approx(share) for r in got if r["source"] == "hot" and r["block"] == 0)


def test_mixing_edges(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(documents(spark, [(1, "a", "s")]), {"s": 0.0})
    one = mixing.mix(documents(spark, [(None, None, None)])).collect()
    assert [(r["doc_id"], r["source"], r["slot"]) for r in one] == [(None, None, 0)]
