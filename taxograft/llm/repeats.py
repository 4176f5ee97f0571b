"""Repeated substrings of a corpus by distributed prefix doubling.

Two positions whose next ``length`` bytes are equal have equal ranks at every shorter length
too, so positions are ranked (their strings named and sorted by Spark) at growing lengths, and a
position leaves as soon as its rank is unique or its string is past ``length``:

1. at ``length / 4`` bytes.  Only sampled positions are ranked: of all the strings of this length
   inside a string of ``length`` bytes, the one with the smallest hash (the leftmost of equal
   ones).  Equal strings sample equal positions, so a start whose sample has a unique rank is
   unique.  The starts that share a sample are one run, and the rank pair (sample, whole stretch
   of the run) settles runs whose stretch occurs again with all their starts.
2. Of the runs whose sample is repeated but whose stretches differ, one of each kind goes on, cut
   into cells of ``CELL`` starts: the rank pair is (what all strings of the cell share, the
   stretch of the cell), 15 bytes below and above ``length``.
3. Cells that are still open go on start by start with ranks at ``length`` itself.

Every level keeps only a count of a rank, aggregated before the shuffle, so a passage that stands
in a third of all documents is one key with a large count and no group is ever collected.  Ranks
are named by 64-bit fingerprints; two strings are taken as equal when two of them (sample and
stretch) agree.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograft.llm import kernels as K
from taxograft.plans.lineage import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
#: Neighbouring starts that are settled together.
CELL = 16
#: Starts handled at once; positions inside a piece fit the low 16 bits of a packed minimum.
PIECE = 1 << 15

_U = np.uint64
_VALUE = np.random.default_rng(20_261_201).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Prints:
    """Fingerprints of any stretch of a byte array, case and white space included."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[raw] * K._power("up", n)[:n], out=self.sums[1:])
        self.down = K._power("down", n + 1)

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        mixed = K.mix((self.sums[end] - self.sums[start]) * self.down[start])
        return mixed ^ K.mix(np.asarray(salt).astype(np.uint64) + _U(1))

    def all(self, size: int) -> np.ndarray:
        """Fingerprints of all strings of ``size`` bytes."""
        n = len(self.sums) - size
        return K.mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def runs(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts that share a sample: (sample, stretch, position, before, after) each.

    The starts of a run are ``position - before`` to ``position - after``; strings never cross
    the border of a text.
    """
    size = length // 4
    window = length - size + 1
    border = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(border, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(border, offsets[1:], -1)
    inside = np.cumsum(border)[: len(raw)] == 0
    out = []
    for p in range(0, max(len(raw) - length + 1, 0), PIECE):
        prints = Prints(raw[p : p + PIECE + length - 1])
        ranks = prints.all(size)
        least = (ranks & ~_U(0xFFFF)) | np.arange(len(ranks), dtype=np.uint64)
        step = 1
        while 2 * step <= window:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < window:
            least = np.minimum(least[: step - window], least[window - step :])
        at = (least & _U(0xFFFF)).astype(np.int64)
        good = inside[p : p + len(at)]
        same = (at[1:] == at[:-1]) & good[1:] & good[:-1]
        first, last = good.copy(), good.copy()
        first[1:] &= ~same
        last[:-1] &= ~same
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        x = at[a]
        out.append((ranks[x], prints.of(a, b + length, (x - a) * length + (x - b)), x + p, x - a, x - b))
    if not out:
        return (*[np.zeros(0, dtype=np.uint64)] * 2, *[np.zeros(0, dtype=np.int64)] * 3)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _pack(a, b, c):
    """Three numbers in one long, as rows of single starts are many: 31, 16 and 16 bits."""
    return (a << 32) | (b << 16) | c


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 32, (packed >> 16) & 0xFFFF, packed & 0xFFFF


def sampled_runs(texts: DataFrame, length: int) -> DataFrame:
    """``(mark, size, g, f, place)`` of all runs of ``texts(mark, size, text)``; ``place`` packs the
    position of the sample and the distances of the farthest and the nearest start."""

    def run(batches):
        for batch in batches:
            for at, _, raw, offsets in K.chunks(batch.column(2)):
                g, f, x, before, after = runs(raw, offsets, length)
                text = np.searchsorted(offsets, x, side="right") - 1
                pick = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), _long(g), _long(f),
                     _long(_pack(x - offsets[text], before, after))],
                    names=["mark", "size", "g", "f", "place"],
                )

    long_enough = texts.where(F.col("size") >= length).select("mark", "size", "text")
    return long_enough.mapInArrow(run, "mark long, size int, g long, f long, place long")


def settle(rows: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One ranking round over ``rows(*group, f, ...)``: rows of a unique group leave.

    Returns the rows whose own rank ``f`` occurs again, and for groups with several ranks one row
    of each rank, with ``again``.  Counts and extremes are aggregated before they are shuffled; the
    rows of a hot key are split by the adaptive join, which has one row a key on its other side.
    """
    group = list(group)
    rest = [c for c in rows.columns if c not in {*group, "f"}]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("f").alias("_lo"), F.max("f").alias("_hi"))
    groups = groups.where("_n > 1").select(*group, (F.col("_lo") != F.col("_hi")).alias("open"))
    met = cut_lineage(rows.join(groups, group))
    mixed = met.where("open").drop("open")
    ranks = mixed.groupBy(*group, "f").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct(*rest)).alias("_r"))
    again = mixed.join(ranks.where("_c > 1").select(*group, "f"), [*group, "f"], "left_semi")
    repeated = met.where("NOT open").drop("open").unionByName(again)
    return repeated, ranks.select(*group, "f", "_r.*", (F.col("_c") > 1).alias("again"))


def distinct_texts(texts: DataFrame, length: int) -> DataFrame:
    """``(mark, size, zipped)``: every different text of ``length`` bytes or more once, compressed
    before it is moved."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            small = [codec.compress(t.encode(), asbytes=True) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(small, pa.binary())], names=["mark", "size", "zipped"]
            )

    rows = texts.where(F.col("size") >= length).select("mark", "size", "text")
    return rows.mapInArrow(run, "mark long, size int, zipped binary").dropDuplicates(["mark", "size"])


def stretches(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of runs: ``wanted(mark, size, g, place, done)`` with ``stretch``."""
    lists = wanted.groupBy("mark", "size").agg(F.collect_list(F.struct("g", "place", "done")).alias("runs"))

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            out = {c: [] for c in schema.names}
            for mark, size, zipped, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = codec.decompress(zipped, decompressed_size=size, asbytes=True)
                for r in found:
                    x, before, after = _unpack(r["place"])
                    values = mark, size, r["g"], r["place"], r["done"], raw[x - before : x - after + length]
                    for name, value in zip(schema.names, values, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([
        ("mark", pa.int64()), ("size", pa.int32()), ("g", pa.int64()), ("place", pa.int64()), ("done", pa.bool_()),
        ("stretch", pa.binary()),
    ])
    met = texts.join(lists, ["mark", "size"]).select("mark", "size", "zipped", "runs")
    return met.mapInArrow(run, "mark long, size int, g long, place long, done boolean, stretch binary")


def cells(found: DataFrame, length: int, cell: int) -> DataFrame:
    """Cells of ``cell`` starts: ``(mark, size, g, place, part, core, f)``.

    ``found(mark, size, g, place, stretch, parts)`` has the starts to be cut in ``parts``, packed ranges of
    distances from the sample.  Cells are counted by this distance; ``core`` names what all
    strings of the cell share, ``f`` the stretch of those of its starts that are in ``part``.
    """

    def run(batches):
        for batch in batches:
            _, before, after = _unpack(batch.column(3).to_numpy())
            sizes = before - after + length
            starts = np.cumsum(sizes) - sizes
            prints = Prints(np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.uint8))
            parts = batch.column(5)
            owner = parts.value_parent_indices().to_numpy().astype(np.int64)
            least, most, done = _unpack(parts.flatten().to_numpy())
            n = most // cell - least // cell + 1
            part = np.repeat(np.arange(len(n)), n)
            q = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + (least // cell)[part]
            low, high = np.maximum(least[part], cell * q), np.minimum(most[part], cell * q + cell - 1)
            row = owner[part]
            base = starts[row] + before[row]
            core = base - cell * q  # the nearest start of the whole cell
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pick) for i in range(4)), _long(_pack(low, high, done[part])),
                 _long(prints.of(core, core - cell + 1 + length, q)),
                 _long(prints.of(base - high, base - low + length, low * length + high))],
                names=["mark", "size", "g", "place", "part", "core", "f"],
            )

    shape = "mark long, size int, g long, place long, part long, core long, f long"
    return found.select("mark", "size", "g", "place", "stretch", "parts").mapInArrow(run, shape)


def _bits(column: str, at: int):
    return F.shiftright(column, 16 * at).bitwiseAND(F.lit(0xFFFF)) if at < 2 else F.shiftright(column, 32)


def find_repeats(rows: DataFrame, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans ``(mark, size, start, end)`` of bytes covered by strings that occur more than once.

    ``rows(mark, size, text)``: hash, bytes and text of every row; ``texts`` the different ones.
    Equal texts are rows of their own, so what they hold is repeated, and give their spans once.
    """

    def spans(found: DataFrame, far, near) -> DataFrame:
        x = _bits("place", 2)
        return found.select("mark", "size", (x - far).cast("int").alias("start"), (x - near + length).cast("int").alias("end"))

    def part(far, near, done):
        return _pack_columns(near, far, done.cast("long"))

    key = ["mark", "size", "place"]
    whole, kinds = settle(sampled_runs(rows, length), ["g"])
    going_on = kinds.select(*key, "g", F.col("again").alias("done"))
    found = cut_lineage(stretches(texts, going_on, length))
    all_starts = F.array(part(_bits("place", 1), _bits("place", 0), F.col("done")))
    halves, kinds = settle(cells(found.withColumn("parts", all_starts), length, CELL), ["g", "core"])
    # what occurs again is settled, but may be the partner of a cell that does not
    settled = F.col("again") | (_bits("part", 0) > 0)
    parts = kinds.groupBy(*key).agg(F.collect_list(part(_bits("part", 1), _bits("part", 2), settled)).alias("parts"))
    singles, _ = settle(cells(found.join(parts, key), length, 1), ["g", "core"])
    by_part = [spans(r.where(_bits("part", 0) == 0), _bits("part", 1), _bits("part", 2)) for r in (halves, singles)]
    return spans(whole, _bits("place", 1), _bits("place", 0)).unionByName(by_part[0]).unionByName(by_part[1]).distinct()


def _pack_columns(a, b, c):
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(F.shiftleft(b.cast("long"), 16)).bitwiseOR(c.cast("long"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """One row ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row of ``docs``.

    A byte of the UTF-8 text goes when a string of ``length`` bytes that covers it also starts
    anywhere else, in another row or in the same one; overlapping strings count, and all is
    judged on the input.  With ``keep_bytes``, ``spans`` (the maximal runs removed) and ``kept``
    (the bytes left, which need not be UTF-8) follow.

    A null text is an empty one; it and texts shorter than ``length`` keep all they have.  Rows
    with null or repeated ids are rows like others: two rows with the same text lose all of it
    if it has ``length`` bytes.  A very long text is sampled in pieces but judged whole; a table
    without rows gives none.  Ties do not arise; other columns are ignored.
    """
    if not 4 * CELL <= length < 1 << 15:
        raise ValueError(f"repeats of {length} bytes cannot be sampled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "size": F.octet_length("text")})
    texts = distinct_texts(rows, length)
    lists = find_repeats(rows, texts, length).groupBy("mark", "size").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            out = []
            for mark, size, zipped, found in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw, kept, removed, at = codec.decompress(zipped, decompressed_size=size, asbytes=True), [], [], 0
                for span in sorted(found, key=lambda s: (s["start"], s["end"])):
                    if removed and span["start"] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], span["end"])
                    else:
                        removed.append([span["start"], span["end"]])
                for start, end in removed:
                    kept.append(raw[at:start])
                    at = end
                left = b"".join([*kept, raw[at:]])
                row = {"mark": mark, "size": size, "n_removed": size - len(left), "n_spans": len(removed), "sha": hashlib.sha256(left).hexdigest()}
                more = {"spans": [{"start": a, "end": b} for a, b in removed], "kept": left} if keep_bytes else {}
                out.append({**row, **more})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    fields = [("mark", pa.int64()), ("size", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string())]
    shape = "mark long, size int, n_removed long, n_spans long, sha string"
    own = ["doc_id", "mark", "size", F.sha2("text", 256).alias("_sha")]
    none = F.lit(0).cast("long")
    shown = [
        "doc_id", F.col("size").cast("long").alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha", "_sha").alias("kept_sha256"),
    ]
    if keep_bytes:
        fields += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
        shape += ", spans array<struct<start: long, end: long>>, kept binary"
        own.append(F.encode("text", "UTF-8").alias("_all"))
        shown += [F.coalesce("spans", F.expr("cast(array() AS array<struct<start: long, end: long>>)")).alias("spans"), F.coalesce("kept", "_all").alias("kept")]
    schema = pa.schema(fields)
    cut = texts.join(lists, ["mark", "size"]).select("mark", "size", "zipped", "spans").mapInArrow(run, shape)
    return rows.select(*own).join(cut, ["mark", "size"], "left").select(*shown)


#: Every string of 200 bytes counted, texts cut into overlapping pieces first.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, pos, substr(x, 2 * pos + 1, 798) AS piece FROM (SELECT r, x, unnest(range(0, length(x) // 2, 200)) AS pos FROM d)),
w AS (SELECT r, pos + i AS pos, md5_number(substr(piece, 2 * i + 1, 400)) AS k
  FROM (SELECT r, pos, piece, unnest(range(least(200, length(piece) // 2 - 199))) AS i FROM p)),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN c USING (k)),
g AS (SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS no FROM m),
s AS (SELECT r, no, min(pos) AS a, max(pos) + 200 AS b FROM g GROUP BY r, no),
k AS (SELECT r, no, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
e AS (SELECT k.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS b, sum(b - a) AS gone, count(*) AS n
  FROM k JOIN d USING (r) GROUP BY k.r)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN e USING (r)
"""
