"""Personal data: pattern spans, and terms that reveal them by what the corpus says.

The protected entities are the values the patterns find (an address, a number).  A term that
stands near an entity discloses it to the degree of their pointwise mutual information over
the documents of the corpus, relative to the entity's own information content:

    disclosure = log2(n_et * N / (n_e * n_t)) / log2(N / n_e)        (1: the term implies it)

with ``N`` documents, ``n_e`` of them with the entity, ``n_t`` with the term, ``n_et`` with the
term near the entity.  Terms at or above ``generalise`` are replaced by their word shape, at or
above ``remove`` they are removed, wherever they stand: a text without the entity may point to
it by such a term.  Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The kinds in their order, and the character classes of the base patterns.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Each is anchored so that a long run is read once; possessive where nothing has to be given back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W_]{3,}")

#: Words on either side of an entity that count as near it.
WINDOW = 8
#: Documents in which a term has to stand near the entity.
SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95
#: Words counted in memory before the counts are handed on.
FLUSH = 100_000
#: Revealing terms up to which they are sent to the tasks that read the texts; beyond it, the
#: words of the texts and the terms meet in a shuffled join.
SENT_TERMS = 500_000


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern in one pass: from each ``@`` back and forth."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        tail = DOMAIN.match(text, at + 1) if begin < at else None
        if tail:
            out.append((begin, tail.end()))
            free = tail.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of every valid base match, sorted."""
    out = [(b, 0, e) for b, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """The protected value: addresses in lower case, numbers as their digits."""
    value = value.lower() if kind == 0 else value if kind == 1 else NOT_DIGIT.sub("", value)
    return hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).hexdigest()


def near_terms(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """``(entity, term, start, end)`` of the words within ``window`` words of a span, outside spans."""
    if not spans:
        return []
    out = []
    starts, ends, free = array("q"), array("q"), bytearray()
    for b, e, f in terms_of(text, spans):
        starts.append(b)
        ends.append(e)
        free.append(f)
    for b, kind, e in spans:
        name = entity(kind, text[b:e])
        before, after = bisect_right(ends, b), bisect_left(starts, e)
        for at in (*range(max(0, before - window), before), *range(after, min(after + window, len(starts)))):
            if free[at]:
                out.append((name, text[starts[at] : ends[at]].lower(), starts[at], ends[at]))
    return out


def terms_of(text: str, spans: list[tuple[int, int, int]]):
    """``(start, end, free)`` of each word, ``free`` if it is outside all spans."""
    at = reach = 0
    for m in TERM.finditer(text):
        b, e = m.span()
        while at < len(spans) and spans[at][0] < e:
            reach = max(reach, spans[at][2])
            at += 1
        yield b, e, reach <= b


def _found(window: int):
    def run(batches):
        for batch in batches:
            near = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                pairs = {x[:2] for x in near_terms(text, base_spans(text), window)}
                near.append([{"entity": n, "term": t} for n, t in pairs])
            term = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, term)], names=["row", "near"])

    return run


def _marked(known):
    """Base spans, and the words outside them with their disclosure: all words if ``known`` is
    None, else those in the broadcast ``known``."""

    def run(batches):
        for batch in batches:
            spans, words = [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                s = base_spans(text)
                spans.append([{"start": b, "kind": k, "end": e, "disclosure": None} for b, k, e in s])
                sure = known.value if known else None
                if known and sure.keys().isdisjoint(map(str.lower, TERM.findall(text))):
                    words.append([])
                    continue
                listed = ((text[b:e].lower(), b, e) for b, e, free in terms_of(text, s) if free)
                words.append([
                    {"term": t, "start": b, "kind": 4, "end": e, "disclosure": sure[t] if known else None}
                    for t, b, e in listed if not known or t in sure
                ])
            at = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct(at))),
                 pa.array(words, pa.list_(pa.struct([("term", pa.string()), *at])))],
                names=["row", "doc_id", "spans", "words"],
            )

    return run


def _term_counts(batches):
    """Number of texts with each word, added up as far as memory allows."""
    have: Counter[str] = Counter()

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(have.keys()), pa.string()), pa.array(list(have.values()), pa.int64())], names=["term", "n"]
        )
        have.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                have.update({w.lower() for w in TERM.findall(text)})
                if len(have) > FLUSH:
                    yield flush()
    if have:
        yield flush()


def disclosure(found: DataFrame, counts: DataFrame, total: Column, support: int) -> DataFrame:
    """``(entity, term, disclosure)`` of the terms near an entity in ``support`` documents or more."""
    pairs = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term").distinct()
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    entities = pairs.groupBy("entity").agg(F.countDistinct("row").alias("n_e"))
    joined = together.join(entities, "entity").join(counts.groupBy("term").agg(F.sum("n").alias("n_t")), "term")
    own = F.log2(total / F.col("n_e"))
    shared = F.log2(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    return joined.select("entity", "term", F.when(own > 0, shared / own).otherwise(0.0).alias("disclosure"))


def detect(
    docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalise: float = GENERALISE
) -> DataFrame:
    """``(row, doc_id, spans)`` for each row of ``docs``: ``spans`` is a sorted array of
    ``(start, kind, end, disclosure)``, kinds 0 to 3 from the patterns (disclosure null) and 4
    for revealing terms.

    A null text counts as empty.  Ids may be null or repeated: rows are told apart by ``row``.
    Every occurrence of a revealing term outside the base spans is reported, in any text, with
    the largest disclosure of the term; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    found = cut_lineage(rows.select("row", "text").mapInArrow(
        _found(window), "row long, near array<struct<entity:string,term:string>>"
    ))
    counts = docs.select("text").mapInArrow(_term_counts, "term string, n long")
    total = F.lit(float(max(1, found.count())))
    telling = cut_lineage(
        disclosure(found, counts, total, support).where(F.col("disclosure") >= generalise)
        .groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    )
    span = "struct<start:int,kind:int,end:int,disclosure:double>"
    schema = f"row long, doc_id long, spans array<{span}>, words array<struct<term:string,start:int,kind:int,end:int,disclosure:double>>"
    few = telling.limit(SENT_TERMS + 1).toArrow()
    if few.num_rows <= SENT_TERMS:
        known = dict(zip(few.column("term").to_pylist(), few.column("disclosure").to_pylist(), strict=True))
        texts = rows.mapInArrow(_marked(docs.sparkSession.sparkContext.broadcast(known)), schema)
        more = F.transform("words", lambda w: F.struct(*(w[k].alias(k) for k in ("start", "kind", "end", "disclosure"))))
    else:
        texts = cut_lineage(rows.mapInArrow(_marked(None), schema))
        # a lookup of one row; frequent words are split by adaptive execution
        marked = (
            texts.select("row", F.explode("words").alias("w")).select("row", "w.term", "w.start", "w.kind", "w.end")
            .join(telling, "term")
            .groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "disclosure")).alias("more"))
        )
        texts = texts.join(marked, "row", "left")
        more = F.coalesce("more", F.array().cast(f"array<{span}>"))
    return texts.select("row", "doc_id", F.array_sort(F.concat("spans", more)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def shape(term: str) -> str:
    """Generalised term: its letters and digits by class, so that length and form remain."""
    return "".join("0" if c.isdigit() else "X" if c.isupper() else "x" for c in term)


def sanitise(docs: DataFrame, remove: float = REMOVE, **options) -> DataFrame:
    """``(doc_id, clean_text)``: base spans become ``<kind>``, terms their shape, or go.

    Overlapping spans are merged into the first one; a null text gives an empty one.  The rows
    are those of ``docs``, matched by the order in which a checkpoint of them is read.
    """
    fixed = cut_lineage(docs.select("doc_id", "text"))
    spans = detect(fixed, **options).select("row", "spans")
    texts = fixed.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")

    def run(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, parts, at = text or "", [], 0
                for s in found or []:
                    if s["start"] >= at:
                        parts.append(text[at : s["start"]])
                        if s["kind"] < 4:
                            parts.append(f"<{KINDS[s['kind']]}>")
                        elif s["disclosure"] < remove:
                            parts.append(shape(text[s["start"] : s["end"]]))
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "clean_text"])

    return texts.join(spans, "row").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, clean_text string")


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, for each row."""
    found = detect(docs, **options)
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        count(4).alias("n_term"),
    )
