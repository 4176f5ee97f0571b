"""Sparse and dense candidate search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxograft.functions.arrays import cosine
from taxograft.functions.ids import inner_ids
from taxograft.functions.text import tokenize
from taxograft.plans.lineage import cut_lineage
from taxograft.plans.order import top_k
from taxograft.plans.skew import balanced_join

#: Scores are rounded so that ties do not depend on the order of summation.
DIGITS = 9
EPSILON = 1e-8


def best_first() -> list:
    """Order of candidates: by score, then by id."""
    return [F.desc("score"), F.asc("id")]


# ---------------------------------------------------------------- sparse search

def build_postings(concepts: DataFrame, tokenizer=None, only: DataFrame | None = None) -> DataFrame:
    """Postings ``(token, id, tf)`` of the texts ``(id, text)`` of each concept.

    ``only(token)`` keeps the tokens that are asked for, before anything is shuffled.
    """
    tokens = concepts.select("id", F.explode(tokenize("text", tokenizer)).alias("token"))
    if only is not None:
        tokens = tokens.join(only.select("token").distinct(), "token", "left_semi")
    return tokens.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def text_lengths(concepts: DataFrame, tokenizer=None) -> DataFrame:
    """Token count ``(id, dl)`` of each concept that has any."""
    n = F.size(tokenize("text", tokenizer))
    return concepts.groupBy("id").agg(F.sum(n).alias("dl")).where(F.col("dl") > 0)


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, tokenizer=None) -> DataFrame:
    """Terms ``(q, token, qtf)`` of the queries ``(q, text)``; repeats count."""
    return (
        queries.select("q", F.explode(tokenize("text", tokenizer)).alias("token"))
        .groupBy("q", "token").agg(F.count(F.lit(1)).alias("qtf"))
    )


def idf_terms(terms: DataFrame, postings: DataFrame, n_concepts: DataFrame) -> DataFrame:
    """Weighted terms ``(q, token, w)`` with ``w = qtf * log10(D / df)``."""
    df = document_frequency(postings)
    return balanced_join(terms, df, "token", fanout=False).select(
        "q", "token", (F.col("qtf") * F.log10(n_concepts.scalar() / F.col("df"))).alias("w")
    )


def concept_count(concepts: DataFrame) -> DataFrame:
    return concepts.agg(F.count_distinct("id").alias("n"))


def _listed(df: DataFrame, key: str, value: str, side: str) -> DataFrame:
    """``(key, <side>_tokens, <side>_values)``: the tokens of a text with a value each, sorted; one row a text."""
    pairs = F.struct(F.xxhash64("token").alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    # a null key meets nothing, so its rows are not gathered
    listed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(pairs)).alias("_l"))
    return listed.select(key, F.col("_l.t").alias(f"{side}_tokens"), F.col("_l.v").alias(f"{side}_values"))


def _overlap(a: str, b: str) -> Column:
    """Sum of the products of the values of equal tokens of two sorted lists, null where a list is."""

    def marked(side: str, no: int):
        return F.zip_with(
            f"{side}_tokens", f"{side}_values", lambda t, v: F.struct(t.alias("t"), F.lit(no).alias("s"), v.alias("v")))

    # two sorted runs are merged; a token of the second list meets what the first has just had of it
    merged = F.sort_array(F.concat(marked(a, 0), marked(b, 1)))
    start = F.struct(F.lit(None).cast("long").alias("t"), F.lit(0.0).alias("v"), F.lit(0.0).alias("sum"))

    def step(acc, x):
        held = F.when(acc["t"] == x["t"], acc["v"]).otherwise(0.0)
        first = x["s"] == 0
        return F.struct(
            x["t"].alias("t"), F.when(first, held + x["v"]).otherwise(held).alias("v"),
            F.when(first, acc["sum"]).otherwise(acc["sum"] + held * x["v"]).alias("sum"))

    return F.round(F.aggregate(merged, start, step, lambda acc: acc["sum"]), DIGITS)


def score_pairs(pairs: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Score of each distinct ``(q, id)`` pair, 0 where no term matches.

    The tokens of a text are one row, so a pair takes its two lists along and is never multiplied by tokens.
    """
    wanted = pairs.select("q", "id").distinct()
    both = wanted.join(_listed(terms, "q", "w", "a"), "q", "left").join(_listed(postings, "id", "pw", "b"), "id", "left")
    return both.select("q", "id", F.coalesce(_overlap("a", "b"), F.lit(0.0)).alias("score"))


def _idf_postings(postings: DataFrame, df: DataFrame, n_concepts: DataFrame) -> DataFrame:
    """Postings ``(token, id, pw)`` with ``pw = log10(D / df)``, for ``df(token, df)``."""
    idf = F.log10(n_concepts.scalar() / F.col("df"))
    return balanced_join(postings, df, "token", fanout=False).select("token", "id", idf.alias("pw"))


#: Postings of one shard, those that a task holds at least and at most, documents of one block, queries that meet one copy
#: of a shard, and terms of one packed row.
SHARD_POSTINGS = 1 << 22
HELD_POSTINGS = 1 << 20
MOST_POSTINGS = 1 << 23
BLOCK_DOCS = 512
SHARD_QUERIES = 1 << 19
PACK_TERMS = 256


def _shard_search(k: int, block_docs: int):
    """Index of one shard and its search.  Nested, so that workers get it by value.

    Postings are kept by token, each with the largest weight in every block of ``block_docs``
    documents.  What a query can get from a block is bounded by these maxima; the most
    promising blocks are summed up first, and of the others only those that can still reach the
    ``k``-th score found.
    """
    digits, slack = DIGITS, EPSILON

    def ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())

    class Shard:
        def __init__(self, doc: np.ndarray, token: np.ndarray, weight: np.ndarray, static: np.ndarray):
            order = np.argsort(token, kind="stable")  # documents are in order already
            self.doc, token, self.weight, self.static = doc[order], token[order], weight[order], static
            # weights that a document has for one token in several fields are one
            first = np.ones(len(token), dtype=bool)
            first[1:] = (token[1:] != token[:-1]) | (self.doc[1:] != self.doc[:-1])
            if not first.all():
                self.weight = np.add.reduceat(self.weight, np.flatnonzero(first))
                self.doc, token = self.doc[first], token[first]
            # runs of one token in one block, and the tokens' runs of runs
            run = np.ones(len(token), dtype=bool)
            run[1:] = (token[1:] != token[:-1]) | (self.doc[1:] // block_docs != self.doc[:-1] // block_docs)
            self.low = np.flatnonzero(run)
            self.size = np.diff(np.append(self.low, len(token)))
            self.block = self.doc[self.low] // block_docs
            self.most = np.maximum.reduceat(self.weight, self.low) if len(self.low) else np.zeros(0)
            self.tokens, self.first = np.unique(token[self.low], return_index=True)
            self.runs = np.diff(np.append(self.first, len(self.low)))
            blocks = len(static) // block_docs + 1
            self.best_static = np.zeros(blocks)
            np.maximum.at(self.best_static, np.arange(len(static)) // block_docs, static)

        def totals(self, runs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Documents of the runs, in order, and their rounded scores."""
            at = ranges(self.low[runs], self.size[runs])
            doc, points = self.doc[at], self.weight[at] * np.repeat(weights, self.size[runs])
            if 8 * len(doc) < len(self.static):
                docs, place = np.unique(doc, return_inverse=True)
                score = np.bincount(place, points)
            else:  # counting by place is cheaper than sorting
                seen = np.zeros(len(self.static), dtype=bool)
                seen[doc] = True
                docs = np.flatnonzero(seen)
                score = np.bincount(doc, points, len(seen))[docs]
            return docs, np.round(score + self.static[docs], digits)

        def search(self, tokens: np.ndarray, weights: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
            """The best documents; of those below ``least`` some or none."""
            if not len(self.tokens):
                return np.zeros(0, dtype=np.int64), np.zeros(0)
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            met = self.tokens[at] == tokens
            at, weights = at[met], weights[met]
            runs = ranges(self.first[at], self.runs[at])
            if not len(runs):
                return np.zeros(0, dtype=np.int64), np.zeros(0)
            weights = np.repeat(weights, self.runs[at])
            block = self.block[runs]
            bound = np.bincount(block, weights * self.most[runs], len(self.best_static))
            held = np.bincount(block, minlength=len(bound)) > 0
            bound = np.where(held, bound + self.best_static, -np.inf)
            if bound.max() < least - slack:
                return np.zeros(0, dtype=np.int64), np.zeros(0)
            ahead = np.argsort(-bound, kind="stable")[: max(4, -(-2 * k // block_docs))]
            early = np.isin(block, ahead)
            docs, score = self.totals(runs[early], weights[early])
            floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            late = ~early & (bound >= max(floor, least) - slack)[block]
            if late.any():
                more, points = self.totals(runs[late], weights[late])
                docs, score = np.concatenate([docs, more]), np.concatenate([score, points])
            best = np.lexsort((docs, -score))[:k]
            return docs[best], score[best]

    class Shards:
        """The shards of one task, each of about ``size`` postings, cut between documents."""

        def __init__(self, doc: np.ndarray, token: np.ndarray, weight: np.ndarray, static: np.ndarray, size: int):
            ends = np.cumsum(np.bincount(doc, minlength=len(static)))  # postings up to the end of each document
            cuts = np.searchsorted(ends, np.arange(size, len(doc), size)) + 1
            self.cuts = np.unique(np.concatenate([[0], cuts, [len(static)]]))
            self.parts = []
            for low, high in zip(self.cuts, self.cuts[1:]):
                a, b = ends[low - 1] if low else 0, ends[high - 1]
                self.parts.append(Shard(doc[a:b] - low, token[a:b], weight[a:b], static[low:high]))

        def search(self, tokens: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            docs, score = np.zeros(0, dtype=np.int64), np.zeros(0)
            for low, part in zip(self.cuts, self.parts):
                more, points = part.search(tokens, weights, score[-1] if len(score) >= k else -np.inf)
                if len(more):
                    docs, score = np.concatenate([docs, more + low]), np.concatenate([score, points])
                    best = np.lexsort((docs, -score))[:k]
                    docs, score = docs[best], score[best]
            return docs, score

    return Shards


def sparse_top_k(
    terms: DataFrame,
    postings: DataFrame,
    k: int,
    static: DataFrame | None = None,
    shard_postings: int = SHARD_POSTINGS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Exact top ``k`` ids ``(q, rank, id, score)`` for ``score = sum(w * pw) (+ static)``.

    ``terms(q, token, w)``, ``postings(token, id, pw)`` with non-negative weights, and optionally
    ``static(id, static)``, a score added to every matched id.

    Ids are dealt to tasks by their hash, and a task holds as many shards as make ``HELD_POSTINGS``; where there are
    more terms than that, as many postings as terms, up to ``MOST_POSTINGS``.  Each posting of a token that is asked for is shuffled
    once, to its task, where it stays while the terms of the queries stream past, packed in a row a query
    (``PACK_TERMS`` a row) and sent once a task; all scores of an id
    are summed there, and a task hands on ``k`` rows per query.  However frequent a token is, no
    pair of a query and an id is ever shuffled before it is among the best of its shard.
    """
    terms = cut_lineage(terms.where(F.col("w") > 0).select("q", F.xxhash64("token").alias("token"), F.col("w").cast("double").alias("w")))
    id_type = postings.schema["id"].dataType
    known = cut_lineage(postings.select(F.xxhash64("token").alias("token"), "id", F.col("pw").cast("double").alias("pw")).join(
        terms.select("token").distinct(), "token", "left_semi"
    ))
    # terms that no posting has are not sent; queries are numbered, so that what is sorted and sent is flat
    met = terms.join(known.select("token").distinct(), "token", "left_semi")
    queries = cut_lineage(met.groupBy("q").agg(F.count(F.lit(1)).alias("n")).withColumn("no", F.monotonically_increasing_id()))
    piece = F.pmod("token", F.ceil(F.col("n") / PACK_TERMS)).alias("piece")
    packed = met.join(queries, "q").groupBy("no", piece).agg(F.collect_list(F.struct("token", "w")).alias("t"))
    # flat columns: lists, null in every posting, take a row of Arrow longer than all else
    tokens = F.unhex(F.array_join(F.transform("t.token", lambda t: F.lpad(F.hex(t), 16, "0")), "")).alias("tokens")
    ws = F.array_join(F.transform("t.w", lambda w: w.cast("string")), ",").alias("ws")
    packed = cut_lineage(packed.select("no", tokens, ws))
    n_postings = known.count()
    n_queries, n_terms = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_postings = min(MOST_POSTINGS, max(HELD_POSTINGS, n_terms))
    shards, copies = max(1, -(-n_postings // held_postings)), max(1, -(-n_queries // SHARD_QUERIES))
    # fewer tasks than cores: split whichever side is cheaper to split
    more = max(1, -(-terms.sparkSession.sparkContext.defaultParallelism // (shards * copies)))
    shards, copies = (shards * more, copies) if n_postings > 4 * n_queries else (shards, copies * more)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = lambda kind: F.lit(None).cast(kind)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    no_terms = [none("long").alias("no"), none("binary").alias("tokens"), none("string").alias("ws")]
    rows = known.select(shard, every(copies).alias("copy"), "id", "token", "pw", *no_terms)
    if static is not None:
        # a row without a token beside the postings of its id
        fixed = static.where("static IS NOT NULL").select(F.col("id").cast(id_type).alias("id"), F.col("static").cast("double").alias("pw"))
        rows = rows.unionByName(fixed.select(
            shard, every(copies).alias("copy"), "id", none("long").alias("token"), "pw", *no_terms))
    rows = rows.unionByName(packed.select(
        every(shards).alias("shard"), F.pmod(F.xxhash64("no"), F.lit(copies)).cast("int").alias("copy"),
        none(id_type).alias("id"), none("long").alias("token"), none("double").alias("pw"), "no", "tokens", "ws"))
    place = F.col("shard") * F.lit(copies) + F.col("copy")
    rows = rows.repartitionById(shards * copies, place).drop("shard", "copy").sortWithinPartitions(F.asc_nulls_first("no"), "id")
    index = _shard_search(k, block_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task holds is taken out of the batches as they come, which are then let go
        ids: list[pa.Array] = []
        known: dict[str, list[np.ndarray]] = {c: [] for c in ("doc", "token", "weight", "at", "extra")}
        n_docs, last, found, rest = 0, None, None, None

        def take(part: pa.RecordBatch) -> None:
            nonlocal n_docs, last
            column, token = part.column(0), part.column(1)
            before, after = column.slice(0, len(column) - 1), column.slice(1)
            new = np.ones(len(column), dtype=bool)
            new[0] = not n_docs or column[0].as_py() != last
            new[1:] = pc.or_(
                pc.fill_null(pc.not_equal(after, before), False), pc.not_equal(after.is_null(), before.is_null())
            ).to_numpy(zero_copy_only=False)
            doc = (np.cumsum(new) + (n_docs - 1)).astype(np.int32)
            fixed = token.is_null().to_numpy(zero_copy_only=False)
            weight = part.column(2).to_numpy()
            for name, values in zip(known, (
                doc[~fixed], np.array(token.drop_null()), weight[~fixed], doc[fixed], weight[fixed]
            ), strict=True):
                known[name].append(values)
            ids.append(column.filter(pa.array(new)))
            n_docs, last = n_docs + int(new.sum()), column[-1].as_py()

        def joined(name: str) -> np.ndarray:
            values = np.concatenate(known[name])
            known[name].clear()
            return values

        def answer(part: list[np.ndarray]):
            no, token, weight = part
            ends = np.append(np.flatnonzero(no[1:] != no[:-1]) + 1, len(no))
            out = [[], [], []]
            for start, end in zip([0, *ends], ends):
                docs, score = found.search(token[start:end], weight[start:end])
                for column, values in zip(out, (np.full(len(docs), no[start]), docs, score), strict=True):
                    column.append(values)
            no, docs, score = (np.concatenate(c) for c in out)
            return pa.RecordBatch.from_arrays([pa.array(no), ids[0].take(pa.array(docs)), pa.array(score)], names=["no", "id", "score"])

        for batch in batches:
            n = batch.column(3).null_count
            if n:
                take(batch.slice(0, n))
            if n == batch.num_rows or not n_docs:
                continue
            if found is None:
                ids = [pa.concat_arrays(ids)]
                extra = np.bincount(joined("at"), joined("extra"), n_docs)
                found = index(joined("doc"), joined("token"), joined("weight"), extra, shard_postings)
            asked = batch.slice(n)
            tokens = [np.frombuffer(x, ">i8") for x in asked.column(4).to_pylist()]
            ws = [np.array(x.split(","), dtype=float) for x in asked.column(5).to_pylist()]
            part = [np.repeat(asked.column(3).to_numpy(), [len(x) for x in tokens]), np.concatenate(tokens).astype(np.int64), np.concatenate(ws)]
            if rest is not None:
                part = [np.concatenate(c) for c in zip(rest, part, strict=True)]
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last query may go on in the next batch
            rest = [c[cut:] for c in part]
            if cut:
                yield answer([c[:cut] for c in part])
        if rest is not None:
            yield answer(rest)

    schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    best = top_k(rows.mapInArrow(run, schema), "no", best_first(), k)
    return best.join(queries, "no").select("q", "rank", "id", "score")


def idf_select(queries: DataFrame, concepts: DataFrame, k: int, tokenizer=None, **shards) -> DataFrame:
    """Concepts ``(id, text)`` ranked by summed inverse document frequency.

    ``queries(q, text)``; repeated query tokens count repeatedly.  ``shards`` are the sizes that
    :func:`sparse_top_k` takes.
    """
    asked = cut_lineage(query_terms(queries, tokenizer))
    postings = cut_lineage(build_postings(concepts, tokenizer, asked))
    terms = idf_terms(asked, postings, concept_count(concepts))
    return sparse_top_k(terms, postings.withColumn("pw", F.lit(1.0)), k, **shards)


def concept_idf_similarity(pairs: DataFrame, concepts: DataFrame, tokenizer=None) -> DataFrame:
    """Summed idf over the tokens of ``a`` (with repeats) that ``b`` has, per pair ``(a, b)``."""
    # texts meet in the task of their id, where their tokens are counted: no single token is shuffled
    texts = concepts.select("id", "text").repartition("id")
    df = cut_lineage(document_frequency(build_postings(texts, tokenizer)))
    told = texts.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    weighted = _idf_postings(build_postings(told, tokenizer), df, concept_count(concepts))
    asked = texts.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    terms = query_terms(asked.select(F.col("id").alias("q"), "text"), tokenizer).withColumnRenamed("qtf", "w")
    scored = score_pairs(pairs.select(F.col("a").alias("q"), F.col("b").alias("id")), terms, weighted)
    return scored.select(F.col("q").alias("a"), F.col("id").alias("b"), F.col("score").alias("sim"))


def bm25_weights(
    postings: DataFrame, lengths: DataFrame, k1: float = 1.5, b: float = 0.75, by: Sequence[str] = ()
) -> DataFrame:
    """Postings ``(*by, token, id, pw)`` with Okapi weights, for lengths ``(*by, id, dl)``.

    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``, never negative.  With ``by``, documents are counted
    and measured for each of its values (a handful of fields).
    """
    by = list(by)
    sizes = F.broadcast(lengths.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_mean")))
    df = postings.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))
    df = df.join(sizes, by) if by else df.crossJoin(sizes)  # one row a field
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    weight = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("_mean")))
    rare = df.select(*by, "token", idf.alias("idf"), "_mean")
    # the token and the id of a posting may be hot; both joins only look up one row
    joined = postings.join(rare, [*by, "token"]).join(lengths, [*by, "id"])
    return joined.select(*by, "token", "id", weight.alias("pw"))


def bm25(
    queries: DataFrame, concepts: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, tokenizer=None, **shards
) -> DataFrame:
    asked = cut_lineage(query_terms(queries, tokenizer))
    postings = cut_lineage(build_postings(concepts, tokenizer, asked))
    weights = bm25_weights(postings, cut_lineage(text_lengths(concepts, tokenizer)), k1, b)
    return sparse_top_k(asked.select("q", "token", F.col("qtf").alias("w")), weights, k, **shards)


def multi_field_search(
    queries: DataFrame,
    fields: DataFrame,
    weights: dict[str, float],
    k: int,
    links: DataFrame | None = None,
    tokenizer=None,
    **shards,
) -> DataFrame:
    """Weighted sum of per-field Okapi scores plus ``log10(links + 1)``.

    ``fields(id, field, text)`` holds the searchable fields; ``links(id, n_links)`` the
    popularity of a document, added to whatever matched at all.
    """
    asked = cut_lineage(query_terms(queries, tokenizer).withColumn("token", F.xxhash64("token")))
    names = [n for n, share in weights.items() if share > 0]
    used = fields.where(F.col("field").isin(names)).select("field", "id", tokenize("text", tokenizer).alias("tokens"))
    lengths = used.groupBy("field", "id").agg(F.sum(F.size("tokens")).alias("dl")).where(F.col("dl") > 0)
    tokens = used.select("field", "id", F.explode("tokens").alias("token")).withColumn("token", F.xxhash64("token"))
    postings = (
        tokens.join(asked.select("token").distinct(), "token", "left_semi")
        .groupBy("field", "token", "id").agg(F.count(F.lit(1)).alias("tf"))
    )
    weighted = bm25_weights(cut_lineage(postings), cut_lineage(lengths), by=["field"])
    # the share of a field is part of its weights, so all fields are searched at once by the same terms
    share = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(weights[n]))]), F.col("field"))
    terms = asked.select("q", "token", F.col("qtf").alias("w"))
    static = None
    if links is not None:
        static = links.select("id", F.log10(F.col("n_links") + 1).alias("static"))
    return sparse_top_k(terms, weighted.select("token", "id", (F.col("pw") * share).alias("pw")), k, static, **shards)


def retrieval_grid(
    settings: dict[str, DataFrame], fields: DataFrame, weights: dict[str, float], k: int, links: DataFrame | None = None
) -> DataFrame:
    """The same search for several query settings in one plan; ``setting`` tells them apart."""
    queries = None
    for name, df in settings.items():
        part = df.select(F.struct(F.lit(name).alias("setting"), F.col("q").alias("mention_id")).alias("q"), "text")
        queries = part if queries is None else queries.unionByName(part)
    found = multi_field_search(queries, fields, weights, k, links)
    return found.select("q.setting", "q.mention_id", "rank", "id", "score")


# ----------------------------------------------------------------- dense search

def _best_rows(metric: str, k: int, block_rows: int = 8_192, cells: int = 1 << 21):
    """Kernel of the vectors that a task holds, ids in order, and a batch of queries: places and scores
    of the best ``k`` of each.  The vectors are met in blocks of ``block_rows``, whose best are merged, by so
    many queries that ``cells`` scores are held at once.  It is nested so that workers get it by value
    and need no package."""
    if metric not in {"ip", "cosine", "l2"}:
        raise ValueError(metric)
    digits = DIGITS

    def unit_rows(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def first(s: np.ndarray) -> np.ndarray:
        # places of the best k of each row: rounded score descending, then place (id) ascending
        n = s.shape[1]
        if n <= 4 * k or np.isnan(s.sum()):
            return np.argsort(-np.round(s, digits), axis=1, kind="stable")[:, :k]
        # rounding moves a score by less than a unit of the last digit: whatever may tie with the k-th is looked at
        floor = np.partition(s, n - k, axis=1)[:, n - k] - 2.0 * 10.0**-digits
        row, place = np.nonzero(s >= floor[:, None])
        by = np.lexsort((place, -np.round(s[row, place], digits), row))
        starts = np.searchsorted(row, np.arange(len(s)))  # the row column is in order already
        return place[by[starts[:, None] + np.arange(k)]]

    def best(q: np.ndarray, v: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # higher is better for every metric
        if metric == "ip":
            s = q @ v.T
        elif metric == "cosine":
            s = unit_rows(q) @ unit.T
        else:
            s = -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T, 0))
        order = first(s)
        if metric == "l2":  # distances of the chosen vectors are taken again without cancellation
            return order, np.round(-np.sqrt(((q[:, None, :] - v[order]) ** 2).sum(-1)), digits)
        return order, np.round(np.take_along_axis(s, order, 1), digits)

    def kernel(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = unit_rows(v) if metric == "cosine" else v
        rows = max(16, cells // min(len(v), block_rows))
        parts = []
        for at in range(0, len(q), rows):
            asked, found = q[at : at + rows], []
            for b in range(0, len(v), block_rows):
                order, score = best(asked, v[b : b + block_rows], unit[b : b + block_rows])
                found.append((order + b, score))
            order, score = (np.concatenate(x, axis=1) for x in zip(*found, strict=True))
            if len(found) > 1:  # blocks follow by id, so a stable sort keeps ties in order
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                order, score = np.take_along_axis(order, top, 1), np.take_along_axis(score, top, 1)
            parts.append((order, score))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    return kernel


#: Queries that meet the vectors of one task; more of them meet copies of these vectors.
QUERY_ROWS = 1 << 16
#: Vectors that a task holds at least, where there are as many: queries are sent once for all of their blocks.
HELD_ROWS = 1 << 15


def scan_blocks(
    queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", query_rows: int = QUERY_ROWS, block_rows: int = 8_192
) -> DataFrame:
    """The best ``k`` rows ``(q, id, score)`` of each block for each of its queries.

    ``vectors(block, id, vector)`` are shuffled once, to the task of their block, where they stay
    while ``queries(block, q, vector)`` stream past; a task holds one block and one batch.  Scores are
    taken for ``block_rows`` vectors at once.
    """
    load = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("_n"))
    load = cut_lineage(load)  # a row a block
    copies = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy")
    doubles = F.col("vector").cast("array<double>").alias("vector")
    q_type, id_type = queries.schema["q"].dataType, vectors.schema["id"].dataType
    right = vectors.join(load, "block").select(
        "block", copies, F.lit(0).alias("kind"), F.lit(None).cast(q_type).alias("q"), "id", doubles)
    left = queries.join(load, "block").select(
        "block", F.pmod(F.xxhash64("q"), F.col("_n")).cast("int").alias("copy"), F.lit(1).alias("kind"), "q",
        F.lit(None).cast(id_type).alias("id"), doubles)
    rows = right.unionByName(left).repartition("block", "copy").sortWithinPartitions("block", "copy", "kind", "id")
    kernel = _best_rows(metric, k, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            return batch.column(5).flatten().to_numpy().reshape(batch.num_rows, -1)

        now, held, block = None, [], None
        for batch in batches:
            keys = batch.select(["block", "copy", "kind"]).to_pylist()
            ends = [i for i in range(1, len(keys) + 1) if i == len(keys) or keys[i] != keys[i - 1]]
            for start, end in zip([0, *ends], ends):
                part, key = batch.slice(start, end - start), keys[start]
                here = key["block"], key["copy"]
                if here != now:
                    now, held, block = here, [], None
                if key["kind"] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    block = np.concatenate([matrix(p) for p in held]), pa.concat_arrays([p.column(4) for p in held])
                order, score = kernel(matrix(part), block[0])
                asked = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(3).take(asked), block[1].take(pa.array(order.ravel())), pa.array(score.ravel())],
                    names=["q", "id", "score"],
                )

    schema = T.StructType([T.StructField("q", q_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def block_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    metric: str = "ip",
    group: Sequence[str] = (),
    block_rows: int = 8_192,
    held_rows: int = HELD_ROWS,
) -> DataFrame:
    """Exact top ``k`` vectors per query within each group.

    The vectors of a group are cut into blocks of about ``block_rows`` rows, each of which is met
    by all queries of the group.  A task holds blocks of ``held_rows`` vectors together and hands on ``k``
    rows per query, so a group of any size is spread and no list of pairs is ever produced.
    """
    group = list(group)
    if not group:
        queries, vectors, group = queries.withColumn("_g", F.lit(0)), vectors.withColumn("_g", F.lit(0)), ["_g"]
    count = F.ceil(F.count(F.lit(1)) / max(block_rows, held_rows)).cast("int").alias("_n")
    sizes = cut_lineage(vectors.groupBy(*group).agg(count))
    name = F.to_json(F.struct(*group, F.col("_b")))
    left = (
        balanced_join(queries.select(*group, "q", "vector"), sizes, group, spread=["q"], fanout=False)
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(name.alias("block"), "q", "vector")
    )
    right = (
        balanced_join(vectors.select(*group, "id", "vector"), sizes, group, spread=["id"], fanout=False)
        .withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).select(name.alias("block"), "id", "vector")
    )
    return top_k(scan_blocks(left, right, k, metric, block_rows=block_rows), "q", best_first(), k).select("q", "rank", "id", "score")


def nearest_exact(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", block_rows: int = 8_192) -> DataFrame:
    """Exact nearest vectors ``(q, rank, id, score)`` under ``ip``, ``cosine`` or ``l2``."""
    return block_search(queries, vectors, k, metric, (), block_rows)


#: All mentions against all catalogue vectors, then the best k.
score_all = nearest_exact


def nearest_concepts(mention_vectors: DataFrame, concept_vectors: DataFrame, n: int, metric: str = "cosine") -> DataFrame:
    """Concept pool of each mention vector."""
    return block_search(mention_vectors, concept_vectors, n, metric)


def nearest_in_domain(queries: DataFrame, vectors: DataFrame, k: int, domain: str = "domain", metric: str = "ip") -> DataFrame:
    """Search restricted to the query's own domain."""
    return block_search(queries, vectors, k, metric, (domain,))


#: Rows a list that the centroids are trained on, rounds of training, and the largest number of
#: lists, which bounds what a task is sent (lists x dimensions numbers); further rows of a list
#: make further blocks.
TRAIN_ROWS = 64
ROUNDS = 12
MAX_LISTS = 1 << 15
#: Queries whose lists are chosen at once: a task holds their vectors once per list.
PROBED_ROWS = 64
#: Queries on which the number of probes is calibrated.
CALIBRATE = 256


class Lists:
    """Inverted lists over k-means centroids: ``rows(block, list, id, vector)`` of all vectors, and
    for each list its centroid and the radius that holds all of its vectors."""

    def __init__(self, vectors: DataFrame, n_lists: int | None = None, block_rows: int = 8_192, seed: int = 1234):
        total = vectors.count()
        n_lists = n_lists or min(MAX_LISTS, max(16, int(total**0.5)))
        sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n_lists * TRAIN_ROWS).select("vector")
        self.centres = centres = self._train(sample, n_lists, seed)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centres**2).sum(1) / 2
            for batch in batches:
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, centres.shape[1])
                near = np.argmax(v @ centres.T - half, axis=1)
                far = np.sqrt(((v - centres[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=["id", "vector", "list", "far"]
                )

        schema = T.StructType([
            T.StructField("id", vectors.schema["id"].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())),
            T.StructField("list", T.IntegerType()), T.StructField("far", T.DoubleType()),
        ])
        rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(assign, schema)
        rows = cut_lineage(rows)
        stats = rows.groupBy("list").agg(F.max("far").alias("r"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("n"))
        found = stats.toPandas()  # a row a list
        self.radii = np.full(len(centres), -np.inf)  # an empty list holds nothing
        self.radii[found["list"]] = found["r"] * (1 + 1e-9) + 1e-9
        self.blocks = np.zeros(len(centres), dtype=np.int64)
        self.blocks[found["list"]] = found["n"]
        n_blocks = F.get(F.lit(self.blocks.tolist()), F.col("list"))
        self.rows = rows.select("list", self._block(F.pmod(F.xxhash64("id"), n_blocks)), "id", "vector")

    @staticmethod
    def _block(part) -> Column:
        return (F.shiftleft(part.cast("long"), 16).bitwiseOR(F.col("list").cast("long"))).alias("block")

    @staticmethod
    def _train(sample: DataFrame, n_lists: int, seed: int) -> np.ndarray:
        column = sample.select(F.col("vector").cast("array<double>").alias("vector")).toArrow().column(0).combine_chunks()
        if not len(column):
            return np.zeros((1, 1))
        x = column.flatten().to_numpy().reshape(len(column), -1)
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(n_lists, len(x)), replace=False)].copy()
        for _ in range(ROUNDS):
            near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
            size = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, x)
            centres[size > 0] = total[size > 0] / size[size > 0, None]
        return centres

    def probes(self, queries: DataFrame, n: int, skip: int = 0) -> DataFrame:
        """The lists ``skip`` to ``n`` of every query ``(q, vector[, floor])``, best centroid first, as
        ``(block, q, vector, list, place)``.

        No vector of a list has a product above ``q.c + |q| r``: lists that cannot reach the
        ``floor`` of the query are passed over.
        """
        centres, radii = self.centres, self.radii
        with_floor = "floor" in queries.columns

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # every query comes out once per list, so few go in at once
            for batch in (b.slice(at, PROBED_ROWS) for b in batches for at in range(0, b.num_rows, PROBED_ROWS)):
                if np.isinf(radii).all():
                    continue  # no vectors
                q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, centres.shape[1])
                near = np.where(np.isinf(radii), -np.inf, q @ centres.T)
                order = np.argsort(-near, axis=1, kind="stable")[:, skip:n]
                bound = np.take_along_axis(near + np.linalg.norm(q, axis=1)[:, None] * np.maximum(radii, 0), order, 1)
                floor = batch.column(2).fill_null(-np.inf).to_numpy()[:, None] if with_floor else -np.inf
                row, place = np.nonzero((bound >= floor) & ~np.isinf(bound))
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(order[row, place].astype(np.int32)),
                     pa.array((place + skip).astype(np.int32))], names=["q", "vector", "list", "place"],
                )

        schema = T.StructType([
            T.StructField("q", queries.schema["q"].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())),
            T.StructField("list", T.IntegerType()), T.StructField("place", T.IntegerType()),
        ])
        columns = ["q", F.col("vector").cast("array<double>").alias("vector"), *(["floor"] if with_floor else [])]
        chosen = queries.select(*columns).mapInArrow(choose, schema)
        n_blocks = F.get(F.lit(self.blocks.tolist()), F.col("list"))
        parts = chosen.withColumn("_p", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
        return parts.select(self._block(F.col("_p")), "q", "vector", "list", "place")

    def calibrated(self, queries: DataFrame, k: int, recall: float, rows: int = CALIBRATE) -> int:
        """The smallest number of probes that finds a share ``recall`` of the true neighbours of up to
        ``rows`` queries, which are searched in all lists."""
        sample = cut_lineage(queries.orderBy(F.xxhash64("q"), "q").limit(rows).select("q", "vector"))
        every = cut_lineage(self.probes(sample, len(self.centres)))
        true = top_k(scan_blocks(every, self.rows, k), "q", best_first(), k)
        places = true.join(self.rows.select("id", "list"), "id").join(every.select("q", "list", "place").distinct(), ["q", "list"])
        needed = places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row a list
        total, seen = sum(r["n"] for r in needed), 0
        for r in needed:
            seen += r["n"]
            if seen >= recall * total:
                return r["place"] + 1
        return 1


def nearest_approx(
    queries: DataFrame, vectors: DataFrame, k: int, lists: Lists | None = None, recall: float = 0.95,
    probes: int | None = None, n_lists: int | None = None, block_rows: int = 8_192,
) -> DataFrame:
    """Approximate inner-product search ``(q, rank, id, score)`` over inverted lists, with exact scores.

    Every vector is in the list of its nearest centroid.  A query looks into its best quarter of
    ``probes`` lists first; the score of the ``k``-th row found is a floor, and of the others only
    those are read whose centroid and radius allow a better one.  Without ``probes``, a sample of
    the queries tells how many lists a share ``recall`` of the true neighbours takes.  ``lists`` may be
    built once and searched often.
    """
    lists = lists or Lists(vectors, n_lists, block_rows)
    probes = probes or lists.calibrated(queries, k, recall)
    queries = queries.select("q", "vector")
    first = max(1, probes // 4)
    near = cut_lineage(top_k(scan_blocks(lists.probes(queries, first), lists.rows, k), "q", best_first(), k))
    floors = near.where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    further = scan_blocks(lists.probes(queries.join(floors, "q", "left"), probes, first), lists.rows, k)
    both = near.select("q", "id", "score").unionByName(further)
    return top_k(both, "q", best_first(), k).select("q", "rank", "id", "score")


def recall_of(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results that the approximate search found."""
    found = exact.join(approx.select("q", "id").withColumn("_f", F.lit(1)), ["q", "id"], "left")
    return found.agg(F.avg(F.coalesce("_f", F.lit(0))).alias("recall"))


def complex_vectors(complex_ids: DataFrame, concept_vectors: DataFrame, dim: int) -> DataFrame:
    """Mean of the known inner vectors of each complex id; zero when none is known."""
    ids = complex_ids.select("id").distinct()
    inner = ids.select("id", F.explode(inner_ids("id")).alias("part"))
    known = concept_vectors.select(F.col("id").alias("part"), "vector")
    means = balanced_join(inner, known, "part", fanout=False).groupBy("id").agg(
        *[F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"_{i}") for i in range(dim)]
    )
    zero = F.array_repeat(F.lit(0.0), dim)
    return ids.join(means, "id", "left").select(
        "id", F.when(F.col("_0").isNull(), zero).otherwise(F.array(*[f"_{i}" for i in range(dim)])).alias("vector")
    )


def node_cosines(nodes: DataFrame, concept_vectors: DataFrame, mention_vectors: DataFrame) -> DataFrame:
    """``(mention_id, id, sim)``: cosine of each distinct pair of ``nodes(mention_id, id)`` whose vectors
    are known."""
    m = mention_vectors.select("mention_id", F.col("vector").alias("_mv"))
    return (
        balanced_join(nodes, concept_vectors.select("id", "vector"), "id", fanout=False)
        .join(m, "mention_id")
        .select("mention_id", "id", cosine("_mv", "vector").alias("sim"))
    )


def edge_cosine_score(cands: DataFrame, concept_vectors: DataFrame, mention_vectors: DataFrame) -> DataFrame:
    """Mean cosine of a mention with the parent and with the child of each edge.

    Each distinct (mention, node) pair is compared once; unknown nodes score 0.
    """
    nodes = cut_lineage(
        cands.select("mention_id", F.col("parent_idx").alias("id"))
        .unionByName(cands.select("mention_id", F.col("child_idx").alias("id"))).distinct()
    )
    return edge_scores(cands, node_cosines(nodes, concept_vectors, mention_vectors))


def edge_scores(cands: DataFrame, node_scores: DataFrame) -> DataFrame:
    """Edge score: mean of the parent's and the child's score for the mention, 0 if unknown."""
    s = cut_lineage(node_scores)
    p = s.select("mention_id", F.col("id").alias("parent_idx"), F.col("sim").alias("_p"))
    c = s.select("mention_id", F.col("id").alias("child_idx"), F.col("sim").alias("_c"))
    score = (F.coalesce("_p", F.lit(0.0)) + F.coalesce("_c", F.lit(0.0))) / 2
    return (
        cands.join(p, ["mention_id", "parent_idx"], "left").join(c, ["mention_id", "child_idx"], "left")
        .withColumn("score", F.round(score, DIGITS)).drop("_p", "_c")
    )


def edge_idf_score(cands: DataFrame, mentions: DataFrame, concepts: DataFrame, tokenizer=None) -> DataFrame:
    """Mean idf score of the parent and the child of each candidate edge."""
    postings = cut_lineage(build_postings(concepts, tokenizer))
    weighted = _idf_postings(postings, document_frequency(postings), concept_count(concepts))
    nodes = cut_lineage(_listed(weighted, "id", "pw", "_node"))
    terms = query_terms(mentions.select(F.col("mention_id").alias("q"), F.col("mention").alias("text")), tokenizer)
    # an edge takes the terms of its mention along and looks up both nodes: edges are shuffled once a look-up
    scored = cands.join(_listed(terms, "q", "qtf", "_q").withColumnRenamed("q", "mention_id"), "mention_id", "left")
    for end, score in (("parent_idx", "_p"), ("child_idx", "_c")):
        scored = scored.join(nodes.withColumnRenamed("id", end), end, "left")
        scored = scored.withColumn(score, F.coalesce(_overlap("_q", "_node"), F.lit(0.0))).drop("_node_tokens", "_node_values")
    return scored.select(*[c for c in cands.columns if c != "score"], F.round((F.col("_p") + F.col("_c")) / 2, DIGITS).alias("score"))


# -------------------------------------------------------------------- hooks

def encode(df: DataFrame, col: str, encoder=None, dim: int = 64, n: int = 3) -> DataFrame:
    """Add ``vector``: by ``encoder``, a function from a pandas Series of texts to a matrix,
    or by counting hashed character n-grams with Spark expressions."""
    if encoder is None:
        text = F.concat(F.lit(" "), F.lower(F.col(col)), F.lit(" "))

        def grams(t):
            return F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))),
                lambda i: F.pmod(F.crc32(F.substring(t, i, F.lit(n)).cast("binary")), F.lit(dim)),
            )

        def counted(g):
            return F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(g, lambda x: x == d)).cast("double")
            )

        # an argument of a lambda is worked out once, not once for each of its uses
        counts = F.get(F.transform(F.transform(F.array(text), grams), counted), F.lit(0))
        return df.withColumn("vector", counts)
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(vector=[list(map(float, r)) for r in encoder(pdf[col])])

    return df.mapInPandas(run, schema)


def score_with(df: DataFrame, scorer, cols: Sequence[str]) -> DataFrame:
    """Add ``score`` by ``scorer``, a function from pandas Series (one per column) to scores."""

    @F.pandas_udf(T.DoubleType())
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scorer(*series), dtype=float))

    return df.withColumn("score", run(*[F.col(c) for c in cols]))
