"""Readers of ontology, corpus and knowledge-base files.

``read_*`` opens files; the matching ``parse_*`` works on lines already in a DataFrame
``(file, line_no, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxograft.functions.text import decode_href, sentences, strip, words
from taxograft.operators.mentions import sample_n
from taxograft.plans.order import last_seen, running_sum
from taxograft.sources.lines import read_lines


# ------------------------------------------------------------------- catalogues

def parse_catalogue(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON lines as rows with their 0-based number over all files as ``row_id``."""
    return lines.where(strip("value") != "").select(
        F.col("row_no").alias("row_id"), F.from_json("value", schema).alias("r")
    ).select("row_id", "r.*")


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return parse_catalogue(read_lines(spark, path), schema)


def read_mentions(
    spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None,
    sample: int | None = None, seed: int = 1234,
) -> DataFrame:
    """Mention rows, all of them, the first ``limit``, or a seeded sample."""
    rows = read_catalogue(spark, path, schema)
    if limit is not None:
        rows = rows.where(F.col("row_id") < limit)
    if sample is not None:
        rows = sample_n(rows, sample, "row_id", seed)
    return rows


# ------------------------------------------------------------------ terminology

# fixed values: 0-based positions of the columns used in the pipe-delimited tables
RRF = {
    "names": {"cui": 0, "lang": 1, "aui": 7, "source": 11, "code": 13, "name": 14},
    "definitions": {"cui": 0, "definition": 5},
    "types": {"cui": 0, "type": 1},
    "hierarchy": {"cui": 0, "source": 4, "rel": 5, "path": 6},
}


def parse_rrf(lines: DataFrame, cols: dict[str, int]) -> DataFrame:
    """Columns of a pipe-delimited table by position, with ``file`` and ``line_no``."""
    parts = F.split("value", r"\|")
    return lines.select(
        "file", "line_no", *[F.get(parts, F.lit(i)).alias(name) for name, i in cols.items()]
    )


def read_rrf(spark: SparkSession, path: str, cols: dict[str, int]) -> DataFrame:
    return parse_rrf(read_lines(spark, path), cols)


def parse_rf2(lines: DataFrame) -> DataFrame:
    """Release history ``(id, effective_time, active, line_no)``; the header is skipped."""
    parts = F.split("value", "\t")
    return lines.where(F.col("line_no") > 0).select(
        F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("effective_time"),
        F.get(parts, F.lit(2)).alias("active"), "line_no",
    )


def read_rf2(spark: SparkSession, path: str) -> DataFrame:
    return parse_rf2(read_lines(spark, path))


# ---------------------------------------------------------------------- corpora

def pubtator_docs(blocks: DataFrame) -> DataFrame:
    """Documents ``(doc_id, text, spans)`` of blocks ``value``, those without spans too.

    A block has ``id|t|title``, ``id|a|abstract`` and one tab-separated line per span; the
    text is title and abstract joined by a blank.  Offsets must agree with the text.
    ``spans(start, end, mention, cui)`` stay with their text, which is met once.
    """
    lines = F.split(strip("value"), "\n")
    title = F.regexp_extract("value", r"(?md)^[^|\n]*\|t\|([^\n]*)$", 1)
    abstract = F.regexp_extract("value", r"(?md)^[^|\n]*\|a\|([^\n]*)$", 1)
    parts = F.filter(F.transform(lines, lambda x: F.split(x, "\t")), lambda p: F.size(p) >= 5)
    span = lambda p: F.struct(
        F.get(p, F.lit(1)).cast("int").alias("start"), F.get(p, F.lit(2)).cast("int").alias("end"),
        F.get(p, F.lit(3)).alias("mention"), F.regexp_replace(F.element_at(p, -1), "^UMLS:", "").alias("cui"),
    )
    return blocks.where(F.col("value").contains("|t|")).select(
        F.regexp_extract("value", r"^\s*([^|\s]+)\|t\|", 1).alias("doc_id"),
        F.concat_ws(" ", title, abstract).alias("text"), F.transform(parts, span).alias("spans"),
    )


def parse_pubtator(blocks: DataFrame) -> DataFrame:
    """One row per span ``(doc_id, text, start, end, mention, cui)`` of :func:`pubtator_docs`.

    The text is repeated for each span, as this format has it; with ``mentions.span_contexts``
    the documents give contexts without that.
    """
    return pubtator_docs(blocks).select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", "text", "s.*")


def read_pubtator(spark: SparkSession, path: str) -> DataFrame:
    return parse_pubtator(spark.read.option("lineSep", "\n\n").text(path))


def split_docs(spans: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of the documents on a split's id list ``(value)``."""
    wanted = ids.select(strip("value").alias(id_col)).distinct()
    return spans.join(wanted, id_col, "left_semi")


def parse_sieve(texts: DataFrame, annotations: DataFrame, n: int = 128) -> DataFrame:
    """Annotations ``(name, value)`` with the mention and contexts of their text ``(name, value)``."""
    line = annotations.select("name", F.explode(F.split(strip("value"), "\n")).alias("line"))
    p = F.split("line", r"\|\|")
    place = F.split(F.get(p, F.lit(1)), r"\|")
    spans = line.where(F.size(p) >= 5).select(
        "name", "line", F.get(place, F.lit(0)).cast("int").alias("start"), F.get(place, F.lit(1)).cast("int").alias("end"),
        F.get(p, F.lit(4)).alias("concept"),
    )
    from taxograft.operators.mentions import context_window

    docs = texts.select(F.col("name").alias("doc_id"), strip("value").alias("text"))
    return context_window(docs, spans.withColumnRenamed("name", "doc_id"), n)


def read_sieve(spark: SparkSession, folder: str, n: int = 128) -> DataFrame:
    """Folders of paired ``.txt`` and ``.concept`` files, paired by base name."""

    def whole(suffix: str) -> DataFrame:
        files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").text(folder)
        return files.select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"),
            F.regexp_replace("value", "^\ufeff", "").alias("value"),
        )

    return parse_sieve(whole(".txt"), whole(".concept"), n)


def number_tokens(lines: DataFrame) -> DataFrame:
    """Token lines with document, sentence and position.

    ``-DOCSTART- (name`` opens a document and a blank line ends a sentence, also an empty
    one.  Adds ``doc``, ``doc_no``, ``sent_id`` and ``pos`` to token lines.
    """
    is_doc = F.col("value").startswith("-DOCSTART-")
    blank = strip("value") == ""
    marked = lines.withColumns({"_doc": is_doc, "_blank": blank})
    x = running_sum(marked, ["file"], "line_no", F.col("_doc").cast("long"), "doc_no")
    x = running_sum(x, ["file"], "line_no", F.col("_blank").cast("long"), "_blanks")
    second = F.get(F.split("value", r"\s+"), F.lit(1))
    opening = F.struct(
        second.substr(F.lit(2), F.length(second)).alias("name"), F.col("_blanks").alias("base")
    )
    x = last_seen(x, ["file"], "line_no", F.when(F.col("_doc"), opening), "_open")
    x = last_seen(x, ["file"], "line_no", F.when(F.col("_doc") | F.col("_blank"), F.col("line_no")), "_mark")
    return x.where("NOT _doc AND NOT _blank").select(
        "file", "line_no", F.col("_open.name").alias("doc"), "doc_no",
        (F.col("_blanks") - F.col("_open.base")).alias("sent_id"),
        (F.col("line_no") - F.col("_mark") - 1).alias("pos"), F.split("value", "\t").alias("parts"),
    )


def parse_conll(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens and mention spans of a token-per-line file.

    Six or more columns make a token part of a mention: ``I`` continues the one before,
    anything else starts a new one with the link in the fifth column.
    """
    t = number_tokens(lines)
    tokens = t.select("file", "line_no", "doc", "sent_id", "pos", F.get("parts", F.lit(0)).alias("token"))
    part = t.where(F.size("parts") >= 6).withColumn("_new", (F.get("parts", F.lit(1)) != "I").cast("long"))
    part = running_sum(part, ["file"], "line_no", F.col("_new"), "mention_no")
    spans = part.groupBy("file", "doc", "mention_no").agg(
        F.min_by("sent_id", "line_no").alias("sent_id"), F.min_by("pos", "line_no").alias("start"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.get("parts", F.lit(4)), "line_no").alias("wikilink"),
    )
    return tokens, spans.withColumn("end", F.col("start") + F.col("_n")).drop("_n")


def read_conll(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_conll(read_lines(spark, path))


def parse_candidates_tsv(lines: DataFrame) -> DataFrame:
    """Mentions with pre-generated candidates ``(title, prior)`` and the gold title."""
    p = F.split(F.col("value"), "\t")
    title = lambda parts, skip: F.replace(
        F.replace(F.array_join(F.slice(parts, F.lit(skip + 1), F.greatest(F.size(parts) - skip, F.lit(0))), ","), F.lit('"'), F.lit("%22")), F.lit(" "), F.lit("_")
    )
    tail = F.when(F.get(p, F.lit(6)) == "EMPTYCAND", F.array().cast("array<string>")).otherwise(
        F.slice(p, F.lit(7), F.greatest(F.size(p) - 8, F.lit(0)))
    )
    cands = F.transform(
        F.transform(tail, lambda c: F.split(c, ",")),
        lambda c: F.struct(title(c, 2).alias("title"), F.get(c, F.lit(1)).cast("double").alias("prior")),
    )
    gold = F.split(F.element_at(p, -1), ",")
    return lines.select(
        "file", "line_no", F.concat_ws(" ", F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("doc"),
        F.get(p, F.lit(2)).alias("mention"), F.get(p, F.lit(3)).alias("context_left"), F.get(p, F.lit(4)).alias("context_right"),
        cands.alias("candidates"),
        F.when(F.get(gold, F.lit(0)) == "-1", title(gold, 2)).otherwise(title(gold, 3)).alias("gold"),
    )


def read_candidates_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_candidates_tsv(read_lines(spark, path))


def parse_sentences(lines: DataFrame, one_per_line: bool = True) -> DataFrame:
    """Sentences ``(file, line_no, pos, sentence)``.

    Otherwise each line is taken as running text and cut after sentence marks.
    """
    kept = lines.where(strip("value") != "")
    if one_per_line:
        return kept.select("file", "line_no", F.lit(0).alias("pos"), strip("value").alias("sentence"))
    return kept.select("file", "line_no", F.posexplode(sentences("value")).alias("pos", "sentence"))


def read_sentences(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    return parse_sentences(read_lines(spark, path), one_per_line)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt and answer table written as CSV with quoted line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def parse_worlds(docs: DataFrame, domains: DataFrame, split: str, width: int = 256) -> DataFrame:
    """Documents ``(domain, text, ...)`` of the domains assigned to a split, text cut."""
    wanted = domains.where(F.col("split") == split).select("domain").distinct()
    return docs.join(wanted, "domain", "left_semi").withColumn("text", F.substring("text", 1, width))


def read_worlds(spark: SparkSession, folder: str, domains: DataFrame, split: str) -> DataFrame:
    """One JSON-lines file per domain, named after it."""
    schema = "document_id string, title string, text string"
    docs = spark.read.schema(schema).json(folder).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("domain"), "document_id", "title", "text"
    )
    return parse_worlds(docs, domains, split)


# --------------------------------------------------------------- knowledge base

_TEXT = T.StructType([T.StructField("value", T.StringType())])
_TITLE = T.StructType([T.StructField("title", T.StringType())])
ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("sitelinks", T.StructType([T.StructField("enwiki", _TITLE), T.StructField("enwikiquote", _TITLE)])),
        T.StructField("aliases", T.StructType([T.StructField("en", T.ArrayType(_TEXT))])),
        T.StructField("labels", T.StructType([T.StructField("en", _TEXT)])),
        T.StructField("descriptions", T.StructType([T.StructField("en", _TEXT)])),
    ]
)


def parse_wikidata(lines: DataFrame) -> DataFrame:
    """Items with an English page from dump lines ``value``; anything unreadable drops out."""
    item = F.from_json(F.regexp_replace(strip("value"), ",$", ""), ITEM)
    rows = lines.select(item.alias("i")).where("i.id IS NOT NULL AND i.sitelinks.enwiki.title IS NOT NULL")
    return rows.select(
        F.col("i.id").alias("item_id"), F.col("i.sitelinks.enwiki.title").alias("title"),
        F.transform("i.aliases.en", lambda a: a["value"]).alias("aliases"),
        F.col("i.labels.en.value").alias("label"), F.col("i.descriptions.en.value").alias("description"),
        F.col("i.sitelinks.enwikiquote.title").alias("quote_title"),
    )


def read_wikidata(spark: SparkSession, path: str) -> DataFrame:
    return parse_wikidata(spark.read.text(path))


def _plain(c):
    """Attribute text without entity escapes."""
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def parse_docs(texts: DataFrame, part: str = "intro") -> DataFrame:
    """Documents from ``<doc ...>`` blocks ``value`` (without the closing tag).

    ``intro`` keeps the lines before the first section heading; ``full`` keeps all lines
    and counts tokens by single blanks.
    """
    head = lambda a: _plain(F.regexp_extract("value", rf'<doc [^>]*?{a}="(.*?)"', 1))
    body = F.regexp_replace("value", r"(?s)^.*?<doc [^>]*>\n?", "")
    lines = F.transform(F.split(F.regexp_replace(body, r"\n$", ""), "\n"), lambda x: strip(x))
    docs = texts.where(F.col("value").contains("<doc ")).select(
        head("id").alias("id"), head("title").alias("title"), head("url").alias("url"), lines.alias("lines")
    )
    if part == "intro":
        cut = F.array_position(F.transform("lines", lambda x: x.startswith("Section::::")), True)
        return docs.withColumn("lines", F.when(cut > 0, F.slice("lines", F.lit(1), cut.cast("int") - 1)).otherwise(F.col("lines")))
    if part == "full":
        return docs.withColumn("num_tokens", F.size(words(F.array_join("lines", " "))))
    raise ValueError(part)


def read_docs(spark: SparkSession, path: str, part: str = "intro") -> DataFrame:
    return parse_docs(spark.read.option("lineSep", "</doc>").text(path), part)


def extract_links(docs: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Links ``(keep..., pos, href, text)`` with percent-decoded targets."""
    pattern = F.lit(r"<a href=([^>]+)>([^\n]*?)</a>")
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, pattern, 1).alias("h"), F.regexp_extract_all(html, pattern, 2).alias("t")
    )
    return docs.select(*keep, F.posexplode(pairs).alias("pos", "l")).select(
        *keep, "pos", decode_href(F.regexp_replace("l.h", '^"|"$', "")).alias("href"), strip("l.t").alias("text")
    )


def read_mapping(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title and page-id maps from a table ``(page_id, title, item_id)``, e.g. over JDBC."""
    known = table.where(F.col("item_id").isNotNull())
    return known.select("title", "item_id").distinct(), known.select("page_id", "item_id").distinct()
