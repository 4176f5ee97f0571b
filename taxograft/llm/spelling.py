"""Spelling variants by permuterm rotations.

A word is marked with a terminator and rotated to every position.  Where two words differ by one
code point, the rotations that begin right after it agree up to it: a replaced code point is the
last one of both rotations, an inserted one the last of a rotation whose rest is a whole
rotation of the shorter word.  So every rotation is filed under its prefix without the last code
point, and every whole rotation under itself; after sorting, the words of one prefix are
neighbours of each other.  Such a group holds one word for each code point that can be skipped,
so its size is bounded by the alphabet, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograft.plans.lineage import cut_lineage

MARK = "$"
RUN = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point, chosen by the checksum of document and run.
EVERY = 199


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run without the code point that its checksum names, if the checksum names one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % EVERY == 0, shorter).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """Words ``(word, n)`` of all whole texts: letter runs, A-Z lower-cased, some of them misspelt.

    Only words of ``min_length`` code points or more that occur ``min_count`` times or more.  A
    null text has no words, a null doc_id counts as an empty one in the checksum.  Counting
    starts before the shuffle, so a frequent word is one row a task.
    """
    runs = F.split(F.translate("text", _UPPER, _LOWER), f"[^{RUN}]+")
    found = docs.select("doc_id", F.explode(runs).alias("run")).where(F.length("run") >= min_length)
    words = found.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """``(prefix, skipped, at, n)`` of every rotation of ``words(word, n)``.

    ``prefix`` is the rotation without the code point ``skipped`` that stood ``at`` (from 0) in the
    word; a whole rotation is its own prefix and skips nothing.
    """
    size = F.length("word")
    at = F.explode(F.sequence(F.lit(0), size)).alias("at")
    turned = words.select("word", "n", at)

    def part(start: Column) -> Column:
        return F.concat(F.substring("word", start + 1, size), F.lit(MARK), F.substring("word", F.lit(1), F.col("at")))

    skipped = F.substring("word", F.col("at") + 1, F.lit(1))
    # of equal code points in a row only the first one stands for an insertion
    first = (F.col("at") == 0) | (F.substring("word", F.col("at"), F.lit(1)) != skipped)
    both = F.array(
        F.struct(part(F.col("at")).alias("prefix"), F.lit(None).cast("string").alias("skipped"), F.lit(True).alias("first")),
        F.struct(part(F.col("at") + 1).alias("prefix"), skipped.alias("skipped"), first.alias("first")),
    )
    # behind the last code point there is nothing to skip
    filed = F.explode(F.when(F.col("at") < size, both).otherwise(F.slice(both, 1, 1)))
    return turned.select(filed.alias("r"), "at", "n").select("r.*", "at", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs ``(word, near, near_n)``, both ways, of words one code point apart.

    Each pair comes from one prefix only: a replacement from the prefix that skips it, an
    insertion into a run of equal code points from the first of them.
    """
    member = F.struct("skipped", "first", "n")
    groups = (
        rotations(words).groupBy("prefix", "at").agg(F.sort_array(F.collect_list(member)).alias("group"))
        .where(F.size("group") > 1)
    )
    pairs = groups.select("prefix", "at", F.explode("group").alias("a"), "group").select(
        "prefix", "at", "a", F.explode("group").alias("b")
    )
    one, other = F.col("a.skipped"), F.col("b.skipped")
    inserted = (one.isNull() & F.col("b.first")) | (other.isNull() & F.col("a.first"))
    # a null skips nothing: there is only one whole rotation in a group
    different = F.when(one.isNull() | other.isNull(), inserted & (one.isNull() != other.isNull())).otherwise(one != other)
    mark = F.locate(MARK, F.col("prefix"))

    def word(skipped: Column) -> Column:
        head = F.substring("prefix", mark + 1, F.length("prefix"))
        return F.concat(head, F.coalesce(skipped, F.lit("")), F.substring("prefix", F.lit(1), mark - 1))

    return pairs.where(different).select(word(one).alias("word"), word(other).alias("near"), F.col("b.n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: where following the forms ends.

    Forms lead to ever more frequent words, so there are no circles; every round doubles the
    steps taken.
    """
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        met = cut_lineage(at.join(further, "root", "left").select("word", F.coalesce("_to", "root").alias("root"), "_to"))
        at = met.select("word", "root")
        if met.where("_to IS NOT NULL").limit(1).count() == 0:
            return at


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``.

    The form is the most frequent near word (of equals the smallest in code-point order) if it is
    ``ratio`` times as frequent as the word, else null; the root is where forms lead.  Words are
    distinct and not null; a word with the terminator ``$`` in it cannot be rotated.  No words
    give no rows.
    """
    words = cut_lineage(words.select("word", "n"))
    best = neighbours(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    far = -F.col("best.less")
    rare = far >= ratio * F.col("n")
    formed = cut_lineage(words.join(best, "word", "left").select(
        "word", F.when(rare, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(rare, far).alias("form_n"),
    ))
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """Words of ``docs(doc_id, text)`` grouped with their more frequent neighbours.

    Null and empty texts have no words, repeated rows count again, ids may be null or repeated, a
    very long text is split in one row; other columns are ignored and a table without words
    gives no rows.
    """
    return group_variants(word_counts(docs, min_length, min_count), ratio)


#: The same words and forms, by deleting and masking each code point; the checksum is the
#: reflected polynomial 0xEDB88320 taken bit by bit.
SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) r(i))),
coded AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, flatten([CASE WHEN u < 128 THEN [u] ELSE [195, u - 64] END
    FOR u IN [CAST(unicode(x) AS BIGINT) FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]])),
    lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS h
  FROM counted, crc_table),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM coded),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut, left(word, i) || '_' || substr(word, i + 2) AS masked
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON cut = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON cut = w.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
    CASE WHEN top >= 5 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND near_n = top) END AS form
  FROM w LEFT JOIN b USING (word)),
r(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r USING (word)
"""
