"""String expressions: cleaning, windows over tokens, sequence assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def tokenize(col: Column | str, tokenizer=None) -> Column:
    """Tokens of a text: lower-case words by default, or whatever ``tokenizer`` maps to."""
    if tokenizer is not None:
        return tokenizer(_c(col))
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(r"([\p{L}\p{N}_#]+)"), 1)


def words(col: Column | str) -> Column:
    """Tokens by single spaces."""
    return F.split(_c(col), " ")


# fixed values: marks that synonym cleaning removes
AMBIGUOUS = "[ambiguous]"
RETIRED = "-retired"
VAGUE = ("unspecified", "nos")


def clean_synonym(col: Column | str, compat: bool = False) -> Column:
    """Normalised synonym, or null when nothing is left.

    Lower case; without the ambiguity mark, a leading one-letter bracket, a trailing
    parenthesis, a retirement suffix, vague words and a trailing comma.  ``compat`` drops
    the vague words inside longer words too.
    """
    s = F.trim(F.replace(F.lower(_c(col)), F.lit(AMBIGUOUS), F.lit("")))
    s = F.regexp_replace(s, r"^\[[^\]]\]", "")
    s = F.when(s.endswith(")"), F.trim(F.regexp_replace(s, r"\([^(]*$", ""))).otherwise(s)
    s = F.substring_index(s, RETIRED, 1)
    for word in VAGUE:
        s = F.regexp_replace(s, word if compat else rf"\b{word}\b", "")
    s = F.regexp_replace(F.trim(s), ",$", "")
    return F.when(s != "", s)


def escape_query(col: Column | str) -> Column:
    """Backslash the special characters of a search query and lower-case bare AND/OR."""
    s = F.regexp_replace(_c(col), r"(?<=^|\s)OR(?=\s|$)", "or")
    s = F.regexp_replace(s, r"(?<=^|\s)AND(?=\s|$)", "and")
    return F.regexp_replace(s, r"(?<!\\)([&|+\-!(){}\[\]/^\"~*?:])", r"\\$1")


def decode_href(col: Column | str) -> Column:
    """Percent-decoding that leaves ``+`` alone and malformed text as it is."""
    c = _c(col)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def sentences(col: Column | str) -> Column:
    """Sentences of a text: cut after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.split(F.trim(_c(col)), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: s != "")


def first_sentences(lines: Column | str, n: int = 10) -> Column:
    """First ``n`` sentences of a document's lines.

    The first line is the title and is skipped, as are section headings and blanks.
    """
    body = F.slice(_c(lines), F.lit(2), F.size(_c(lines)))
    kept = F.filter(body, lambda x: ~x.startswith("Section::") & (x != ""))
    return F.slice(sentences(F.array_join(F.transform(kept, lambda x: F.trim(x)), " ")), 1, n)


def last_n(arr: Column, n: Column | int) -> Column:
    """The last ``n`` entries, or all of a shorter array."""
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.least(F.greatest(n, F.lit(0)), F.size(arr))
    return F.slice(arr, F.size(arr) - keep + 1, keep)


def first_n(arr: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(arr, F.lit(1), F.least(F.greatest(n, F.lit(0)), F.size(arr)))


def budget_window(left: Column, mention: Column, right: Column, n: int) -> Column:
    """Token window of at most ``n - 2`` tokens around a mention.

    Both sides get half of what the mention leaves; a side that needs less lends the
    rest to the other one; the mention is cut only when it alone exceeds the budget.
    """
    m = F.size(mention)
    left_half = F.floor((F.lit(n) - m) / 2).cast("int") - 1
    right_half = F.lit(n) - m - left_half - 2
    left_quota = F.when(
        (F.size(left) > left_half) & (F.size(right) <= right_half), left_half + right_half - F.size(right)
    ).otherwise(left_half)
    right_quota = F.when(
        (F.size(left) <= left_half) & (F.size(right) > right_half), right_half + left_half - F.size(left)
    ).otherwise(right_half)
    kept = m + F.least(left_quota, F.lit(0)) + F.least(right_quota, F.lit(0))
    return F.concat(last_n(left, left_quota), first_n(mention, kept), first_n(right, right_quota))


def candidate_text(
    title: Column, synonyms: Column, text: Column, n: int,
    title_tag: str = "[TITLE]", synonym_tag: str = "[SYN]",
) -> Column:
    """Candidate tokens: title, tag, each synonym with its tag, description; cut to n - 2."""
    syn = F.flatten(F.transform(synonyms, lambda s: F.concat(words(s), F.array(F.lit(synonym_tag)))))
    described = F.filter(words(text), lambda w: w != "")
    whole = F.concat(words(title), F.array(F.lit(title_tag)), syn, described)
    return first_n(whole, n - 2)


def edge_candidate_text(
    parent: Column, child: Column, n: int, top: str = "THING", null: str = "NULL",
    tags: tuple[str, str, str] = ("[PARENT]", "[CHILD]", "[TITLE]"), ends: tuple[str, str] = ("[TOP]", "[BOTTOM]"),
) -> Column:
    """Edge tokens: parent, tag, child, tag, closing tag; the virtual nodes become marks."""
    p = F.when(parent == top, F.array(F.lit(ends[0]))).otherwise(words(parent))
    c = F.when(child == null, F.array(F.lit(ends[1]))).otherwise(words(child))
    return first_n(
        F.concat(p, F.array(F.lit(tags[0])), c, F.array(F.lit(tags[1]), F.lit(tags[2]))), n - 2
    )


def pair_sequence(context: Column, candidate: Column, n: int) -> Column:
    """Context followed by the candidate without its first token, cut to ``n``."""
    return first_n(F.concat(context, F.slice(candidate, F.lit(2), F.size(candidate))), n)


def truncate_pair(a: Column, b: Column, n: int) -> Column:
    """Both sequences cut to ``n`` tokens in total, always shortening the longer one."""
    over = F.size(a) + F.size(b) > n
    keep_a = F.least(F.size(a), F.greatest(F.lit((n + 1) // 2), F.lit(n) - F.size(b)))
    return F.struct(
        F.when(over, first_n(a, keep_a)).otherwise(a).alias("a"),
        F.when(over, first_n(b, F.lit(n) - keep_a)).otherwise(b).alias("b"),
    )


def short_context(left: Column, mention: Column, right: Column, k: int) -> Column:
    """Query text: the mention with up to ``k`` words of context on each side."""
    side = lambda c: F.filter(words(c), lambda w: w != "")
    return F.concat_ws(
        " ", F.array_join(last_n(side(left), k), " "), mention, F.array_join(first_n(side(right), k), " ")
    )


def span_context(sentence: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Text left and right of a character span."""
    left = F.substring(sentence, F.lit(1), start)
    right = F.substring(sentence, end + 1, F.length(sentence))
    return F.trim(left), F.trim(right)


def annotated_text(mention: Column, start: Column, end: Column, candidate: Column, prob: Column) -> Column:
    """One line about a linked mention; ``candidate`` is null when none was selected."""
    place = F.format_string("%s (%d, %d) - ", mention, start, end)
    return F.concat(
        place,
        F.when(candidate.isNull(), "No candidate selected").otherwise(
            F.format_string("%s (conf. %.5f)", candidate, F.bround(prob, 5))
        ),
    )
