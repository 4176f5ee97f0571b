"""License scans by ordered signature rules, in DataFrame functions only.

A text is first brought to its words, joined by single spaces.  A rule is a regular expression
over that form with keywords, a label and a priority.  Every match of a rule has one of its
keywords as a word, so only rules with a keyword among the words of a text are tried on it.  A detection is suppressed when its
interval of words lies inside that of a detection of the same or a better priority; among
detections of one interval, the earlier rule wins.  Base rules are reported before suppression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxograft.llm.common import let
from taxograft.plans.lineage import cut_lineage


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    label: str
    priority: int
    base: bool = False
    #: Further keywords, where the alternatives of the pattern have no word in common.
    also: tuple[str, ...] = ()

    @property
    def keywords(self) -> tuple[str, ...]:
        return self.keyword, *self.also


#: Confidence of a detection by priority: identifiers, titles with a version, titles, mentions.
CONFIDENCE = (1.0, 0.9, 0.75, 0.5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: fixed value of the contract, A-Z being lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = (
    Rule("cc", "cc by", "cc-by", 3, True),
    Rule("license", "general public license", "gpl", 3, True),
    Rule("reserved", "all rights reserved", "reserved", 3, True),
)

# Hand-written families.  ``title`` is a pattern of the full name, ``key`` has the words of which
# it always has one, ``ids`` the words of the short identifier, ``versions`` the versions in use.
FAMILIES = (
    # label, title, key, ids, versions
    ("apache", "apache (?:software )?licen[sc]e", "apache", "apache", ("1 0", "1 1", "2 0")),
    ("gpl", "(?:gnu )?general public licen[sc]e", "general", "gpl", ("1 0", "2 0", "3 0")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "general", "lgpl", ("2 0", "2 1", "3 0")),
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "affero", "agpl", ("1 0", "3 0")),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "documentation", "gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", "mozilla public licen[sc]e", "mozilla", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public licen[sc]e", "eclipse", "epl", ("1 0", "2 0")),
    ("eupl", "european union public licen[sc]e", "european", "eupl", ("1 0", "1 1", "1 2")),
    ("cddl", "common development and distribution licen[sc]e", "distribution", "cddl", ("1 0", "1 1")),
    ("cpl", "common public licen[sc]e", "common", "cpl", ("1 0",)),
    ("osl", "open software licen[sc]e", "open", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", "academic free licen[sc]e", "academic", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic licen[sc]e", "artistic", "artistic", ("1 0", "2 0")),
    ("bsl", "boost software licen[sc]e", "boost", "bsl", ("1 0",)),
    ("cecill", "cecill(?: free software)? licen[sc]e", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("lppl", "latex project public licen[sc]e", "latex", "lppl", ("1 0", "1 1", "1 2", "1 3c")),
    ("zpl", "zope public licen[sc]e", "zope", "zpl", ("1 1", "2 0", "2 1")),
    ("ofl", "(?:sil )?open font licen[sc]e", "font", "ofl", ("1 0", "1 1")),
    ("odbl", "open (?:data commons open )?database licen[sc]e", "database", "odbl", ("1 0",)),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft", "ms pl", ()),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft", "ms rl", ()),
    ("python", "python (?:software foundation )?licen[sc]e", "python", "psf", ("2 0",)),
    ("php", "php licen[sc]e", "php", "php", ("3 0", "3 01")),
    ("w3c", "w3c software (?:notice and )?licen[sc]e", "w3c", "w3c", ()),
    ("ncsa", "(?:university of illinois )?ncsa open source licen[sc]e", "ncsa", "ncsa", ()),
    ("isc", "isc licen[sc]e", "isc", "isc", ()),
    ("mit", "(?:mit|expat|x11) licen[sc]e", "mit expat x11", "mit", ()),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", "zlib", ()),
    ("unlicense", "the unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "public", "wtfpl", ("1 0", "2 0")),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e", "bsd", "bsd 2 clause", ()),
    ("bsd-3-clause", "(?:new|revised|modified|3 clause|three clause) bsd licen[sc]e", "bsd", "bsd 3 clause", ()),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd licen[sc]e", "bsd", "bsd 4 clause", ()),
    ("sspl", "server side public licen[sc]e", "server", "sspl", ("1 0",)),
    ("busl", "business source licen[sc]e", "business", "busl", ("1 1",)),
    ("openrail", "(?:open|responsible) (?:rail|ai) licen[sc]e", "ai rail", "openrail", ()),
)

# Elements of the Creative Commons licences, as words of the short and of the long name.
CREATIVE = (
    ("by", "attribution"),
    ("by-sa", "attribution share ?alike"),
    ("by-nc", "attribution non ?commercial"),
    ("by-nd", "attribution no ?deriv(?:s|atives|ative works)"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
)
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Notices without a licence name.
NOTICES = (
    Rule("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", 0),
    Rule("redistribution", "redistribution and use in source and binary forms with or without modification", "bsd", 0),
    Rule("permission", "permission to use copy modify and or distribute this software for any purpose", "isc", 0),
    Rule("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0", 1),
    Rule("domain", "(?:released|dedicated|placed)? ?(?:in|into|to) the public domain", "public-domain", 2),
    Rule("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", 3),
    Rule("copyright", "(?:this|the) (?:work|text|file|article) is (?:protected by )?copyright(?:ed)?", "copyright", 3, also=("copyrighted",)),
    Rule("permission", "(?:reproduced|reprinted|used) (?:with|by) permission", "permission", 2),
    Rule("permission", "(?:may|must) not be (?:copied|reproduced|distributed|republished)[a-z0-9 ]{0,60}? without (?:the )?(?:prior )?(?:written )?(?:permission|consent)", "reserved", 2, also=("consent",)),
    Rule("reserved", "(?:some|no) rights reserved", "some-rights", 2),
    Rule("droits", "tous droits réservés", "reserved", 2),
    Rule("rechte", "alle rechte vorbehalten", "reserved", 2),
    Rule("derechos", "todos los derechos reservados", "reserved", 2),
    Rule("proprietary", "proprietary and confidential", "proprietary", 1),
    Rule("spdx", "spdx license identifier [a-z0-9]+(?: [0-9][0-9a-z]*){0,3}", "spdx", 2),
)


def rules() -> list[Rule]:
    """All rules in order: base, identifiers, titles with a version, titles, notices."""
    out = list(BASE)
    for label, title, key, ids, versions in FAMILIES:
        number = {v: v.replace(" ", ".") for v in versions}
        key, *also = key.split(" ")
        also = tuple(also)
        for v in versions:
            short = v.removesuffix(" 0")
            said = f"(?:v|version |v )?{v}" if short == v else f"(?:v|version |v )?{short}(?: 0)?"
            first = ids.split(" ")[0]
            # the version may be joined to an identifier of one word: gplv3, gpl3
            glued = tuple(f"{ids}{x}{v.split(' ')[0]}" for x in ("", "v")) if first == ids else ()
            later = " (?:or later|or any later version|or at your option any later version)"
            out.append(Rule("spdx", f"spdx license identifier {ids} {v}(?: only| or later)?", f"{label}-{number[v]}", 0))
            out.append(Rule(first, f"{ids} (?:v)?{v}(?: only| or later)?", f"{label}-{number[v]}", 1))
            out.append(Rule(key, f"{title} {said}", f"{label}-{number[v]}", 1, also=also))
            out.append(Rule(key, f"{title} {said}{later}", f"{label}-{number[v]}+", 0, also=also))
            out.append(Rule(first, f"{ids} ?v?{short}(?: 0)?\\+?{later}", f"{label}-{number[v]}+", 0, also=glued))
        out.append(Rule("spdx", f"spdx license identifier {ids}", label, 1))
        out.append(Rule(key, title, label, 2, also=also))
        out.append(Rule(ids.split(" ")[0], f"{ids} licen[sc]ed?", label, 2))
    for short, long in CREATIVE:
        words = short.replace("-", " ")
        for v in CREATIVE_VERSIONS:
            dotted = v.replace(" ", ".")
            said = v if not v.endswith(" 0") else f"{v[0]}(?: 0)?"
            out.append(Rule("cc", f"cc {words} {said}(?: (?:international|unported|generic))?", f"cc-{short}-{dotted}", 1))
            out.append(Rule("creative", f"creative commons {long}(?: (?:international|unported|generic))? (?:licen[sc]e )?{said}(?: (?:international|unported|generic))?(?: licen[sc]e)?", f"cc-{short}-{dotted}", 1))
            out.append(Rule("creativecommons", f"creativecommons org licen[sc]es {words} {v}", f"cc-{short}-{dotted}", 0))
        out.append(Rule("cc", f"cc {words}", f"cc-{short}", 2))
        out.append(Rule("creative", f"creative commons {long}", f"cc-{short}", 2))
        out.append(Rule("creativecommons", f"creativecommons org licen[sc]es {words}", f"cc-{short}", 1))
    return out + list(NOTICES)


def words_of(text: Column) -> Column:
    """`` w0 w1 ... `` with one space before each word and one at the end; one space if none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.translate(x, " ", ""))


def detections(docs: DataFrame, table: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(row, doc_id, n_words)`` of each row and ``(row, rule, start, end)`` of each match,
    in words from 0, ``end`` exclusive."""
    keywords = sorted({k for r in table for k in r.keywords})
    known = F.array(*(F.lit(k) for k in keywords))
    listed = F.array(*(
        F.struct(F.lit(i).alias("rule"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"))
        for i, r in enumerate(table)
    ))

    def tried(form: Column, rule: Column) -> Column:
        # between two matches only spaces are counted; a match is known by its number of words
        return F.struct(
            rule["rule"].alias("rule"),
            F.transform(F.split(form, rule["pattern"], -1), _spaces).alias("gaps"),
            F.transform(F.regexp_extract_all(form, rule["pattern"], F.lit(0)), lambda m: _spaces(m) + 1).alias("lengths"),
        )

    def scan(form: Column) -> Column:
        return let(F.filter(F.split(form, " "), lambda w: w != ""), lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            let(F.array_intersect(words, known), lambda met: F.when(F.size(met) > 0, F.filter(
                F.transform(F.filter(listed, lambda r: F.arrays_overlap(met, r["keywords"])), lambda r: tried(form, r)),
                lambda t: F.size(t["lengths"]) > 0,
            ))).alias("hits"),
        ))

    scanned = cut_lineage(
        docs.select(F.col("doc_id").cast("long"), let(words_of(F.col("text")), scan).alias("s"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "s.n_words", "s.hits")
    )
    one = scanned.select("row", F.explode("hits").alias("h")).select(
        "row", "h.rule", F.posexplode(F.arrays_zip(F.slice("h.gaps", 1, F.size("h.lengths")).alias("gap"), F.col("h.lengths").alias("length")))
    ).select("row", "rule", "pos", F.col("col.gap").alias("gap"), F.col("col.length").alias("length"))
    # a gap has one space more than words; the words before a match are those of all earlier gaps and matches
    before = W.partitionBy("row", "rule").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ended = F.sum(F.col("gap") - 1 + F.col("length")).over(before)
    found = one.select("row", "rule", ended.alias("end"), "length").select(
        "row", "rule", (F.col("end") - F.col("length")).alias("start"), "end"
    )
    return scanned.select("row", "doc_id", "n_words"), found


def survivors(found: DataFrame, table: list[Rule]) -> DataFrame:
    """Adds ``priority`` and ``suppressed`` to detections by interval containment.

    Sorted by start, then longest, then priority and rule, whatever contains a detection comes
    before it; so it is contained exactly if the largest end so far, among detections of its
    priority or a better one, reaches its own end.
    """
    priority = F.element_at(F.array(*(F.lit(r.priority) for r in table)), F.col("rule") + 1)
    df = found.withColumn("priority", priority)
    order = W.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(W.unboundedPreceding, -1)
    levels = range(max(r.priority for r in table) + 1)
    df = df.select("*", *(F.max(F.when(F.col("priority") <= k, F.col("end"))).over(order).alias(f"reach{k}") for k in levels))
    reach = F.element_at(F.array(*(F.col(f"reach{k}") for k in levels)), F.col("priority") + 1)
    return df.select("row", "rule", "start", "end", "priority", F.coalesce(reach >= F.col("end"), F.lit(False)).alias("suppressed"))


def scan_licenses(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_found (detections that survive).

    Whole texts are read, null as empty.  ``labels`` joins the base labels and those of the
    surviving detections; ``score`` is the confidence of the best of these, 0 without any.
    Ids may be null or repeated; other columns are ignored.
    """
    table = table or rules()
    docs_, found = detections(docs, table)
    label = F.element_at(F.array(*(F.lit(r.label) for r in table)), F.col("rule") + 1)
    base = F.element_at(F.array(*(F.lit(r.base) for r in table)), F.col("rule") + 1)
    sure = F.element_at(F.array(*(F.lit(c) for c in CONFIDENCE)), F.col("priority") + 1)
    kept = ~F.col("suppressed")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_row = (
        survivors(found, table).withColumn("label", label).withColumn("base", base)
        .groupBy("row").agg(
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            joined(F.when(F.col("base") | kept, F.col("label"))).alias("labels"),
            F.max(F.when(F.col("base") | kept, sure)).alias("score"),
            F.count(F.when(kept, 1)).alias("n_found"),
        )
    )
    zero = F.lit(0).cast("long")
    return docs_.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_found", zero).alias("n_found"),
    )
