"""Question texts about edges and the answers read back from generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxograft.functions.arrays import let
from taxograft.functions.text import strip
from taxograft.model import Sentinels

NAMES = Sentinels()

# fixed values: wording of the questions and the marks of the answer formats
PAIR_QUESTION = (
    'Considering %s (marked with asterisk) in the context below: "%s *%s* %s" '
    "Is %s a {relation} of %s? Please answer briefly with yes or no."
)
EDGE_QUESTION = (
    "Can you identify the correct ontological edges for the given mention based on the provided "
    "context (context_left and context_right)? The ontological edge consists of a pair where the "
    "left concept represents the parent of the mention, and the right concept represents the child "
    "of the mention. If the mention is a leaf node, the right side of the edges will be NULL "
    "({null}). If the context is not relevant to the options, make your decision solely based on "
    "the mention itself. There may be multiple correct options. Please answer briefly using option "
    "numbers, separated by a colon. If none of the options is correct, please answer None."
)
EDGE_LAYOUT = "%s\n\ncontext_left:\n%s\n\nmention:\n%s\n\ncontext_right:\n%s\n\noptions:\n%s"
WORDING = ("separated by a colon", "separated by commas")
JOINED_TASK = (
    "mention based on the provided context (context_left and context_right)?",
    "mention (marked with *) based on the context?",
)
JOINED_MARKS = (
    ("context_left:", "mention in context:"),
    ("\n\nmention:\n", "*"),
    ("\n\ncontext_right:\n", "*"),
)
RESPONSE_MARK = "### Response:"
FINAL_PHRASE = "the final answers are"
END_TAG = "</s>"
REASONING = (
    "From the parents in the options above, including %s, the correct parents of the mention, %s, "
    "include %s. Thus the options are narrowed down to %s. From the children in the narrowed "
    "options, including %s, the correct children of the mention, %s, include %s. Thus, the final "
    "answers are %s."
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def edge_text(parent, parent_idx, child, child_idx, degree=None) -> Column:
    """Readable form of an edge, with its degree if given."""
    base = F.format_string("%s (%s) -> %s (%s)", _c(parent), _c(parent_idx), _c(child), _c(child_idx))
    if degree is None:
        return base
    return F.concat(base, F.format_string(", degree %d", _c(degree)))


def pair_prompts(mention, left, right, parent, child, names: Sentinels = NAMES) -> tuple[Column, Column]:
    """Yes/no questions for the parent and the child side, empty for the virtual nodes."""
    m, l, r = _c(mention), _c(left), _c(right)
    parent, child = _c(parent), _c(child)

    def ask(relation: str, other: Column) -> Column:
        return F.format_string(PAIR_QUESTION.replace("{relation}", relation), m, l, m, r, m, other)

    return (
        F.when(parent != names.top_title, ask("child", parent)).otherwise(""),
        F.when(child != names.null_title, ask("parent", child)).otherwise(""),
    )


def edge_prompt(mention, left, right, options: Column | str, null: str = NAMES.null) -> Column:
    """Multi-option question; ``options`` is an array of edge texts in rank order."""
    numbered = F.transform(
        _c(options), lambda x, i: F.concat(i.cast("string"), F.lit("."), x)
    )
    return F.format_string(
        EDGE_LAYOUT, F.lit(EDGE_QUESTION.replace("{null}", null)),
        _c(left), _c(mention), _c(right), F.array_join(numbered, "\n"),
    )


def rewrite_prompt(
    col, join_context: bool = True, drop_ids: bool = True, null: str = NAMES.null, id_pattern: str = r"\d+"
) -> Column:
    """Question in the training wording: answers by commas, mention marked inside its
    context, concept ids left out."""
    s = F.replace(_c(col), F.lit(WORDING[0]), F.lit(WORDING[1]))
    if join_context:
        s = F.replace(s, F.lit("*"), F.lit(""))
        s = F.replace(s, F.lit(JOINED_TASK[0]), F.lit(JOINED_TASK[1]))
        for old, new in JOINED_MARKS:
            s = F.replace(s, F.lit(old), F.lit(new))
    if drop_ids:
        s = F.regexp_replace(s, rf"\s*\((?:{id_pattern}|{null})\)", "")
    return s


def marked_mention(col) -> Column:
    """First text between two asterisks, or empty."""
    return F.regexp_extract(_c(col), r"\*([^*]+)\*", 1)


def parse_prompt(prompt, answer) -> Column:
    """What a rewritten multi-option question and its gold numbers say.

    Struct of the mention, distinct parents, gold parents, option numbers under the gold
    parents, their distinct children, the gold ones of these, and the gold numbers.
    """
    p = _c(prompt)

    def option(line: Column) -> Column:
        edge = F.regexp_replace(line, r"^[^.]*\.", "")
        return F.struct(
            F.substring_index(line, ".", 1).alias("num"),
            F.substring_index(edge, " -> ", 1).alias("parent"),
            F.get(F.split(edge, " -> "), F.lit(1)).alias("child"),
        )

    def read(text: Column) -> Column:
        context = F.substring_index(F.substring_index(text, "mention in context:", -1), "options:", 1)
        lines = F.split(strip(F.substring_index(text, "options:", -1)), "\n")
        return F.struct(
            strip(marked_mention(context)).alias("mention"), F.transform(lines, option).alias("options"),
            F.split(_c(answer), ",").alias("gold"),
        )

    def with_parents(r: Column) -> Column:
        right = F.filter(r["options"], lambda o: F.array_contains(r["gold"], o["num"]))
        return F.struct(
            r["mention"].alias("mention"), r["options"].alias("options"), r["gold"].alias("gold"),
            F.array_distinct(F.transform(right, lambda o: o["parent"])).alias("gold_parents"),
        )

    def with_narrowed(r: Column) -> Column:
        under = F.transform(r["gold_parents"], lambda g: F.filter(r["options"], lambda o: o["parent"] == g))
        return F.struct(
            r["mention"].alias("mention"), r["options"].alias("options"), r["gold"].alias("gold"),
            r["gold_parents"].alias("gold_parents"), F.flatten(under).alias("narrowed"),
        )

    def finish(r: Column) -> Column:
        hit = F.filter(r["narrowed"], lambda o: F.array_contains(r["gold"], o["num"]))
        return F.struct(
            r["mention"].alias("mention"),
            F.array_distinct(F.transform(r["options"], lambda o: o["parent"])).alias("parents"),
            r["gold_parents"].alias("gold_parents"),
            F.transform(r["narrowed"], lambda o: o["num"]).alias("narrowed"),
            F.array_distinct(F.transform(r["narrowed"], lambda o: o["child"])).alias("children"),
            F.array_distinct(F.transform(hit, lambda o: o["child"])).alias("gold_children"),
            r["gold"].alias("gold"),
        )

    return let(let(let(let(p, read), with_parents), with_narrowed), finish)


def order_answer(col) -> Column:
    """Comma-separated numbers in ascending order."""
    nums = F.array_sort(F.transform(F.split(_c(col), ","), lambda x: F.trim(x).cast("long")))
    return F.array_join(F.transform(nums, lambda x: x.cast("string")), ",")


def inference_prompt(prompt, reasoning: bool = False) -> Column:
    """The question framed for generation."""
    tail = "### Explanation:\n" if reasoning else RESPONSE_MARK + "\n"
    return F.concat(F.lit("### Input:\n"), _c(prompt), F.lit("\n\n" + tail))


def instruction(prompt, answer, reasoning: bool = False) -> Column:
    """The question framed together with its answer, optionally with the reasoning."""
    ordered = order_answer(answer)
    head = F.concat(F.lit("### Input:\n"), _c(prompt), F.lit("\n\n"))
    tail = F.concat(F.lit(RESPONSE_MARK + "\n"), ordered, F.lit("\n"))
    if not reasoning:
        return F.concat(head, tail)

    def explain(said: Column) -> Column:
        comma = lambda name: F.array_join(said[name], ", ")
        return F.format_string(
            REASONING, comma("parents"), said["mention"], comma("gold_parents"), comma("narrowed"),
            comma("children"), said["mention"], comma("gold_children"), comma("gold"),
        )

    why = let(parse_prompt(prompt, ordered), explain)
    return F.concat(head, F.lit("### Explanation:\n"), why, F.lit("\n\n"), tail)


def _numbers(text: Column, separator: str) -> Column:
    pieces = F.transform(F.split(text, separator), lambda p: strip(p))
    ends = F.transform(
        pieces,
        lambda p: F.array(F.regexp_extract(p, r"^\d+", 0), F.regexp_extract(p, r"\d+$", 0)),
    )
    return F.array_distinct(F.filter(F.flatten(ends), lambda x: x != ""))


def parse_answer(col) -> Column:
    """Option numbers in free text: leading and trailing number of each piece, in order."""
    c = _c(col)
    return F.when(c.startswith("None"), F.array().cast("array<string>")).otherwise(
        _numbers(c, r"\\n|\n|,")
    )


def parse_answer_marked(
    col, marker: str = RESPONSE_MARK, phrase: str = FINAL_PHRASE, end: str = END_TAG
) -> Column:
    """Option numbers after the response mark, or after the final phrase where that part
    is missing or empty."""
    c = _c(col)

    def after(mark: str) -> Column:
        at = F.locate(mark, c)
        return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise("")

    first = strip(after(marker))
    said = F.when(first != "", first).otherwise(after(phrase))
    said = F.when(said.endswith(end), F.substring(said, F.lit(1), F.length(said) - len(end))).otherwise(said)
    return _numbers(said, r"\n|,")


def parse_answer_affix(col, head: int = 6, tail: int = 4) -> Column:
    """The text between fixed-length affixes; empty for None."""
    c = _c(col)
    core = F.substring(c, F.lit(head + 1), F.greatest(F.length(c) - head - tail, F.lit(0)))
    return F.when(core.startswith("None"), "").otherwise(strip(core))


def clean_answers(prompts, col: str = "answer"):
    """Training rows with a usable answer, without the marks of gold not offered (-1)."""
    kept = F.array_remove(F.split(F.col(col), ","), "-1")
    return prompts.withColumn(col, F.array_join(kept, ",")).where(F.col(col) != "")
