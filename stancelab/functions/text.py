"""Text expressions: Python-compatible strip, ordered phrase rules, pattern tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# Every character Python's str.isspace() accepts (what str.strip() removes), by rule.
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
STRIP_PATTERN = f"^[{PY_WHITESPACE}]+|[{PY_WHITESPACE}]+$"


def py_strip(c: str | Column) -> Column:
    """Strip leading/trailing whitespace like Python (Spark ``trim`` removes spaces only).

    ``btrim`` with the whitespace set only touches the two ends of the text, where a
    regular expression would be tried at every position of a long document.
    """
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


# The ordered wording rules that label a prompt ending.
ENDING_RULES: tuple[tuple[str, str], ...] = (
    ("My stance on", "My stance on..."),
    ("My personal opinion on", "My personal opinion on..."),
    ("I think", "I think..."),
    ("In my opinion", "In my opinion..."),
    ("My stance is", "My stance is..."),
    ("My personal opinion is", "My personal opinion is..."),
    ("I personally believe", "I personally believe..."),
    ("I believe that", "I believe that..."),
    ("Personally, I am", "Personally, I am..."),
)


def first_phrase_label(c: str | Column, rules: Sequence[tuple[str, str]] = ENDING_RULES) -> Column:
    """First rule whose needle is contained (case-sensitive) wins; else the stripped text.

    NULL text behaves as ``''``.  Built as one CASE expression, so it stays in codegen.
    """
    text = F.coalesce(col(c), F.lit(""))
    expr = None
    for needle, label in rules:
        cond = F.instr(text, needle) > 0
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    fallback = py_strip(text)
    return fallback if expr is None else expr.otherwise(fallback)


def wrap_words(text: str | Column, width: int = 16) -> Column:
    """Words of ``text`` on lines of at most ``width`` characters; a longer word has a line of its own.

    White space between words is one break or one blank; words are never broken.
    """
    words = F.filter(F.split(col(text), r"\s+"), lambda w: w != "")

    def put(acc: Column, word: Column) -> Column:
        fits = acc["used"] + 1 + F.length(word) <= width
        return (F.when(acc["used"] == 0, F.struct(word.alias("lines"), F.length(word).alias("used")))
                .when(fits, F.struct(F.concat(acc["lines"], F.lit(" "), word).alias("lines"),
                                     (acc["used"] + 1 + F.length(word)).alias("used")))
                .otherwise(F.struct(F.concat(acc["lines"], F.lit("\n"), word).alias("lines"), F.length(word).alias("used"))))

    return F.aggregate(words, F.struct(F.lit("").alias("lines"), F.lit(0).alias("used")), put)["lines"]
