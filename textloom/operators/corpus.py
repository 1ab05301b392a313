"""Preparation of text corpora: blocks, passages and plausibility, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR_BLOCKS, HEADING_CHARS, PLAUSIBLE, TARGET_WORDS = 4, 20, (20, 900), 380


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def blocks(text: Column) -> Column:
    """Runs of lines that aren't blank, each an array of trimmed lines."""
    joined = F.array_join(_lines(text), "\n")
    parts = F.filter(F.split(joined, "\n\n+"), lambda b: F.regexp_replace(b, "\n", "") != "")
    return F.transform(parts, lambda b: F.filter(F.split(b, "\n"), lambda x: x != ""))


def block_after_longest(every: Column, window: int = ANCHOR_BLOCKS) -> Column:
    """Of the `blocks` of a text (a column of their own, so that they are made once): the block behind the longest of the first few (the first of the longest), without its first line if it has more; null if there is none."""
    sizes = F.transform(F.slice(every, 1, window), lambda b: F.length(F.array_join(b, " ")))
    at = F.array_position(sizes, F.array_max(sizes))
    block = F.when(F.size(every) > 0, F.get(every, at.cast("int")))
    return F.when(F.size(block) > 1, F.array_join(F.slice(block, F.lit(2), F.greatest(F.size(block) - 1, F.lit(1))), " ")).otherwise(F.get(block, F.lit(0)))


def lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(_lines(text), lambda x: x != "")


def line_after_second_heading(lines: Column, most: int = HEADING_CHARS) -> Column:
    """Of the `lines` of a text: the one behind the second short one."""
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0))), lambda i: F.length(F.get(lines, i)) <= most)
    return F.when(F.size(lines) > 0, F.get(lines, F.get(places, F.lit(1)) + 1))


def implausible(text: Column, bounds: tuple[int, int] = PLAUSIBLE) -> Column:
    """Flags a length outside the bounds; nothing is dropped."""
    return ~F.length(text).between(*bounds)


def accumulated(every: Column, words: int = TARGET_WORDS) -> Column:
    """Of the `blocks` of a text: whole ones from the start until they have so many words."""
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def add(acc: Column, block: Column) -> Column:
        body = F.array_join(block, " ")
        more = F.struct(F.when(acc["text"] == "", body).otherwise(F.concat(acc["text"], F.lit(" "), body)).alias("text"), (acc["n"] + F.size(F.split(body, r"\s+"))).alias("n"))
        return F.when(acc["n"] >= words, acc).otherwise(more)

    return F.aggregate(every, zero, add)


def skipped(rows: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Rows without a result: to be reported, not to stop the run."""
    return rows.join(made, key, "left_anti")
