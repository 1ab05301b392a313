from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus

LONG = "preamble " * 12


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a\nb\n\n c \n \t\n\nd", [["a", "b"], ["c"], ["d"]]),
        ("\n\na\n\n", [["a"]]),
        ("", []),
        (" \n ", []),
        (None, None),
    ],
)
def test_blocks(one, text, expected):
    assert one(corpus.blocks(F.col("t")), "t string", (text,)) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (f"title\n\n{LONG}\n\nArticle 1\nbody one\nbody two\n\nArticle 2\nx", "body one body two"),
        (f"{LONG}\n\nonly", "only"),
        (f"title\n\n{LONG}", None),
        ("equal\n\nother\n\nthird", "other"),  # the first of the longest
        ("", None),
        (None, None),
        ("a\n\nb\n\nc\n\nd\n\n" + LONG + "\n\nlast", "b"),  # beyond the window
    ],
)
def test_block_after_longest(one, text, expected):
    assert one(corpus.block_after_longest(corpus.blocks(F.col("t"))), "t string", (text,)) == expected


@pytest.mark.parametrize(("text", "expected"), [(f"Preamble\n{LONG}\nBend 1\nthe passage\nBend 2", "the passage"), (f"One\n{LONG}", None), (f"One\n{LONG}\nTwo", None), ("", None), (None, None)])
def test_line_after_second_heading(one, text, expected):
    assert one(corpus.line_after_second_heading(corpus.lines(F.col("t"))), "t string", (text,)) == expected


@pytest.mark.parametrize(("n", "flagged"), [(19, True), (20, False), (900, False), (901, True)])
def test_implausible(one, n, flagged):
    assert one(corpus.implausible(F.col("t")), "t string", ("x" * n,)) is flagged


def test_accumulated(one):
    got = one(corpus.accumulated(corpus.blocks(F.col("t")), 4), "t string", ("a b\n\nc d\n\ne f",))
    assert (got["text"], got["n"]) == ("a b c d", 4)
    assert one(corpus.accumulated(corpus.blocks(F.col("t")), 4), "t string", ("",))["n"] == 0


def test_skipped(spark):
    rows, made = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert [r["k"] for r in corpus.skipped(rows, made, "k").collect()] == [2]
