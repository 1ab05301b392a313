"""Text normalisation and segmentation as column expressions. A null text gives null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

METASPACE = "▁"
#: The combining marks that the BERT normaliser drops; composed letters keep theirs.
MARKS = "[\\u0300-\\u036F]"
WORDS = "[\\p{L}\\p{N}]+"


def bert_lower(text: Column) -> Column:
    return F.lower(text)


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def bert_normalize(text: Column) -> Column:
    return strip_marks(bert_lower(text))


def segment(text: Column, pattern: str = WORDS) -> Column:
    """Words of a text, none empty."""
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), 0), lambda w: w != "")


def without_empty(words: Column) -> Column:
    """For segmenters of one's own (Column -> Column): drops empty words."""
    return F.filter(words, lambda w: w != "")


Segmenter = Callable[[Column], Column]


def collapse_spaces(text: Column) -> Column:
    """Runs of U+0020 become one; nothing is trimmed, other white space stays."""
    return F.regexp_replace(text, " {2,}", " ")


def metaspace(text: Column) -> Column:
    """A leading space is added unless there is one, and spaces become U+2581; an empty text stays empty."""
    led = F.when(text.startswith(" "), text).otherwise(F.concat(F.lit(" "), text))
    return F.when(text == "", text).otherwise(F.replace(led, F.lit(" "), F.lit(METASPACE)))


def escaped(text: str) -> str:
    """`metaspace` of `collapse_spaces` for one text, for functions that have it in Python anyway."""
    text = re.sub(" {2,}", " ", text)
    return (text if text.startswith(" ") else " " + text).replace(" ", METASPACE) if text else text


def with_prefix(text: Column, prefix: str | None) -> Column:
    """Puts the model's prefix before a text, an empty one too; without a prefix the text stays."""
    return F.concat(F.lit(prefix), text) if isinstance(prefix, str) else text
