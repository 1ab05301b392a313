"""Assembly of token ids to model input: sentinels, truncation, padding and masks, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGS = "array<long>"


@dataclass(frozen=True)
class Frame:
    """Sentinels of a tokenizer family. keep_end: whether the end sentinel stays when content is cut."""

    start: int
    end: int
    pad: int
    unknown: int
    keep_end: bool


BERT = Frame(start=101, end=102, pad=0, unknown=100, keep_end=True)
XLMR = Frame(start=0, end=2, pad=1, unknown=3, keep_end=False)
FAMILIES = {"bert": BERT, "xlmr": XLMR}


def check_length(max_length: int) -> int:
    if max_length < 2:
        raise ValueError(f"max_length must be 2 or more, not {max_length}")
    return max_length


def framed(ids: Column, frame: Frame, max_length: int) -> Column:
    """Content ids with sentinels, cut to max_length: within a word if need be."""
    check_length(max_length)
    start, end = (F.array(F.lit(x).cast("long")) for x in (frame.start, frame.end))
    if frame.keep_end:
        return F.concat(start, F.slice(ids, 1, max_length - 2), end)
    return F.slice(F.concat(start, ids, end), 1, max_length)


def padded(tokens: Column, frame: Frame, max_length: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(frame.pad).cast("long"), F.lit(max_length) - F.size(tokens)))


def attention_mask(tokens: Column, max_length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1).cast("long"), F.size(tokens)), F.array_repeat(F.lit(0).cast("long"), F.lit(max_length) - F.size(tokens)))


def token_type_ids(max_length: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), F.lit(max_length))


def truncated(ids: Column, max_length: int) -> Column:
    """Whether content ids were refused; both sentinels count."""
    return F.size(ids) > max_length - 2


def assembled(ids: Column, frame: Frame, max_length: int) -> Column:
    """The tokenizer's output of content ids: input_ids, attention_mask, token_type_ids and truncated."""
    tokens = framed(ids, frame, max_length)
    fields = [padded(tokens, frame, max_length).alias("input_ids"), attention_mask(tokens, max_length).alias("attention_mask"), token_type_ids(max_length).alias("token_type_ids"), truncated(ids, max_length).alias("truncated")]
    return F.when(ids.isNotNull(), F.struct(*fields))


def real_tokens(mask: Column) -> Column:
    """Tokens before the first 0 of a mask, or all."""
    first = F.array_position(mask, F.lit(0).cast("long"))
    return F.when(first == 0, F.size(mask).cast("long")).otherwise(first - 1)
