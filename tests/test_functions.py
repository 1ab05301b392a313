"""Text, vectors, quantisation and token assembly."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import sq8, tokens, vector
from textloom.functions import text as T


@pytest.mark.parametrize(("given", "expected"), [("HELLO", "hello"), ("cafe\u0301", "cafe"), ("caf\u00e9", "caf\u00e9"), ("", ""), (None, None)])
def test_bert_normalize(one, given, expected):
    assert one(T.bert_normalize(F.col("t")), "t string", (given,)) == expected


@pytest.mark.parametrize(("given", "expected"), [("hello world", ["hello", "world"]), ("", []), ("   \t\n   ", []), ("a-b c3", ["a", "b", "c3"]), (None, None)])
def test_segment(one, given, expected):
    assert one(T.segment(F.col("t")), "t string", (given,)) == expected


@pytest.mark.parametrize(("given", "expected"), [("hello world", "▁hello▁world"), ("a   b", "▁a▁b"), (" Hello", "▁Hello"), ("", ""), ("  a", "▁a"), ("a\t b", "▁a\t▁b"), (None, None)])
def test_collapse_and_metaspace(one, given, expected):
    assert one(T.metaspace(T.collapse_spaces(F.col("t"))), "t string", (given,)) == expected


@pytest.mark.parametrize(("text", "prefix", "expected"), [("hello", "passage: ", "passage: hello"), ("", "passage: ", "passage: "), ("hello", None, "hello"), ("hello", 7, "hello"), (None, "query: ", None)])
def test_prefix(one, text, prefix, expected):
    assert one(T.with_prefix(F.col("t"), prefix), "t string", (text,)) == expected


def vec(*x):
    return F.array(*[F.lit(v).cast("float") for v in x])


@pytest.mark.parametrize(("mask", "expected"), [((1, 1, 1), (1 / 3, 2 / 3, 1, 0)), ((1, 0, 1), (1.5, 0, 0, 0)), ((0, 0, 0), (0, 0, 0, 0)), ((0, 1, 0), (-2, 2, 3, 0)), ((2, 1, 0), (-2, 2, 3, 0))])
def test_mean_pool(one, mask, expected):
    hidden = vec(1, 0, 0, 0, -2, 2, 3, 0, 2, 0, 0, 0)
    got = one(vector.mean_pool(hidden, F.array(*map(F.lit, mask)), 4))
    assert got == pytest.approx(expected, abs=1e-6)


def test_mean_pool_checks_the_shape(one):
    with pytest.raises(Exception, match="don't fit"):
        one(vector.mean_pool(vec(1, 2, 3), F.array(F.lit(1)), 4))


@pytest.mark.parametrize(("given", "expected"), [((3, 4), (0.6, 0.8)), ((0, 0, 0), (0, 0, 0)), ((-3, -4), (-0.6, -0.8)), ((7,), (1,)), ((-5,), (-1,))])
def test_l2_normalize(one, given, expected):
    assert one(vector.l2_normalize(vec(*given))) == pytest.approx(expected, abs=1e-7)


def test_dot(one):
    assert one(vector.dot(vec(0.6, 0.8), vec(0.8, 0.6))) == pytest.approx(24 / 25, abs=1e-6)
    assert one(vector.dot(vec(1, 0), vec(0, 1))) == 0
    assert one(vector.dot(vec(1, 0), vec(-1, 0))) == -1
    assert one(vector.dot(F.lit(None).cast("array<float>"), vec(1))) is None
    with pytest.raises(Exception, match="differ in length"):
        one(vector.dot(vec(1, 0), vec(1)))


@pytest.mark.parametrize(("x", "code"), [(1.0, 255), (-1.0, 0), (0.0, 128), (1.0001, 255), (-1.0001, 0), (0.5, 191)])
def test_quantise(one, x, code):
    assert one(sq8.quantise(F.array(F.lit(x)))) == [code]


@pytest.mark.parametrize("x", [float("nan"), float("inf"), float("-inf")])
def test_quantise_rejects_what_is_not_finite(one, x):
    with pytest.raises(Exception, match="OVERFLOW"):
        one(sq8.quantise(F.array(F.lit(x))))


def test_quantise_rejects_empty_and_keeps_null(one):
    with pytest.raises(Exception, match="empty vector"):
        one(sq8.quantise(F.array().cast("array<float>")))
    assert one(sq8.quantise(F.lit(None).cast("array<float>"))) is None


def test_quantised_ramp_is_within_half_a_step(one):
    ramp = [i / 191.5 - 1 for i in range(384)]
    v = F.array(*map(F.lit, ramp))
    back = one(sq8.dequantise(sq8.quantise(v)))
    assert max(abs(a - b) for a, b in zip(ramp, back, strict=True)) <= 0.004
    assert one(sq8.from_binary(sq8.to_binary(sq8.quantise(v)))) == one(sq8.quantise(v))


def test_quantised_scores_drift_little(one):
    r = random.Random(1)

    def unit():
        x = [r.gauss(0, 1) for _ in range(384)]
        n = math.sqrt(sum(v * v for v in x))
        return F.array(*[F.lit(v / n) for v in x])

    a, b = unit(), unit()
    coded = lambda v: sq8.dequantise(sq8.quantise(v))
    assert abs(one(vector.dot(a, b)) - one(vector.dot(coded(a), coded(b)))) <= 0.05
    assert one(vector.dot(vector.l2_normalize(coded(a)), a)) > 0.99


def ids(n):
    return F.array_repeat(F.lit(103).cast("long"), n)


@pytest.mark.parametrize(("n", "cut"), [(0, False), (6, False), (7, False), (8, False), (9, True), (600, True)])
def test_bert_frame(one, n, cut):
    got = one(tokens.assembled(ids(n), tokens.BERT, 10))
    content = [103] * min(n, 8)
    pads = 8 - len(content)
    assert got["input_ids"] == [101, *content, 102] + [0] * pads
    assert got["attention_mask"] == [1] * (len(content) + 2) + [0] * pads
    assert got["token_type_ids"] == [0] * 10
    assert got["truncated"] is cut


def test_xlmr_frame_loses_the_end(one):
    got = one(tokens.assembled(ids(9), tokens.XLMR, 10))
    assert got["input_ids"] == [0] + [103] * 9 and got["truncated"]
    assert one(tokens.assembled(ids(0), tokens.XLMR, 4))["input_ids"] == [0, 2, 1, 1]
    assert one(tokens.real_tokens(tokens.assembled(ids(0), tokens.XLMR, 4)["attention_mask"])) == 2
    assert one(tokens.real_tokens(tokens.assembled(ids(9), tokens.XLMR, 4)["attention_mask"])) == 4


def test_frames_need_room_for_sentinels():
    with pytest.raises(ValueError, match="2 or more"):
        tokens.check_length(1)
