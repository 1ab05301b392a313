from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("text", ["", " ", "Hello world", "don't  stop\n\n\tnow ", "x" * 3000, "a" * 1200 + " b", "größer — «né» été", "日本語のテキスト", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "<|fim_prefix|> x", "\x1c\x85 ​﻿", "".join(map(chr, range(1, 0x250))), "1234567890123 ²³ ½ ª º µ"])
def test_fast_and_slow_ids_agree(text):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(files.path(packing.TOKENIZER))
    want = slow.encode(text, add_special_tokens=False).ids
    assert packing.encoder()(text) == want and packing.encoder(ranks=None)(text) == want


def test_fast_and_slow_ids_agree_on_every_pair_of_characters():
    fast, slow = packing.encoder(), packing.encoder(ranks=None)
    r = random.Random(0)
    chars = list(map(chr, range(0x250)))
    for _ in range(300):
        text = "".join(r.choices(chars, k=100)) + " " + "".join(r.choices(" \n\t'ab1é \u0085", k=60))
        assert fast(text) == slow(text), repr(text)


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]), (25, [(0, 5), (5, 10), (15, 10)])])
def test_cut(n, want):
    assert packing.cut(n, 10) == want


def solved(histogram, **options):
    slots, n = packing.plan(histogram, **options)
    bins: dict[int, list[tuple[int, int]]] = {}
    seen = {}
    for s in slots:
        assert s.first_rank == seen.get(s.length, 0)
        seen[s.length] = s.first_rank + s.n
        for i in range(s.n):
            bins.setdefault(s.first_sequence + i // s.each, []).append((s.offset + i % s.each * s.length, s.length))
    assert seen == {k: v for k, v in histogram.items() if v}
    assert sorted(bins) == list(range(n))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
    return bins


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_plan_respects_every_capacity(score, seed):
    r = random.Random(seed)
    histogram = {r.randrange(1, 101): r.randrange(1, 400) for _ in range(60)}
    free = solved(histogram, tokens=100, score=score)
    assert all(sum(n for _, n in b) <= 100 for b in free.values())
    bound = -(-sum(k * v for k, v in histogram.items()) // 100)
    assert len(free) <= 1.25 * bound + 1
    tight = solved(histogram, tokens=100, documents=4, attention=10_000, score=score)
    assert all(sum(n for _, n in b) <= 100 and len(b) <= 4 and sum(n * n for _, n in b) <= 10_000 for b in tight.values())
    with pytest.raises(ValueError, match="exceeds"):
        packing.plan({11: 1}, tokens=10)
    with pytest.raises(ValueError, match="score"):
        packing.plan({1: 1}, score="other")


def test_plan_is_as_small_as_can_be_on_many_small_pieces():
    r = random.Random(9)
    sizes = [min(2048, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(20_000)]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    _, n = packing.plan(histogram)
    assert n <= -(-sum(sizes) // 2048) + 1


def test_packed(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"word{r.randrange(50)}" for _ in range(r.choice([0, 3, 40, 400]))), "s") for i in range(60)]
    rows += [(99, "a <|endoftext|> b", "s"), (100, None, "s"), (101, "", None), (102, "z " * 9000, "s"), (3, "again", "s"), (3, "again", "s"), (None, "no id", "s")]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA)).collect()
    import public_tokenizers as files
    from tokenizers import Tokenizer

    encode = lambda t, whole=Tokenizer.from_file(files.path(packing.TOKENIZER)): whole.encode(t, add_special_tokens=False).ids
    want = []
    for i, t, _ in rows:
        ids = np.array([*encode(t or ""), 0], "<u4")
        want += [(i or -1, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(packing.cut(len(ids)))]
    assert sorted((x["doc_id"] or -1, x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for content in by.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(x["length"] for x in got) // 2048) + 1
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packed_within_documents_and_attention(spark, monkeypatch, score):
    """The registered operator with all three capacities binding, and lengths ranked in several parts."""
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    r = random.Random(6)
    rows = [(i, " ".join(f"word{r.randrange(50)}" for _ in range(r.choice([0, 0, 3, 40, 150]))), "s") for i in range(120)]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA), documents=5, attention=1_000_000, score=score, capacity=1000).collect()
    by: dict = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for content in by.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1000 and len(content) <= 5 and sum(n * n for _, n in content) <= 1_000_000
    assert max(map(len, by.values())) == 5 and len(got) >= 120


def best_fit_by_hand(lengths, capacity):
    """Sequential best fit, longest first: the most that is left decides nothing, the least does."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_no_worse_than_sequential_best_fit(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randrange(1, 400), r.randrange(300, 1200), 2048]) for _ in range(3000)]
    _, n = packing.plan({s: sizes.count(s) for s in set(sizes)})
    assert n <= best_fit_by_hand(sizes, 2048) * 1.005 + 1


def test_pieces_give_back_the_text(spark):
    text = "Round trip, né? " * 900
    got = packing.pieces(spark.createDataFrame([(1, text, "s")], SCHEMA).withColumn("ids", F.lit(1))).orderBy("start").collect()
    import public_tokenizers as files
    from tokenizers import Tokenizer

    ids = np.frombuffer(b"".join(r["ids"] for r in got), "<u4").tolist()
    assert ids[-1] == 0 and Tokenizer.from_file(files.path(packing.TOKENIZER)).decode(ids[:-1]) == text


# ---- mixing ---------------------------------------------------------------------------------------------------------


def filled(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > most * sizes[s]}
        if not over:
            return out | {s: w[s] * unit for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check_mix(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    sizes, largest = {}, {}
    for _, t, s in rows:
        n = len((t or "").encode().split())
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = filled(sizes)
    assert len(got) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    top = max(largest.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * max(largest[s], top * want[s] / max(1.0, sum(want.values()))) + 1, s
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    return got


def rows_of(n, seed, hot=0.5):
    r = random.Random(seed)
    return [(i, "w " * r.randrange(0, 60), "a" if r.random() < hot else r.choice(["b", "c", "d", "ä", None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_mix(spark, seed):
    check_mix(spark, rows_of(400, seed))


def test_mix_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 17)
    check_mix(spark, rows_of(500, 7))


def test_mix_of_little(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    check_mix(spark, [(1, None, None), (2, "", "x")])
    check_mix(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", None), (2, "d", "x")])


def test_rows_of_one_id_are_mixed_alike_on_every_run(spark):
    r = random.Random(12)
    rows = [(i % 15, "w " * r.randrange(30), r.choice(["a", "b"])) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = sorted(map(repr, mixing.mix(df.repartition(1)).collect()))
    for n in (3, 5):
        assert sorted(map(repr, mixing.mix(df.repartition(n, F.rand(n))).collect())) == first


def test_mixed_documents_repeat_as_taken(spark):
    rows = rows_of(200, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("mine")).withColumn("epochs", F.lit(0))
    made = mixing.mixed_documents(df)
    assert made.columns == df.columns
    want = {r["id"]: r["epochs"] for r in mixing.mix(df).collect() if r["epochs"]}
    assert {r["doc_id"]: r["count"] for r in made.groupBy("doc_id").count().collect()} == want
    stream = [r["finish"] for r in mixing.mixed_stream(df).collect()]
    assert stream == sorted(stream) and len(stream) == sum(want.values())


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", "s", 9, 9, 9)], SCHEMA + ", piece int, length int, target int")
    assert [(r["doc_id"], r["piece"]) for r in packing.packed(rows).collect()] == [(1, 0)]
    assert [(r["id"], r["size"]) for r in mixing.mix(rows).collect()] == [(1, 2)]
