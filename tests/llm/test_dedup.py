"""Exact and near deduplication."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import dart_minhash as D
from textloom.llm import common, exact_dedup, near_dedup
from textloom.sources import shared

SCHEMA = "doc_id long, text string"


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check_exact(spark, rows, **options):
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), **options).collect()
    want = exact_by_hand(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    kept = {}
    for r in got:
        (t,) = [t for t in texts[r["doc_id"]] if want[t] == (r["keep_id"], r["group_size"]) and (options or hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])][:1]
        kept[t] = kept.get(t, 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert kept == dict.fromkeys(want, 1)


ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "A"), (7, "a "), (8, "x" * 200_000), (9, "x" * 200_000)]


def test_exact(spark):
    check_exact(spark, ROWS)


@pytest.mark.parametrize("bounds", [{"broadcast_rows": 0}, {"broadcast_rows": 0, "filter_bytes": 0}])
def test_exact_with_more_hits_than_may_be_broadcast(spark, bounds):
    r = random.Random(2)
    rows = [(i, f"text {r.randrange(700)}") for i in range(1000)] + [(5000 + i, f"own {i}") for i in range(200)]
    got = sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA), **bounds).collect()))
    assert got == sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()))
    check_exact(spark, rows)


def test_filter_has_no_false_negatives_and_few_positives(spark):
    keyed = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("__digest"), "id")
    seen = exact_dedup._filtered(keyed, keyed.where("id < 5000"), 5000).collect()
    assert len(seen) == 20_000 and all(r["__may"] for r in seen if r["id"] < 5000)
    assert sum(r["__may"] for r in seen if r["id"] >= 5000) < 0.1 * 15_000


def test_exact_hot_group(spark):
    check_exact(spark, [(i, "copy") for i in range(1500)] + [(2000 + i, f"own {i}") for i in range(20)])


def test_exact_repeated_rows_and_null_ids(spark):
    check_exact(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "n"), (2, "b"), (2, "b"), (2, "b")])


def test_exact_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_verifies_bytes(spark):
    """With one digest for all, the bytes decide."""
    check_exact(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "b"), (6, "a")], digest=lambda c: F.sha2(F.lit("same"), 256))


def test_exact_keeps_columns_and_survives_their_names(spark):
    rows = spark.createDataFrame([(1, "a", 5, "q"), (2, "a", 6, "r"), (3, "b", 7, None)], "doc_id long, text string, keep_id int, digest string")
    got = exact_dedup.kept_documents(rows)
    assert got.columns == rows.columns
    assert sorted(map(tuple, got.collect())) == [(2, "a", 6, "r"), (3, "b", 7, None)]


def test_index_merges_runs(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "digest string, id long")
    entries = lambda df: {r["digest"]: (r["keep_id"], r["n"]) for r in df.collect()}
    index = exact_dedup.DigestIndex(spark, keep="min", fan_in=2)
    index.flush(rows(("d1", 5), ("d2", 6), ("d1", 4)))
    assert list(map(len, index.levels)) == [1] and entries(index.probe(["d1", "d9"])) == {"d1": (4, 2)}
    index.flush(rows(("d1", 9), ("d3", 1)))  # fills level 0
    assert list(map(len, index.levels)) == [0, 1]
    index.flush(rows(("d2", 2)))
    assert list(map(len, index.levels)) == [1, 1] and entries(index.probe(["d2", "d3"])) == {"d2": (2, 2), "d3": (1, 1)}
    index.flush(rows(("d2", 3)))  # fills level 0 and then level 1
    assert list(map(len, index.levels)) == [0, 0, 1]
    assert entries(index.table()) == {"d1": (4, 3), "d2": (2, 3), "d3": (1, 1)}
    index.flush(rows(("d4", None), ("d1", 3))).compact()
    assert sum(map(len, index.levels)) == 1 and entries(index.table()) == {"d1": (3, 4), "d2": (2, 3), "d3": (1, 1), "d4": (None, 1)}
    bulk = exact_dedup.DigestIndex(spark, keep="max", fan_in=4).flush(rows(*[(f"d{i % 7}", i) for i in range(100)]), runs=4)
    assert list(map(len, bulk.levels)) == [0, 1] and entries(bulk.table())["d0"] == (98, 15)
    with pytest.raises(ValueError, match="keep"):
        exact_dedup.DigestIndex(spark, keep="first")
    with pytest.raises(ValueError, match="fan_in"):
        exact_dedup.DigestIndex(spark, fan_in=1)


@pytest.mark.parametrize("filter_bytes", [0, 64_000_000])
def test_a_digest_of_a_third_of_all_rows_is_dealt_over_tasks(spark, monkeypatch, filter_bytes):
    """Hits that may not be broadcast: the texts of the hot digest don't meet in one task."""
    monkeypatch.setattr(shared, "HOT_ROWS", 100)
    keyed = spark.range(3000).select(F.col("id").alias("__id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 6))).alias("__text"))
    keyed = keyed.withColumn("__digest", F.sha2("__text", 256))
    hits = keyed.groupBy("__digest").agg(F.max("__id").alias("__keep_id"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        marked = exact_dedup._marked(keyed, hits, hits.count(), 0, filter_bytes)
        per_task = [r["count"] for r in marked.where("__text = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per_task) == 1000 and max(per_task) <= 300
        assert marked.where("__n is not null").count() == marked.count() == 3000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [0, 2, 1000])
def test_hot_join(spark, how, limit):
    r = random.Random(5)
    many = [(r.choice([1, 1, 1, 2, 2, 3, 4, 5, None]), i) for i in range(500)]
    counts = {k: sum(x == k for x, _ in many) for k in (1, 2, 3, 4)}
    got = common.hot_join(spark.createDataFrame(many, "k int, i int"), spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()], "k int, n long, v string"), "k", "n", F.xxhash64("i"), how=how, each=40, limit=limit)
    want = [(k, i, f"v{k}" if k in counts else None) for k, i in many if how == "left" or k in counts]
    assert sorted((x["i"], x["k"], x["v"]) for x in got.collect()) == sorted((i, k, v) for k, i, v in want)


def test_exact_chooses_the_same_row_of_equal_ids(spark):
    rows = [(1, "a", f"c{i}") for i in range(40)] + [(2, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    first = sorted(map(tuple, exact_dedup.kept_documents(df.repartition(3)).collect()))
    assert len(first) == 2 and all(sorted(map(tuple, exact_dedup.kept_documents(df.repartition(n)).collect())) == first for n in (1, 7))


def test_exact_plan_has_no_python(spark):
    plan = exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- DartMinHash ----------------------------------------------------------------------------------------------------


def signature_of(weights: dict[int, float], k=256):
    keys = np.array(sorted(weights), np.uint64)
    return D.signatures(np.zeros(len(keys), np.int64), D.mix(keys), np.array([weights[int(x)] for x in keys]), 1, k)[0]


@pytest.mark.parametrize("seed", range(6))
def test_signatures_estimate_weighted_jaccard(seed):
    r = random.Random(seed)
    a = {i: r.choice([1.0, 0.3, 2.5, 40.0]) for i in r.sample(range(1000), 150)}
    b = {i: w * r.choice([1, 1, 1, 2]) for i, w in a.items() if r.random() < 0.8} | {2000 + i: 1.5 for i in range(10)}
    keys = set(a) | set(b)
    true = sum(min(a.get(i, 0), b.get(i, 0)) for i in keys) / sum(max(a.get(i, 0), b.get(i, 0)) for i in keys)
    k = 2048
    assert abs((signature_of(a, k) == signature_of(b, k)).mean() - true) < 4 * (true * (1 - true) / k) ** 0.5 + 0.01


def test_signatures_do_not_depend_on_the_batch():
    texts = [" ".join(random.Random(i).choices("abcdefgh", k=50)) for i in range(7)]
    s, h, n = D.shingles(texts)
    whole = D.signatures(s, h, n.astype(float), len(texts))
    for i, t in enumerate(texts):
        s, h, n = D.shingles([t])
        assert (D.signatures(s, h, n.astype(float), 1)[0] == whole[i]).all()
    assert not D.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 2).any()


def test_shingles():
    s, h, n = D.shingles(["a b c d e f", "a b", "a  b", "", None, "x x x x x x x"])
    assert np.bincount(s, minlength=6).tolist() == [2, 1, 1, 0, 0, 1]
    assert h[s == 1] == h[s == 2] and n[s == 5] == [3]


# ---- classes --------------------------------------------------------------------------------------------------------


def near_by_hand(rows, threshold=0.8):
    def sets(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_sets = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = all_sets[i], all_sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= threshold * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {i: min(g) for g in groups.values() for i in g}


def check_near(spark, rows, **options):
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA), **options).collect()
    want = near_by_hand(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want and len(got) == len(rows)
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    assert {r["class_id"]: r["doc_id"] for r in got if r["kept"]} == {c: c for c in sizes} and sum(r["kept"] for r in got) == len(sizes)


def edited(words, r, share):
    return [f"e{r.random()}" if r.random() < share else w for w in words]


def corpus(seed, n=120):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 5, 30, 120, 300]))]
        rows.append((10 * i, " ".join(words)))
        if i % 3 == 0:
            rows.append((10 * i + 1, " ".join(edited(words, r, 0.01))))
        if i % 5 == 0:
            rows.append((10 * i + 2, " ".join(edited(words, r, 0.05))))
        if i % 7 == 0:
            rows.append((10 * i + 3, rows[-1][1]))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near(spark, seed):
    check_near(spark, [*corpus(seed), (9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "one  two"), (9006, "one three")])


@pytest.mark.parametrize("seed", range(2))
def test_near_texts_that_repeat_a_passage(spark, seed):
    """How often a shingle occurs doesn't count: 1, 3 and 20 times the same passage are one class, as are texts in which one
    line recurs more or less often."""
    r = random.Random(seed)
    rows = []
    for i in range(40):
        words = [f"w{r.randrange(100_000)}" for _ in range(r.choice([40, 80, 200]))]
        if i % 2:
            rows += [(10 * i + j, " ".join(words * n)) for j, n in enumerate([1, 3, 20])]
        else:
            line = words[: len(words) * 3 // 4]
            rows += [(10 * i + j, " ".join(words + line * n)) for j, n in enumerate([1, 3, 20])]
        rows.append((10 * i + 3, " ".join(edited(words, r, 0.01) * 5)))
    check_near(spark, rows)


def test_near_hot_family_of_many_blocks(spark):
    """Copies of one text, edited more and less, in blocks far smaller than the family."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, r, r.choice([0.0, 0.005, 0.02, 0.04, 0.08])))) for i in range(300)]
    check_near(spark, rows, block=16, hubs=2)


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(4)
    frequent = np.sort(r.choice(300, 40, replace=False)).astype(np.uint64)
    times = r.integers(33, 500, 40)
    met = 0
    for _ in range(2000):
        a = np.unique(r.integers(0, 300, r.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.92], r.integers(0, 300, r.integers(0, 4)).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and shared >= 0.8 * (len(a) + len(b) - shared):
            met += 1
            assert len(np.intersect1d(near_dedup.prefix(a, frequent, times), near_dedup.prefix(b, frequent, times)))
    assert met > 200


@pytest.mark.parametrize("refine", [1, 3])
def test_near_family_of_one_template(spark, monkeypatch, refine):
    """Texts that share most of their words, of which few are near duplicates, in a family of many blocks: cut by their rare shingles."""
    monkeypatch.setattr(near_dedup, "FREQUENT", 8)
    refined, calls = near_dedup._refined, []
    monkeypatch.setattr(near_dedup, "_refined", lambda *a: calls.append(1) or refined(*a))
    r = random.Random(11)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(180):
        own = [f"o{r.randrange(10**6)}" for _ in range(r.choice([15, 25, 40]))]
        rows.append((10 * i, " ".join(template + own)))
        if i % 4 == 0:
            rows.append((10 * i + 1, " ".join(template + edited(own, r, 0.1))))
        if i % 9 == 0:
            rows.append((10 * i + 2, " ".join(edited(template + own, r, 0.03))))
    check_near(spark, rows, block=16, hubs=2, refine=refine)
    assert calls


def test_near_hot_buckets_meet_their_leaders_in_place(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 3)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    check_near(spark, [(i, " ".join(edited(base, r, r.choice([0.0, 0.01, 0.05])))) for i in range(40)] + [(1000 + i, t) for i, t in corpus(5, 30)])


def test_near_empty_and_unlike(spark):
    assert near_dedup.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    check_near(spark, [(1, "a b c d e f"), (2, "g h i j k l")])


def test_near_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "z")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 2
    assert sorted((r["class_id"] or 0, r["class_size"]) for r in got) == [(0, 1), (3, 3), (3, 3), (3, 3)]


def test_near_keeps_columns_and_survives_their_names(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, words, 1, "x"), (2, words + " end", 2, "y"), (3, "other", 3, None)], "doc_id long, text string, key int, label string")
    got = near_dedup.kept_documents(rows)
    assert got.columns == rows.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_spanning_links_join_only_what_is_apart():
    h = [np.arange(100, dtype=np.uint64)] * 4
    assert len(near_dedup.spanning_links(h, [0, 1, 2, 3])) == 3
    assert len(near_dedup.spanning_links(h, [0, 0, 2, 2])) == 1
    assert near_dedup.spanning_links(h, [0, 0, 0, 0]) == []


@pytest.mark.parametrize(("seed", "rows"), [(0, 10**6), (1, 0), (2, 0)])
def test_components(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    r = random.Random(seed)
    edges = [(bytes([r.randrange(60)]), bytes([r.randrange(60)])) for _ in range(45)] + [(bytes([100 + i]), bytes([101 + i])) for i in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {bytes(x["key"]): bytes(x["label"]) for x in near_dedup.components(spark.createDataFrame(edges, "a binary, b binary"), "a", "b").collect()}
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
