"""Quality rules and the quality classifier."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_bayes, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def figures_by_hand(text):
    text = text or ""
    words = text.encode().split()
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines),
        len(lines) - len(set(lines)),
        len(covered),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def texts(seed, n=60):
    r = random.Random(seed)
    out = [None, "", " ", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "né\x85ü 日本\u3000語\u00a0x", "l\nl\n\nl\nm |# <", "a\x1cb c"]
    for _ in range(n):
        words = r.choices(["a", "b", "c", "dé", "#1"], k=r.randrange(0, 80))
        out.append("".join(w + r.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_base_figures(seed):
    given = texts(seed)
    got = quality_rules.base_figures(given)
    assert list(map(tuple, got.to_numpy().tolist())) == [figures_by_hand(t) for t in given]


def test_windows_that_are_no_power_of_two():
    words = [b"a", b"b", b"c"] * 3
    for width in (1, 2, 3, 5, 6, 7):
        n, _ = quality_rules.repeated_words([9], words, width)
        windows = {}
        for i in range(10 - width):
            windows.setdefault(tuple(words[i : i + width]), []).append(i)
        assert n[0] == len({j for p in windows.values() if len(p) > 1 for i in p for j in range(i, i + width)})


def clean(r, n=60):
    return " ".join("".join(r.choices("abcdefgh", k=r.choice([3, 4, 5, 6]))) for _ in range(n)) + "."


def docs(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = clean(r, r.randrange(30, 120))
        kind = "good"
        if i % 10 == 0:
            text, kind = " ".join(w + "###" for w in text.split()), "junk"
        elif i % 25 == 1:
            text, kind = clean(r, 10), "short"
        rows.append((i, text, r.choice(["en", "de"]), r.choice(["s1", "s1", "s2"]), kind))
    return rows


def thresholds_by_hand(rows, min_documents):
    """Fences from sorted ratios, to the sketches' error."""
    out = {}
    for cell in {(r[2], r[3]) for r in rows}:
        for level in (0, 1, 2):
            near = [r for r in rows if (level > 1 or r[2] == cell[0]) and (level > 0 or r[3] == cell[1])]
            f = [figures_by_hand(r[1]) for r in near]
            f = [x for x in f if x[0] >= 20 and 100 * x[5] <= 30 * x[0]]
            if len(f) >= min_documents or level == 2:
                break
        out[cell] = level, {}
        for name, values in (("symbols_per_word", [x[2] / x[0] for x in f]), ("word_length", [x[1] / x[0] for x in f])):
            v = np.sort(values)
            q = lambda p, v=v: v[int(np.ceil(p * len(v))) - 1]
            slack, lower = quality_rules.SLACK[name]
            reach = quality_rules.SPREAD * (q(0.5) - q(0.1)) + slack
            out[cell][1][name] = (q(0.5) - reach if lower else float("-inf"), q(0.5) + reach)
    return out


def test_thresholds_adapt(spark):
    rows = docs(1) + [(5000 + i, clean(random.Random(i), 40), "fr", "rare", "good") for i in range(5)] + [(6000 + i, clean(random.Random(i)), None, None, "good") for i in range(3)]
    df = spark.createDataFrame([r[:4] for r in rows], SCHEMA)
    measured = quality_rules.measured(df, carry=[])
    got = {(r["lang"], r["source"]): r for r in quality_rules.thresholds(measured, min_documents=100).collect()}
    for cell, (level, fences) in thresholds_by_hand(rows, 100).items():
        assert got[cell]["level"] == level
        for name, (low, high) in fences.items():
            f = got[cell]["fences"][name]
            assert f["high"] == pytest.approx(high, rel=0.25, abs=0.02) and f["low"] == pytest.approx(low, rel=0.3, abs=0.3)


@pytest.mark.parametrize("min_documents", [1, 60, 10_000])
def test_rules_equal_sql(spark, monkeypatch, min_documents):
    import duckdb

    monkeypatch.setattr(quality_rules.thresholds, "__kwdefaults__", {"min_documents": min_documents})
    rows = [r[:4] for r in docs(3)] + [(1000 + i, t, r, s) for i, (t, r, s) in enumerate(zip(texts(5), ["en", None, "xx"] * 30, ["s1", "s2", None, "s3"] * 30))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(quality_rules.oracle_sql(min_documents))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(repr, (tuple(x[c] for c in rel.columns) for x in got.collect()))) == sorted(map(repr, rel.fetchall()))


def test_rules_keep_good_and_drop_junk(spark):
    rows = docs(2)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame([r[:4] for r in rows], SCHEMA)).collect()}
    for i, text, _, _, kind in rows:
        f = figures_by_hand(text)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (*f[:3], *f[4:6])
        assert got[i]["base_failed"] == (f[0] < 20 or 100 * f[5] > 30 * f[0])
        assert got[i]["kept"] == (kind == "good"), (i, kind)


def test_verdicts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([r[:4] for r in docs(3)], SCHEMA)
    a, b = (sorted(map(repr, quality_rules.quality_rules(d).collect())) for d in (df.repartition(1), df.repartition(7, "text")))
    assert a == b


def test_rules_on_odd_rows(spark):
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "word " * 300_000, "en", "s"), (3, clean(random.Random(1)), None, "s"), (3, clean(random.Random(1)), None, "s")]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and sorted(r["doc_id"] for r in got if r["kept"]) == [3, 3]


def test_kept_documents_keep_columns(spark):
    df = spark.createDataFrame([r[:4] for r in docs(4, 120)], SCHEMA).withColumn("fences", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = quality_rules.kept_documents(df)
    assert got.columns == df.columns
    want = {r["doc_id"] for r in quality_rules.quality_rules(df).where("kept").collect()}
    assert {r["doc_id"] for r in got.collect()} == want


# ---- classifier -----------------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rows = docs(5, n)
    truth = {r[0]: int(r[4] == "good") for r in rows}
    return spark.createDataFrame([r[:4] for r in rows], SCHEMA), truth


def test_held_out_accuracy(spark):
    df, truth = labelled(spark)
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i // 50 % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_bayes.classify(df, labels).collect()}
    held = [i for i in truth if i // 50 % 2 == 0]
    assert sum(got[i] == bool(truth[i]) for i in held) / len(held) > 0.97


def features_by_hand(text):
    n, chars, symbols, lines, dup, repeated, stuttered = figures_by_hand(text)
    text, w = text or "", max(n, 1)
    own = text.split()
    return [np.log(1 + n), chars / w, symbols / w, dup / max(lines, 1), repeated / w, stuttered / w, len([x for x in own if x.isupper()]) / w, len([c for c in text if c == "!"]) / w, len([c for c in text if c in "0123456789"]) / w, len(set(own)) / w**0.7 if own else 0.0]


@pytest.mark.parametrize("seed", range(2))
def test_features_by_hand(seed):
    given = [*texts(seed), "ALL CAPS! Here 2 of 10", "a b a b!!"]
    got = quality_bayes.features(given)
    assert got == pytest.approx(np.array([features_by_hand(t) for t in given]))


@pytest.mark.parametrize("seed", range(3))
def test_fit_is_the_optimum(seed):
    """At the fitted weights the gradient of the penalised likelihood is zero, by differences of the likelihood itself."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(300, len(quality_bayes.FEATURES))) * 3 + 1
    y = (x @ r.normal(size=x.shape[1]) + r.normal(size=300) * 4 > 0).astype(float)
    model = quality_bayes.fit(x, y)
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def loss(w, b):
        odds = z @ w + b
        return np.sum(np.logaddexp(0, odds) - y * odds) + 0.5 * quality_bayes.RIDGE * (w @ w)

    for i in range(len(model.weights)):
        step = np.zeros(len(model.weights))
        step[i] = 1e-4
        assert abs(loss(model.weights + step, model.bias) - loss(model.weights - step, model.bias)) / 2e-4 < 1e-3
    assert abs(loss(model.weights, model.bias + 1e-4) - loss(model.weights, model.bias - 1e-4)) / 2e-4 < 1e-3


def test_posteriors_by_hand(spark):
    df, truth = labelled(spark, 300)
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    got = quality_bayes.classify(df, labels).collect()
    p = {r["doc_id"]: r["evidence"] for r in got}
    hosts, paths = {}, {}
    for r in got:
        hosts.setdefault(r["host"], []).append(p[r["doc_id"]])
        paths.setdefault((r["host"], r["path"]), []).append(p[r["doc_id"]])

    def strength(groups, around):
        n = sum(map(len, groups.values()))
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / (n - len(groups))
        between = sum(len(g) * (np.mean(g) - around[k]) ** 2 for k, g in groups.items()) - (len(groups) - 1) * within
        between /= n - sum(len(g) ** 2 for g in groups.values()) / n
        return float(np.clip(within / between if between > 0 else np.inf, 1, 1e6))

    every = np.mean(list(p.values()))
    kh = strength(hosts, dict.fromkeys(hosts, every))
    hq = {h: (kh * every + sum(g)) / (kh + len(g)) for h, g in hosts.items()}
    kp = strength(paths, {k: np.mean(hosts[k[0]]) for k in paths})
    logit = lambda x: np.log(x / (1 - x))
    for r in got:
        g, mine = paths[(r["host"], r["path"])], p[r["doc_id"]]
        others = (kp * hq[r["host"]] + sum(g) - mine) / (kp + len(g) - 1)
        want = 1 / (1 + np.exp(-(logit(mine) + logit(others) - logit(every))))
        assert r["host_quality"] == pytest.approx(hq[r["host"]], rel=1e-6) and r["quality"] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r["kept"] == (r["quality"] >= 0.5)


def test_sites_move_borderline_documents(spark):
    """The same text on a good and on a bad site; a sparse site stays near the prior."""
    r = random.Random(6)
    good, bad = (lambda: clean(r, 60)), (lambda: " ".join(w + "###" for w in clean(r, 60).split()))
    rows = [(i, good(), "en", "good") for i in range(150)] + [(1000 + i, bad(), "en", "bad") for i in range(150)]
    border = " ".join(w + ("#" if i % 2 else "") for i, w in enumerate(clean(r, 60).split()))
    rows += [(5000, border, "en", "good"), (5001, border, "en", "bad"), (5002, border, "en", "sparse")]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows if i < 5000], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality_bayes.classify(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert got[5000]["quality"] > got[5002]["quality"] > got[5001]["quality"]
    assert got[5000]["evidence"] == pytest.approx(got[5001]["evidence"])


def test_classifier_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, quality int")
    assert quality_bayes.classify(spark.createDataFrame([], SCHEMA), labels).count() == 0
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "word " * 200_000, "en", None)]
    got = quality_bayes.classify(spark.createDataFrame(rows, SCHEMA).withColumn("p", F.lit(3)).withColumn("n", F.lit(4)), labels).collect()
    assert len(got) == 4 and all(0 <= r["quality"] <= 1 for r in got)
