"""Near-duplicate vectors, periodic runs and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import conversation_repair as repair
from textloom.llm import embedding_dedup, multi_index
from textloom.llm import periodic_runs as runs
from textloom.llm import queries as llm

VECTORS = "vec_id long, embedding array<double>, h string"


def brute_links(rows):
    """{place: (links, smallest id reached)} of rows (id, vector)."""
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {i: set() for i in range(len(rows))}
    for a in fine:
        for b in fine:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if (x @ y) / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                    linked[a].add(b)
                    linked[b].add(a)
    out = {}
    for i in linked:
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (len(linked[i]), min(ids) if ids else None)
    return out


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    for i in range(n // 2):
        j = rng.integers(n)
        u = rng.normal(size=dims)
        u -= (u @ v[j]) / (v[j] @ v[j]) * v[j]
        cos = rng.uniform(0.85, 0.999)
        v[i] = cos * v[j] / np.linalg.norm(v[j]) + np.sqrt(1 - cos**2) * u / np.linalg.norm(u)
    return v * rng.uniform(0.1, 10, size=(n, 1))


def compare(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)
    got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(table, **options).select("vec_id", "n_links", "component_id", "kept").fillna(-1, ["vec_id", "component_id"]).collect())
    wanted = brute_links(rows)
    want = sorted((-1 if i is None else i, wanted[p][0], -1 if wanted[p][1] is None else wanted[p][1], i is not None and i == wanted[p][1]) for p, (i, _) in enumerate(rows))
    assert got == want


def test_links_equal_all_pairs(spark):
    v = vectors(3, 400)
    compare(spark, [(1000 - i, x.tolist()) for i, x in enumerate(v)], block=32)


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, float("nan"), 3.0]), (7, [float("inf"), 2.0, 3.0])]
    rows += [(8, [2.0, 4.0, 6.0]), (9, [1e100, 2e100, 3e100]), (10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0]), (13, [-5.0]), (14, [4.0])]
    rows += [(1, one), (None, one), (8, [9.0, -2.0, 0.0]), (-5, [1.0, 2.0, 3.01]), (None, None)]
    compare(spark, rows)


def test_no_vectors(spark):
    compare(spark, [])
    compare(spark, [(1, None)])


def test_groups_of_near_copies_are_folded(spark, monkeypatch):
    """A third of all rows near one vector, another group beside it, and rows at all angles from both: with balls and without, as brute force."""
    monkeypatch.setattr(embedding_dedup, "HOT_ROWS", 20)
    search, balls = embedding_dedup._hot, []
    monkeypatch.setattr(embedding_dedup, "_hot", lambda *a: balls.append(search(*a)) or balls[-1])
    rng = np.random.default_rng(5)
    a = rng.normal(size=24)
    b = a + 0.45 * rng.normal(size=24)
    rows = [a + 0.08 * rng.normal(size=24) for _ in range(150)] + [b + 0.05 * rng.normal(size=24) for _ in range(80)]
    rows += [a + s * rng.normal(size=24) for s in np.linspace(0.1, 1.5, 90)] + list(rng.normal(size=(100, 24))) + [a.copy() for _ in range(20)]
    rows = [(i, np.round(x, 6).tolist()) for i, x in enumerate(rows)]
    compare(spark, rows, block=40)
    assert len(balls[0]) >= 2


def test_exact_threshold_counts(spark):
    compare(spark, [(1, [1.0, 0.0]), (2, [0.9, float(np.sqrt(1 - 0.81))]), (3, [9.0, -4.4]), (4, [3.0, 4.0]), (5, [4.0, 3.0])])


def test_visits_are_those_of_the_multi_sequence_walk():
    v = multi_index.unit(np.random.default_rng(1).normal(size=(300, 12)))
    grid = multi_index.fit(v, 300, 0.9, 0.99)
    (_, _), (x, y) = grid.costs(v[:40])
    row, cell = grid.visited(v[:40])
    for i in range(40):
        a, b = np.argsort(x[i], kind="stable"), np.argsort(y[i], kind="stable")
        queue, seen, walk = [(x[i][a[0]] + y[i][b[0]], 0, 0)], {(0, 0)}, []
        while queue:
            cost, p, q = heappop(queue)
            if cost > grid.limit:
                break
            walk.append((cost, int(a[p] * grid.shape[1] + b[q])))
            for s, t in ((p + 1, q), (p, q + 1)):
                if s < len(a) and t < len(b) and (s, t) not in seen:
                    seen.add((s, t))
                    heappush(queue, (x[i][a[s]] + y[i][b[t]], s, t))
        assert {c for _, c in walk} == set(cell[row == i].tolist())
        costs = {c: k for k, c in walk}
        own = [costs[c] for c in cell[row == i].tolist()]
        assert own == sorted(own)


def test_recall_at_the_threshold():
    """Neighbours at a cosine of 0.9 are met in nearly all cases, and few cells are visited."""
    rng = np.random.default_rng(2)
    v = multi_index.unit(rng.normal(size=(20_000, 64)))
    grid = multi_index.fit(v[:4000], len(v), 0.9, 0.9999)
    q = v[10_000:12_000]
    u = rng.normal(size=q.shape)
    u -= (u * q).sum(axis=1)[:, None] * q
    near = 0.9 * q + np.sqrt(0.19) * multi_index.unit(u)
    met = np.zeros(len(q), bool)
    for x, y in ((q, near), (near, q)):
        row, cell = grid.visited(x)
        met[row[cell == grid.cells(y)[row]]] = True
    print("recall", met.mean(), "cells", len(cell) / len(q), "of", grid.shape[0] * grid.shape[1])
    assert met.mean() >= 0.998
    assert len(cell) / len(q) < 0.1 * grid.shape[0] * grid.shape[1]


def test_regions_hold_a_block():
    counts = np.random.default_rng(3).integers(0, 30, size=32 * 32)
    counts[77] = 1000
    first, parts, n = multi_index.packed(counts, (32, 32), 100)
    size = np.zeros(n)
    for c in np.nonzero(counts)[0]:
        size[first[c] : first[c] + parts[c]] += counts[c] / parts[c]
    assert size.max() <= 100 and parts[77] == 10 and (first[counts == 0] == -1).all()
    assert n < 2 * counts.sum() / 100


def brute_runs(w, shortest):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(shortest, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_equal_brute_force(shortest):
    rng = random.Random(shortest)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(50))]
            texts.append(w * rng.choice([1, 1, 3]))
        for w, found in zip(texts, runs.all_runs(texts, shortest), strict=True):
            assert [tuple(r) for r in found.tolist()] == brute_runs(w, shortest)


def brute_described(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_registered_runs_equal_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r) for r in llm.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    for doc_id, text in docs:
        assert got[doc_id] == brute_described(doc_id, text)
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_odd_texts_have_runs_or_none(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (None, "a b " * 9, 0), (5, "x" * 100_000, 0), (6, "ü é " * 40, 1), (6, "ü é " * 40, 1), (7, "a " * 30_000, 0), (8, "a\x1cb a\x85b " * 8, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = runs.periodic_runs(docs, prepare=runs.made_periodic).collect()
    small = [r for r in rows if len(r[1] or "") < 50_000]
    assert len(got) == len(rows)
    by = {r[0]: tuple(r) for r in got}
    for r in small:
        assert by[r[0]] == brute_described(*r[:2])
    assert by[5][1] == 0 and by[7][1:5] == (1, 0, 30_000, 1)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_collapsed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "one  two " + "ha ho " * 10 + "end", "x"), (2, "as  it was", None), (3, None, "y")], "doc_id long, text string, found string")
    got = sorted(map(tuple, runs.collapsed_documents(docs).collect()))
    assert got == [(1, "one two ha ho end", "x"), (2, "as  it was", None), (3, None, "y")]


def brute_edits(rows):
    """(cost, edits) of rows (initial, must, short), from the last one backwards over whole strings."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(4):
            for (p, c), q in step.items():
                if c != "s":
                    best[p] = min(best[p], (best[q][0] + 2, "I" + best[q][1]))
        return best

    best = inserted({0: (0, ""), 1: (99, ""), 2: (99, ""), 3: (0, "")})
    for initial, must, short in reversed(rows):
        now = {}
        for p in range(4):
            ways = [(best[p][0] + 3, "D" + best[p][1])]
            if not must:
                for c, cost, letter in ((initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                    if (p, c) in step:
                        cost += short + best[step[p, c]][0]
                        ways.append((cost, letter + best[step[p, c]][1]))
            now[p] = min(ways)
        best = inserted(now)
    return best[0]


def brute_repair(conv_id, rows):
    """The contract's row for a conversation's rows (turn, role, text)."""
    after = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        after += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
    numbers = [t for t, _, _ in after if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults, seen = [], set()
    for _, role, text in after:
        last = text.strip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    cost, audit = brute_edits([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(after, faults, strict=True)])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
    n = len(audit) - audit.count("D")
    pattern, rest, out = iter("s" * (n % 2) + "ua" * (n // 2)), iter(after), []
    for e in audit:
        row = None if e == "I" else next(rest)
        if e != "D":
            initial = next(pattern)
            role = row[1] if e == "K" else {"u": "user", "a": "assistant"}[initial]
            out.append(f"{role}:{row[2] if row else ''}")
    return (conv_id, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows):
    return sorted((tuple(r) for r in rows.select(*COLUMNS).collect()), key=str)


def test_registered_repair_equals_brute_force(spark, sf_dir):
    convs = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert repaired(llm.queries()["op13_conversation_repair"](spark, sf_dir)) == sorted((brute_repair(*c) for c in convs.items()), key=str)


def test_odd_conversations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("textloom.sources.shared.HOT_ROWS", 5)  # repeated turns are dealt over tasks
    rng = random.Random(8)
    convs = {None: [(None, None, None), (1, "user", "Hi."), (1, "user", "Hi.")], 7: [(3, "user", "Same.")] * 30, 8: [(None, "tool", "x"), (5, "", "y."), (-5, "User", "z")], 9: [(i, "user" if i % 2 else "assistant", f"t{i}. ") for i in range(300)]}
    for i in range(100, 220):
        convs[i] = [(rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["user", "assistant", "system", "user", "tool", None]), rng.choice(["Yes.", "No", " ", "", None, "Well?\n", "a. b"])) for _ in range(rng.randrange(1, 9))]
    rows = [(c, t, r, x, "k") for c, rows in convs.items() for t, r, x in rows]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    assert repaired(repair.op13(table)) == sorted((brute_repair(*c) for c in convs.items()), key=str)
    assert repair.op13(table.limit(0)).count() == 0
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(con.sql(repair.oracle_sql()).fetchall(), key=str) == sorted((brute_repair(*c) for c in convs.items()), key=str)


def test_repaired_turns_are_well_formed(spark, sf_dir):
    turns = repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    for r in turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role"))), lambda x: F.substring(x["role"], 1, 1)), "").alias("roles")).collect():
        assert re.fullmatch("s?(ua)+", r.roles)


def test_long_conversations_are_solved(spark):
    codes = bytes(random.Random(4).choice([0, 1, 2, 2, 1, 3, 5, 9, 10]) for _ in range(3000))
    cost, audit = repair.cheapest(codes)
    again = brute_edits([("sua "[c & 3], bool(c & 4), bool(c & 8)) for c in codes])
    assert (cost, audit) == again
