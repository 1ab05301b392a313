"""Near-duplicate vectors: links of a cosine of at least 0.9, how many each vector has, and their components.

An inverted multi-index (`multi_index`) tells where a vector's neighbours may be. Cells are packed into regions of about `block` vectors; a
vector goes to its own region and visits the others in which it has cells to visit. A region's members are held by a task while its visitors
pass in batches: products of matrices in double precision verify all that meet. Of what is found only counts and a spanning forest of each
batch leave the task, never pairs. A region of many visitors is dealt over several tasks.

Equal vectors are one vector with a weight. Groups of near copies are folded, too: where a cell has many rows, centres are taken from a bounded
sample of it, and what lies within half of the threshold's angle from one is its ball. All of a ball is linked by the triangle inequality;
another vector has all of it, or nothing of it, as neighbours if it is near enough or far enough from the centre, and only in between it
visits the ball's regions. So groups of copies cost their size, not its square. Balls never decide what the exact check would decide otherwise.

Bounds: at most `multi_index.CENTRES` centres a half and `FIT_ROWS_A_CENTRE` rows each for the fit; HOT_CELLS cells are searched for at most BALLS
balls each; counts of cells (a million at most) and figures of balls go through the driver. The walk over cells is probabilistic: a pair at
exactly the threshold is met with probability `target`, closer ones more often.

Results: vectors that are null, empty or zero or hold null or non-finite components link with nothing. Vectors of different lengths don't link
either (each length has an index of its own). A row is a vector: rows that repeat an id are vectors of their own, and link if they are alike. Rows
without an id are counted as others' links; their own component has the smallest id there, or none, and they aren't kept. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import multi_index
from textloom.llm.common import hot_join, small, small_batches, written
from textloom.llm.near_dedup import components
from textloom.sources.tables import dealt

THRESHOLD, TARGET = 0.9, 0.9999
#: Members of a region, and visitors of a region in one task.
BLOCK, VISITORS = 1024, 20_000
#: Rows of a cell that is searched for balls: so many at least, and a share of all rows that at most HOT_CELLS cells can have.
HOT_ROWS, HOT_CELLS, BALLS, BALL_SAMPLE = 2048, 512, 16, 512
#: Vectors that pass a region at once, and angles within which sums of rounding errors stay.
BATCH, _SLACK = 1024, 1e-7


def _number(hexes: Column) -> Column:
    """The long that 16 digits say, with the sign bit turned (as bytes then sort as numbers)."""
    return (F.conv(hexes, 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def _key(id_col: str, *hashes: str) -> Column:
    """Bytes that sort as the id does, nulls last, and tell vectors apart."""
    sortable = F.lpad(F.hex(F.coalesce(F.col(id_col), F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.unhex(F.concat(F.when(F.col(id_col).isNull(), "01").otherwise("00"), sortable, *[F.lpad(F.hex(h), 16, "0") for h in hashes]))


def _id(key: str) -> Column:
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", _number(F.hex(F.substring(key, 2, 8))))


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "vec") -> np.ndarray:
    lists = batch[name]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten()).reshape(batch.num_rows, -1)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each one's component, for n places and edges from a to b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _expanded(first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of first, first + 1, ... for each place."""
    own = np.repeat(np.arange(len(first)), parts)
    return own, first[own] + np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)


def _spread(keys: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(k[-6:], "big") for k in keys], np.int64)


def _hot(celled: DataFrame, counts: np.ndarray, total: int, threshold: float) -> np.ndarray:
    """Centres of balls in the cells of many rows."""
    bar = max(HOT_ROWS, total // HOT_CELLS)
    cells = np.nonzero(counts > bar)[0]
    if not len(cells):
        return np.zeros((0, 0))
    spark, near = celled.sparkSession, np.cos(np.arccos(threshold) / 2)
    # by a hash, each cell gives about BALL_SAMPLE rows
    share = spark.createDataFrame([(int(c), min(1.0, BALL_SAMPLE / int(counts[c]))) for c in cells], "cell long, share double")
    of = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = celled.join(F.broadcast(share), "cell").where(of < F.col("share")).select("cell", "vec")

    def of_cell(table):
        v = multi_index.unit(np.stack(table["vec"].to_numpy()))
        found = []
        while len(v) and len(found) < BALLS:
            alike = v @ v.T >= near
            i = int(alike.sum(axis=1).argmax())
            if alike[i].sum() < max(4, BALL_SAMPLE // 64):
                break
            found.append(multi_index.unit(v[alike[i]].mean(axis=0)[None])[0])
            v = v[(v @ found[-1] < near) & ~alike[i]]
        return table[["cell"]].head(len(found)).assign(vec=[c.tolist() for c in found])

    rows = sample.groupBy("cell").applyInPandas(of_cell, "cell long, vec array<double>").orderBy("cell").collect()  # BALLS * HOT_CELLS at most
    return np.array([r["vec"] for r in rows]) if rows else np.zeros((0, 0))


def _indexed(vectors: DataFrame, total: int, threshold: float, target: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Of vectors(key, w, vec) of one length: (key, links), sums of weights, and edges (a, b) that join what is linked."""
    spark = vectors.sparkSession
    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(max(1_000, multi_index.FIT_ROWS_A_CENTRE * multi_index.size_for(total))).select("vec").toArrow()
    grid = multi_index.fit(multi_index.unit(_matrix(rows)), total, threshold, target)
    del rows
    block = min(block, max(128, total // 64))
    angle = float(np.arccos(threshold))
    shared = spark.sparkContext.broadcast(grid)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(shared.value.cells(multi_index.unit(_matrix(batch))), pa.int64()))

    kind = vectors.schema["vec"].dataType.simpleString()
    celled = written(vectors.mapInArrow(cell, f"key binary, w long, vec {kind}, cell long"), "cells")
    cells = grid.shape[0] * grid.shape[1]

    def counted(table: DataFrame) -> np.ndarray:
        out = np.zeros(cells, np.int64)  # CENTRES^2 at most
        found = table.groupBy("cell").count().toArrow()
        out[found["cell"].to_numpy()] = found["count"].to_numpy()
        return out

    centres = _hot(celled, counted(celled), total, threshold)
    balls, members = {}, celled.withColumn("ball", F.lit(-1).cast("long"))
    if len(centres):
        placed = spark.sparkContext.broadcast(centres)

        def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cos = multi_index.unit(_matrix(batch)) @ placed.value.T
                    own = cos.argmax(axis=1)
                    apart = np.arccos(np.clip(cos[np.arange(len(cos)), own], -1, 1))
                    inside = apart <= angle / 2 - _SLACK
                    yield batch.append_column("ball", pa.array(np.where(inside, own, -1), pa.int64())).append_column("apart", pa.array(apart))

        schema = f"key binary, w long, vec {kind}, cell long, ball long, apart double"
        members = written(celled.mapInArrow(ball, schema), "balls")
        figures = members.where("ball >= 0").groupBy("ball").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("apart").alias("r"), F.min("key").alias("key")).collect()
        balls = {r["ball"]: (r["w"], r["n"], r["r"], bytes(r["key"])) for r in figures}
        members = members.drop("apart")
    first, parts, regions = multi_index.packed(counted(members.where("ball < 0")) if balls else counted(celled), grid.shape, block)
    names = sorted(balls)
    weight, radius = np.array([balls[b][0] for b in names], np.int64), np.array([balls[b][2] for b in names])
    ball_parts = np.array([-(-balls[b][1] // block) for b in names], np.int64)
    ball_first = regions + np.cumsum(ball_parts) - ball_parts
    lead = [balls[b][3] for b in names]
    place = {b: i for i, b in enumerate(names)}
    tables = spark.sparkContext.broadcast((first, parts, centres[names] if names else None, weight, radius, ball_first, ball_parts, lead, place))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, centres, weight, radius, ball_first, ball_parts, lead, place = tables.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v, keys = multi_index.unit(_matrix(batch)), batch["key"].to_pylist()
            spread = _spread(keys)
            own = np.array([place.get(b, -1) for b in batch["ball"].to_pylist()], np.int64)
            cold = np.nonzero(own < 0)[0]
            home = np.zeros(n, np.int64)
            c = batch["cell"].to_numpy()[cold]
            home[cold] = first[c] + spread[cold] % np.maximum(parts[c], 1)
            r, c = shared.value.visited(v[cold])
            there = parts[c] > 0
            r, c = cold[r[there]], c[there]
            i, region = _expanded(first[c], parts[c])
            pairs = [np.stack([r[i], region])]
            links, joined = np.zeros(n, np.int64), [[] for _ in range(n)]
            wholly = np.zeros((n, 0), bool)
            if len(weight):
                hot = np.nonzero(own >= 0)[0]
                home[hot] = ball_first[own[hot]] + spread[hot] % ball_parts[own[hot]]
                apart = np.arccos(np.clip(v @ centres.T, -1, 1))
                later = np.arange(len(weight))[None] > own[:, None]  # of two balls the first one's members do the visiting
                wholly = later & (apart + radius <= angle - _SLACK)
                maybe = later & ~wholly & (apart - radius <= angle + _SLACK)
                links += wholly @ weight
                w = batch["w"].to_numpy()
                links[hot] += weight[own[hot]] - w[hot]
                for x, b in zip(*np.nonzero(wholly), strict=True):
                    joined[x].append(lead[b])
                for x in hot:
                    joined[x].append(lead[own[x]])
                x, b = np.nonzero(maybe)
                i, region = _expanded(ball_first[b], ball_parts[b])
                pairs.append(np.stack([x[i], region]))
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            edges = np.searchsorted(both[0], np.arange(n + 1))
            routes = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(both[1], pa.int64()))
            x, b = np.nonzero(wholly)
            sure = pa.ListArray.from_arrays(pa.array(np.searchsorted(x, np.arange(n + 1)), pa.int32()), pa.array(b, pa.int64()))
            arrays = [batch["key"], batch["w"], batch["vec"], pa.array(home), routes, pa.array(own), pa.array(links), sure, pa.array(joined, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "w", "vec", "home", "routes", "ball", "links", "sure", "joined"])

    schema = f"key binary, w long, vec {kind}, home long, routes array<long>, ball long, links long, sure array<long>, joined array<binary>"
    routed = written(members.mapInArrow(route, schema), "routes")
    found = written(_met(routed, threshold), "met")
    links = found.select("key", "links")
    edges = found.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b"))
    if names:
        links = links.unionByName(routed.where("links > 0").select("key", "links"))
        # what a ball's members gain from those that have all of it: a sum a ball
        gained = routed.select("w", F.explode("sure").alias("ball")).groupBy("ball").agg(F.sum("w").alias("links"))
        links = links.unionByName(routed.where("ball >= 0").select("key", "ball").join(F.broadcast(gained), "ball").select("key", "links"))
        edges = edges.unionByName(routed.select(F.col("key").alias("a"), F.explode("joined").alias("b")).where("a <> b"))
    return links.groupBy("key").agg(F.sum("links").alias("links")), edges


def _met(routed: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other): of each batch of visitors, who has how many links there, and the one that stands for what it is joined with."""
    visits = routed.select(F.explode("routes").alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("visits"))
    salts = written(visits.withColumn("salts", F.ceil(F.col("visits") / F.lit(float(VISITORS))).cast("int")), "visits").where("salts > 1").select("region", "salts")
    salts = small(salts, salts.count())
    came = routed.select("key", "w", "vec", "home", F.explode("routes").alias("region")).join(salts, "region", "left")
    came = came.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key"), F.col("salts").cast("long")).cast("int"), F.lit(0)))
    held = routed.withColumn("region", F.col("home")).join(salts, "region", "left")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    names = ["region", "salt", "held", "key", "w", "vec", "home", "routes"]
    held = held.withColumn("held", F.lit(0)).select(names)
    came = came.withColumns({"held": F.lit(1), "routes": F.lit(None).cast("array<long>")}).select(names)
    rows = held.unionByName(came).repartition("region", "salt").sortWithinPartitions("region", "salt", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, None
        for batch in batches:
            place = np.stack([batch[c].to_numpy() for c in ("region", "salt", "held")], axis=1)
            edges = np.nonzero(np.r_[True, (place[1:] != place[:-1]).any(axis=1), True])[0] if batch.num_rows else []
            for a, b in zip(edges, edges[1:], strict=False):
                region, salt, role = place[a]
                part = batch.slice(a, b - a)
                if role == 0:
                    members = members + [part] if now == (region, salt) and isinstance(members, list) else [part]
                    now = (region, salt)
                    continue
                if now != (region, salt):
                    now, members = (region, salt), []
                if isinstance(members, list):
                    members = _Members(members)
                for at in range(0, part.num_rows, BATCH):
                    if (out := members.meet(part.slice(at, BATCH), region, threshold)) is not None:
                        yield out

    return rows.mapInArrow(run, "key binary, links long, other binary")


class _Members:
    """The vectors of a region."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.keys = [k for p in parts for k in p["key"].to_pylist()]
        self.raw = np.concatenate([_matrix(p).astype(np.float64) for p in parts]) if parts else np.zeros((0, 0))
        self.unit = multi_index.unit(self.raw) if parts else self.raw
        self.w = np.concatenate([p["w"].to_numpy() for p in parts]) if parts else np.zeros(0, np.int64)
        lengths = np.array([len(r) for p in parts for r in p["routes"].to_pylist()], np.int64)
        self.owner = np.repeat(np.arange(len(self.keys)), lengths)
        self.routes = np.concatenate([p["routes"].flatten().to_numpy() for p in parts]) if parts else np.zeros(0, np.int64)
        self.place = np.array(self.keys, object)

    def meet(self, part: pa.RecordBatch, region: int, threshold: float) -> pa.RecordBatch | None:
        if not self.keys:
            return None
        raw = _matrix(part).astype(np.float64)
        cos = multi_index.unit(raw) @ self.unit.T
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):
            cos[i, j] = _cosine(raw[i], self.raw[j])
        x, y = np.nonzero(cos >= threshold)
        if not len(x):
            return None
        home, keys = part["home"].to_numpy(), np.array(part["key"].to_pylist(), object)
        # members that visit the visitor's region as well meet it there: such a pair counts where the smaller key is the visitor
        homes, of = np.unique(home, return_inverse=True)
        at = np.minimum(np.searchsorted(homes, self.routes), len(homes) - 1)
        back = np.zeros((len(self.keys), len(homes)), bool)
        back[self.owner[homes[at] == self.routes], at[homes[at] == self.routes]] = True
        once = ~back[y, of[x]] | (keys[x] < self.place[y])
        x, y = x[once], y[once]
        if not len(x):
            return None
        n = len(keys)
        w = part["w"].to_numpy()
        links = np.concatenate([np.bincount(x, self.w[y], n), np.bincount(y, w[x], len(self.keys))]).astype(np.int64)
        label = _labels(n + len(self.keys), x, n + y)
        both = np.concatenate([keys, self.place])
        on = np.nonzero(links)[0]
        return pa.RecordBatch.from_arrays([pa.array(both[on], pa.binary()), pa.array(links[on]), pa.array(both[label[on]], pa.binary())], names=["key", "links", "other"])


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """The plain double-precision cosine, for numbers so near the threshold that rounding decides."""
    dot = x = y = 0.0
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        dot, x, y = dot + p * q, x + p * p, y + q * q
    return dot / (x * y) ** 0.5 if 0 < x * y < float("inf") else float(multi_index.unit(a[None])[0] @ multi_index.unit(b[None])[0])


def embedding_dedup(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept."""
    small_batches(rows.sparkSession)
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(vec.isNotNull() & fine, F.lit(False)).alias("fine"))
    every = every.withColumns({"h": F.when(F.col("fine"), F.xxhash64("vec")), "g": F.when(F.col("fine"), F.xxhash64(F.lit(1), "vec"))})
    copies = every.where("fine").groupBy("h", "g").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"))
    vectors = written(copies.select(_key("vec_id", "h", "g").alias("key"), "h", "g", "w", "vec"), "vectors")
    sums, edges = None, None
    # an index for each length of vectors: mostly there is one
    for r in vectors.groupBy(F.size("vec").alias("length")).count().orderBy("length").collect():
        own = dealt(vectors.where(F.size("vec") == r["length"]).select("key", "w", "vec"))
        links, joins = _indexed(own, r["count"], threshold, target, block)
        sums, edges = (links, joins) if sums is None else (sums.unionByName(links), edges.unionByName(joins))
    if sums is None:
        sums = vectors.select("key", F.lit(0).cast("long").alias("links")).limit(0)
        label = vectors.select("key", F.col("key").alias("label")).limit(0)
    else:
        label = components(edges, "a", "b")
    # vectors without any link need no row
    of = vectors.select("key", "h", "g", "w").join(sums, "key", "left").join(label, "key", "left").where("w > 1 or links > 0")
    of = written(of.select("h", "g", "w", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), _id("label").alias("joined"), _id("key").alias("own")), "linked")
    out = hot_join(every.select("vec_id", "h", "g"), of, ["h", "g"], "w", F.monotonically_increasing_id(), how="left")
    component = F.when(F.col("w").isNull(), F.col("vec_id")).otherwise(F.coalesce("joined", "own"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def kept_vectors(rows: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """The rows, with their own columns, of the vectors that stay: one for each component."""
    kept = embedding_dedup(rows, id_col=id_col, **options).where("kept").select(F.col("vec_id").alias("__id")).distinct()
    return rows.join(kept, F.col(id_col) == F.col("__id"), "left_semi")


#: All pairs: for tables of some thousand vectors.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE fine),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
