"""Near-duplicate classes by DartMinHash signatures, banding and an exact check.

1. Exact copies are folded by the digest index; what follows sees every text once.
2. A text is the set of its five-word shingles, each of weight 1 however often it occurs, as in the exact check. Its
   DartMinHash signature of 128 coordinates is cut into 32 bands of 4: texts of similarity 0.8 miss each other in all
   bands with probability 5e-8.
3. Families: in every bucket (texts that agree in a band) all members are compared, by signature, with one leader. An
   estimate of ``JOIN`` or more puts both in a family; one of ``LEAVE`` or more takes the member out of the bucket, else it
   stays for the next leader. By the triangle inequality of Jaccard distance a partner (0.8 or more) of a member that left
   is itself joined with that leader, so no link leaves its family. What still shares a bucket after ``ROUNDS`` leaders is
   joined unseen: families may be too large, never too small.
4. Links: families are cut into blocks of some hundred texts, each with some of the family's leaders, and the exact
   Jaccard similarity of shingle sets is counted for all pairs of a block by matrix products; a block returns the spanning
   links only. A family of several blocks that is not yet one class goes through a second pass of block pairs, without
   those whose texts are all of one class. Where a block would meet more than ``REFINE`` others on average, as pages of one
   template make it, the family is first cut by prefixes: with shingles ordered from rare to frequent, two sets of similarity 0.8 or more share one among the first fifth of
   each, so only texts that do stay together, and each text still lies in one family. So all pairs are compared that could still
   join two classes, no pairs are ever shuffled, and a text is sent to few blocks unless many texts hang together by their
   rarest shingles.
5. Classes are the connected components of the links.

Defined results: null texts count as empty; texts without words are similar to their exact copies only; a text of fewer
than five words is one shingle; class_id is the smallest id of the class (nulls only if it has no other); exactly one
row of each class is kept, one of class_id; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import dart_minhash, exact_dedup
from textloom.llm.common import BROADCAST_ROWS, hot_join, small, small_batches, written
from textloom.sources.tables import dealt

THRESHOLD, K, BAND_ROWS = 0.8, 128, 4
JOIN, LEAVE, ROUNDS = 0.4, 0.75, 2
#: Texts of a block, and leaders that each block of a family gets besides.
BLOCK, HUBS = 256, 8
#: Pairs of blocks, for each block of a family, beyond which the family is cut by prefixes first.
REFINE = 8
#: Texts from which a shingle may count as frequent, and frequent shingles that the workers get.
FREQUENT, FREQUENT_ROWS = 32, 50_000
#: Members from which a bucket is looked at by itself.
HOT_BUCKET = 1000
#: What one pass of the signature arrays handles.
CHUNK_CHARS, CHUNK_TEXTS = 1_000_000, 400
_COLUMNS = 4096


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        keys, texts, chars = [], [], 0
        for key, text in zip(batch["key"], batch["text"], strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py())
            chars += len(texts[-1])
            if chars >= CHUNK_CHARS or len(texts) >= CHUNK_TEXTS:
                yield keys, texts
                keys, texts, chars = [], [], 0
        if keys:
            yield keys, texts


def signed(texts: DataFrame, *, width: int = dart_minhash.SHINGLE_WORDS, k: int = K, rows: int = BAND_ROWS) -> DataFrame:
    """key, sketch (a byte for each coordinate) and bands of texts(key, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, chunk in _chunks(batches):
            sets, element, _ = dart_minhash.shingles(chunk, width)
            signature = dart_minhash.signatures(sets, element, np.ones(len(sets)), len(chunk), k)
            bands = dart_minhash.bands(signature, rows)
            has = np.nonzero(np.bincount(sets, minlength=len(chunk)))[0]
            sketch = (signature >> np.uint64(17)).astype(np.uint8)
            cols = [pa.array([keys[i] for i in has], pa.binary()), pa.array([sketch[i].tobytes() for i in has], pa.binary()), pa.array([bands[i].view(np.int64) for i in has], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "sketch", "bands"])

    return texts.select("key", "text").mapInArrow(run, "key binary, sketch binary, bands array<long>")


def shingled(texts: DataFrame, *, width: int = dart_minhash.SHINGLE_WORDS) -> DataFrame:
    """key and the ascending shingle hashes of texts(key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, chunk in _chunks(batches):
            sets, element, _ = dart_minhash.shingles(chunk, width)
            edges = np.searchsorted(sets, np.arange(len(chunk) + 1))
            hashes = [element[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.binary())], names=["key", "hashes"])

    return texts.select("key", "text").mapInArrow(run, "key binary, hashes binary")


def _estimated(pairs: DataFrame, sketches: DataFrame, lead: DataFrame) -> DataFrame:
    """pairs(key, leader) with the similarity that their sketches say; lead(bucket, leader, n) tells how often a leader comes at most."""
    a = sketches.select("key", F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("key").alias("leader"), F.col("sketch").alias("sketch_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            agree = (x == y).mean(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["leader"], pa.array((agree - 1 / 256) * (256 / 255))], names=["key", "leader", "similarity"])

    # a leader may have a third of all texts
    b = written(lead.groupBy("leader").agg(F.sum("n").alias("led")).join(b, "leader"), "leader-sketches")
    met = hot_join(pairs.join(a, "key"), b, "leader", "led", F.xxhash64("key"))
    return met.select("key", "leader", "sketch_a", "sketch_b").mapInArrow(run, "key binary, leader binary, similarity double")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(key, label): of every node of the edges, the smallest key of its connected component. In a round a node takes the smallest of
    its neighbours' labels and of its label's label; the rounds are about the logarithm of the largest distance. While the nodes are few (counted)
    their labels are broadcast, and edges stay where they lie; else nodes of many neighbours and labels of many nodes are dealt over tasks."""
    two = edges.select(F.col(a).alias("key"), F.col(b).alias("other"))
    both = written(two.unionByName(two.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct(), "edges")
    labels = written(both.groupBy("key").agg(F.least(F.min("other"), F.first("key")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    few = labels.count() <= BROADCAST_ROWS
    while True:
        beside = labels.select(F.col("key").alias("other"), "label", "degree")
        next_ = labels.select(F.col("key").alias("label"), F.col("label").alias("next"))
        if few:
            met, jumped = both.join(F.broadcast(beside), "other"), labels.join(F.broadcast(next_), "label")
        else:
            met = hot_join(both, beside, "other", "degree", F.xxhash64("key"))
            own = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
            jumped = hot_join(labels, written(own.join(next_, "label"), "next"), "label", "members", F.xxhash64("key"))
        near = met.groupBy("key").agg(F.min("label").alias("near"))
        new = written(jumped.join(near, "key").select("key", F.least("label", "near", "next").alias("label"), "degree", F.col("label").alias("old")), "labels")
        labels = new.select("key", "label", "degree")
        if new.where("label <> old").isEmpty():
            return labels.select("key", "label")


def _stars(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, first): what edges(key, other) join, by fewer: of each key the edge to its smallest other, and those of its others to that one."""
    own = edges.groupBy(F.col(key).alias("key")).agg(F.min(other).alias("first"), F.collect_list(other).alias("others"))
    return own.select("key", "first").unionByName(own.select(F.explode("others").alias("key"), "first").where("key <> first")).distinct()


def _led(pool: DataFrame, lead: DataFrame) -> DataFrame:
    """pool(key, bucket) with the leaders lead(bucket, leader, n). The buckets of most members, as many as may be broadcast,
    meet their members where these lie; only the rest is shuffled by bucket."""
    sizes = [HOT_BUCKET * 10**i for i in range(10)]
    counts = lead.agg(*[F.count(F.when(F.col("n") > s, 1)) for s in sizes]).first()
    size, n = next((s, n) for s, n in zip(sizes, counts, strict=True) if n <= BROADCAST_ROWS)
    if not n:
        return pool.join(lead.drop("n"), "bucket")
    large = F.broadcast(lead.where(F.col("n") > size).drop("n"))
    rest = pool.join(large, "bucket", "left_anti").join(lead.where(F.col("n") <= size).drop("n"), "bucket")
    return pool.join(large, "bucket").unionByName(rest)


def families(sketches: DataFrame, *, join: float = JOIN, leave: float = LEAVE, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(key, family) of every text that may have a partner, and (family, key) of its leaders by use."""
    pool = sketches.select("key", F.explode("bands").alias("bucket"))
    edges = []
    for i in range(rounds + 1):
        lead = written(pool.groupBy("bucket").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "lead")
        led = written(_led(pool, lead).where("key <> leader"), "led")
        pairs = led.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("buckets"))
        if i == rounds:
            edges.append(pairs.select("key", "leader"))
            break
        seen = written(_estimated(pairs.select("key", "leader"), sketches, lead), "seen")
        edges.append(seen.where(F.col("similarity") >= join).select("key", "leader"))
        pool = written(led.join(seen.where(F.col("similarity") < leave), ["key", "leader"], "left_semi").select("key", "bucket"), "pool")
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    every = written(every.distinct(), "family-edges")
    # a text has as many leaders as bands and rounds, at most
    of = components(_stars(every, "key", "leader"), "key", "first").withColumnRenamed("label", "family")
    leaders = every.groupBy(F.col("leader").alias("key")).agg(F.count(F.lit(1)).alias("led")).join(of, "key")
    return of, leaders


def spanning_links(hashes: list[np.ndarray], label: list[int], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs of sets of Jaccard similarity ``threshold`` or more, only as many as join what labels do not join yet."""
    n = len(hashes)
    size = np.array([len(h) for h in hashes], np.float64)
    if n == 2:
        both = np.array([[0.0, len(np.intersect1d(*hashes, assume_unique=True))], [0.0, 0.0]])
    else:
        rows = np.repeat(np.arange(n), size.astype(np.int64))
        _, column, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared = count > 1
        keep = shared[column]
        rows, column = rows[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        both = np.zeros((n, n))
        total = int(shared.sum())
        for c in range(0, total, _COLUMNS):
            lo, hi = np.searchsorted(column, [c, c + _COLUMNS])
            dense = np.zeros((n, min(_COLUMNS, total - c)), np.float32)
            dense[rows[lo:hi], column[lo:hi] - c] = 1
            both += dense @ dense.T
    similar = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9) & (both > 0)
    parent = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        x, y = root(label[i]), root(label[j])
        if x != y:
            parent[y] = x
            out.append((int(i), int(j)))
    return out


def _links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b) links of blocks(block, key, label, hashes): a block's rows go to one task, one after another."""
    dealt = blocks.repartition("block").sortWithinPartitions("block", "key").select("block", "key", "label", "hashes")

    def solve(rows: list[tuple]) -> tuple[list, list]:
        names = {x: i for i, x in enumerate({r[1] for r in rows})}
        found = spanning_links([np.frombuffer(r[2], np.uint64) for r in rows], [names[r[1]] for r in rows], threshold) if len(rows) > 1 else []
        return [rows[i][0] for i, _ in found], [rows[j][0] for _, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            a, b = [], []
            for block, *row in zip(*(batch[c].to_pylist() for c in ("block", "key", "label", "hashes")), strict=True):
                if block != now:
                    x, y = solve(rows)
                    a, b, now, rows = a + x, b + y, block, []
                if not rows or rows[-1][0] != row[0]:  # a hub may be dealt to its own block twice
                    rows.append(row)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a, b = solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _first_pass(of: DataFrame, leaders: DataFrame, sets: DataFrame, threshold: float, block: int, hubs: int) -> DataFrame:
    """Links within blocks of each family, of which all have the family's most used leaders."""
    sizes = of.groupBy("family").agg(F.count(F.lit(1)).alias("in_family"))
    sizes = written(sizes.withColumn("blocks", F.ceil(F.col("in_family") / F.lit(float(block)))), "families")
    dealt = hot_join(of, sizes, "family", "in_family", F.xxhash64("key")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("blocks")))
    by_use = Window.partitionBy("family").orderBy(F.desc("led"), "key")
    top = hot_join(leaders, sizes.where("blocks > 1"), "family", "in_family", F.xxhash64("key")).withColumn("place", F.row_number().over(by_use)).where(F.col("place") <= hubs)
    top = top.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = dealt.select("family", "key", "part").unionByName(top.select("family", "key", "part")).distinct()
    rows = rows.select(F.concat(F.hex("family"), F.lit(":"), "part").alias("block"), "key", F.col("key").alias("label"))
    return _links(rows.join(sets, "key"), threshold)


def prefix(hashes: np.ndarray, frequent: np.ndarray, times: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Of a set's shingles those of which a set as similar as the threshold must share one, which has them among its own: the
    first ones in the order of times (of frequent shingles, ascending; else 0) and hash."""
    n = len(hashes)
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, times[at], 0)
    return hashes[np.lexsort((hashes, rank))][: n - int(np.ceil(threshold * n - 1e-9)) + 1]


def _refined(inside: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, sub) of the texts inside(family, key) that share a prefix shingle with another one of their family."""
    texts = written(inside.select("family", "key").join(sets, "key").select("family", "key", "hashes"), "large-families")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch["hashes"].to_pylist()), np.int64))], names=["shingle"])

    counts = written(texts.select("hashes").mapInArrow(every, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT), "frequent")
    sizes = [FREQUENT * 4**i for i in range(16)]
    rows = counts.agg(*[F.count(F.when(F.col("n") > s, 1)) for s in sizes]).first()
    size = next(s for s, n in zip(sizes, rows, strict=True) if n <= FREQUENT_ROWS)
    found = np.array([(r["shingle"], r["n"]) for r in counts.where(F.col("n") > size).collect()], np.int64).reshape(-1, 2)  # FREQUENT_ROWS at most
    frequent = found[:, 0].copy().view(np.uint64)
    order = np.argsort(frequent)
    shared = texts.sparkSession.sparkContext.broadcast((frequent[order], found[order, 1]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [prefix(np.frombuffer(h, np.uint64), *shared.value, threshold) for h in batch["hashes"].to_pylist()]
            own = pa.array(np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["family"].take(own), batch["key"].take(own), pa.array(np.concatenate([*chosen, np.zeros(0, np.uint64)]).view(np.int64))], names=["family", "key", "shingle"])

    held = written(texts.mapInArrow(first, "family binary, key binary, shingle long"), "prefixes")
    met = written(held.groupBy("family", "shingle").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "met")
    edges = hot_join(held, met, ["family", "shingle"], "n", F.xxhash64("key")).where("key <> first").select("key", "first").distinct()
    return components(_stars(edges, "key", "first"), "key", "first").withColumnRenamed("label", "sub")


def _classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many texts each class of a family has, and each family, of rows(family, key, label)."""
    n = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("in_class"))
    return n, n.groupBy("family").agg(F.sum("in_class").alias("in_family"), F.count(F.lit(1)).alias("classes"))


def _sided(classes: DataFrame, block: int) -> DataFrame:
    """classes(family, label, in_class, ...) with what their family's second pass takes: texts in small classes, sides (blocks of one large
    class or of small ones) and pairs of sides that meet."""
    classes = written(classes, "open")
    own = F.col("in_class") >= block // 2
    parts = F.when(own, F.ceil(F.col("in_class") / F.lit(float(block)))).otherwise(0)
    by = classes.groupBy("family").agg(F.sum(F.when(~own, F.col("in_class")).otherwise(0)).alias("in_small"), F.sum(parts).alias("own"), F.sum(parts * (parts + 1) / 2).alias("same"))
    sides = F.col("own") + F.ceil(F.col("in_small") / F.lit(float(block)))
    by = by.select("family", "in_small", sides.alias("sides"), (sides * (sides + 1) / 2 - F.col("same")).alias("met"))
    return written(classes.join(by, "family"), "open")


def _second_pass(of: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float, block: int, refine: int) -> DataFrame | None:
    """Links between classes of families of more than one block, or None if there is no such family of several classes.
    A class that fills half a block or more has blocks of its own; pairs of these of one class are left out."""
    rows = of.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).select("family", "key", "label")
    n, every = _classes_of(rows)
    open_ = _sided(n.join(every.where((F.col("in_family") > block) & (F.col("classes") > 1)), "family"), block)
    large = open_.where(F.col("met") > refine * F.col("sides")).groupBy("family").agg(F.max("in_family").alias("in_family"))
    if not large.isEmpty():
        large = written(large, "large")
        # one row a key, so that the cut families and the others have nothing in common
        inside = written(hot_join(rows, large, "family", "in_family", F.xxhash64("key")).select("family", "key", "label"), "inside")
        again = written(inside.drop("family").join(_refined(inside, sets, threshold).withColumnRenamed("sub", "family"), "key").select("family", "key", "label"), "again")
        m, each = _classes_of(again)
        others = written(open_.where(F.col("met") <= refine * F.col("sides")), "others")
        rest = hot_join(rows, others.groupBy("family").agg(F.max("in_family").alias("in_family")), "family", "in_family", F.xxhash64("key"))
        rows = rest.select("family", "key", "label").unionByName(again)
        open_ = written(others.unionByName(_sided(m.join(each.where("classes > 1"), "family"), block)), "open")
    if open_.isEmpty():
        return None
    own = F.col("in_class") >= block // 2
    parts = F.ceil(F.when(own, F.col("in_class")).otherwise(F.col("in_small")) / F.lit(float(block)))
    rows = hot_join(rows, open_, ["family", "label"], "in_class", F.xxhash64("key")).withColumn("part", F.pmod(F.xxhash64("key"), parts))
    rows = rows.withColumn("side", F.concat(F.when(own, F.hex("label")).otherwise(F.lit("mixed")), F.lit(":"), "part")).withColumn("of_class", F.when(own, F.col("label")))
    rows = written(rows.select("family", "label", "key", "side", "of_class"), "sides")
    sides = rows.groupBy("family", "side").agg(F.first("of_class").alias("of_class"))
    x, y = (sides.select("family", F.col("side").alias(s), F.col("of_class").alias(f"{s}_class")) for s in ("x", "y"))
    met = x.join(y, "family").where("x <= y and not coalesce(x_class = y_class, false)")
    met = met.withColumn("block", F.concat(F.hex("family"), F.lit(":"), "x", F.lit("+"), "y"))
    ends = met.select("family", F.col("x").alias("side"), "block").unionByName(met.where("x <> y").select("family", F.col("y").alias("side"), "block"))
    return _links(rows.join(sets, "key").join(ends, ["family", "side"]).select("block", "key", "label", "hashes"), threshold)


def classes(texts: DataFrame, *, threshold: float = THRESHOLD, width: int = dart_minhash.SHINGLE_WORDS, block: int = BLOCK, hubs: int = HUBS, refine: int = REFINE) -> DataFrame:
    """(key, label) of texts(key binary, text), a written table's, that have a near-duplicate: label is the smallest key of the class."""
    small_batches(texts.sparkSession)
    sketches = written(signed(dealt(texts), width=width), "sketches")
    of, leaders = families(sketches)
    n = of.count()
    wanted = texts.join(small(of.select("key"), n), "key", "left_semi")
    sets = written(shingled(wanted, width=width), "sets")
    links = written(_first_pass(of, leaders, sets, threshold, block, hubs), "links")
    labels = components(links, "a", "b")
    more = _second_pass(of, labels, sets, threshold, block, refine)
    if more is not None:
        more = written(more, "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more), "a", "b")
    return labels


def _folded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`exact_dedup.annotate` with the key of each row's text."""
    return exact_dedup.annotate(docs, id_col=id_col, text_col=text_col, keep="min").withColumn("__key", F.unhex(F.substring("__digest", 1, 32)))


def _texts(folded: DataFrame, text_col: str) -> DataFrame:
    """(key, text) of every different text of folded rows, which are those kept."""
    return folded.select(F.col("__key").alias("key"), F.coalesce(F.col("__doc")[text_col].cast("string"), F.lit("")).alias("text"))


def _decided(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """(__key, class_id, class_size, stays) of every text with a near-duplicate, of the kept rows of the folded table."""
    of = written(kept.select("__key", "__keep_id", "__n").join(labels.select(F.col("key").alias("__key"), "label"), "__key"), "classes")
    first = F.min(F.struct(F.col("__keep_id").isNull().alias("none"), F.col("__keep_id").alias("id"), "__key")).alias("first")
    by = written(of.groupBy("label").agg(first, F.sum("__n").alias("class_size"), F.count(F.lit(1)).alias("members")), "firsts")
    out = hot_join(of, by, "label", "members", F.xxhash64("__key"))
    return out.select("__key", F.col("first.id").alias("class_id"), "class_size", (F.col("__key") == F.col("first.__key")).alias("stays"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id, class_size and kept."""
    every = _folded(docs.select(id_col, text_col), id_col, text_col)
    # one write serves what follows: texts go with the rows that are kept only
    doc = F.when(F.col("__kept"), F.col("__doc")).alias("__doc")
    folded = written(every.select("__id", "__key", "__keep_id", "__n", "__kept", doc), "folded")
    kept = folded.where("__kept")
    labels = classes(_texts(kept, text_col), **options)
    decided = written(_decided(kept, labels), "decided")
    rows = folded.drop("__doc")
    if decided.count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(decided), "__key", "left")
    else:
        sized = written(decided.join(kept.select("__key", F.col("__n").alias("copies")), "__key"), "decided")
        out = hot_join(rows, sized, "__key", "copies", F.xxhash64("__id"), how="left")
    near = F.col("class_size").isNotNull()
    return out.select(
        F.col("__id").alias("doc_id"),
        F.when(near, F.col("class_id")).otherwise(F.col("__keep_id")).alias("class_id"),
        F.coalesce("class_size", "__n").alias("class_size"),
        (F.col("__kept") & F.coalesce("stays", F.lit(True))).alias("kept"),
    )


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with its own columns."""
    kept = written(_folded(docs, id_col, text_col).where("__kept").select("__key", "__keep_id", "__n", "__doc"), "folded")
    labels = classes(_texts(kept, text_col), **options)
    go = written(_decided(kept, labels).where("not stays").select("__key"), "go")
    return kept.join(small(go, go.count()), "__key", "left_anti").select("__doc.*")
