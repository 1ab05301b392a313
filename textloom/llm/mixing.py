"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put into a pseudo-random order (a hash of the id), and again for each further epoch. A
document's virtual finish time is its source's cumulative size up to and with it, divided by the source's target; so all
sources reach their targets at virtual time 1. The global order is by finish time, and the mix is cut where the running
total would pass the budget. Cumulative sums never gather a source in one task: sources are cut into buckets of hash
order of about ``BUCKET_ROWS`` rows, the buckets' sums are added up, and rows are added up within their bucket. The
global cut is found likewise by bins of finish time, of which only the one with the cut is looked at row by row.

Defined results: a null text has size 0; a null source is a source of its own, last in order; sources of size 0 have
target 0; rows that repeat an id are mixed as rows of their own, the smaller first (`mixed_documents` takes them all as often as
the first); an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD, hot_join, small, text_or_empty, written

#: Rows that one task adds up in order.
BUCKET_ROWS = 20_000
#: Sources whose last documents may be broadcast.
SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sized: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: size, documents and target. Targets are in proportion to weight, none above ``most`` times its
    source's size; what is above goes to the others by weight. There is one row a source, so one task orders them."""
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)) + 1)
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = by.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    # sources reach their caps in the order of cap / weight; the level is where the rest of the budget meets the rest
    order = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("budget") - capped) / rest)
    # of the sources below their caps the first sets the level; those after it would give less
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    by = by.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return by.select("source", "source_size", "n", "weight", target.alias("target"), "budget")


def _place(id_col: str, epoch: int, seed: str) -> Column:
    """The place of a document in an epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _timed(sized: DataFrame, by: DataFrame, epochs: int, seed: str) -> DataFrame:
    """sized with source_size, target, budget and for each epoch e place_e and finish_e."""
    out = sized.join(by.withColumn("buckets", F.ceil(F.col("n") / F.lit(float(BUCKET_ROWS)))), sized["source"].eqNullSafe(by["source"])).drop(by["source"])
    for e in range(epochs):
        at = F.conv(F.substring(f"place_{e}", 1, 8), 16, 10).cast("long")
        out = out.withColumn(f"place_{e}", _place("id", e, seed)).withColumn(f"bucket_{e}", F.floor(at * F.col("buckets") / F.lit(2.0**32)))
    for e in range(epochs):
        # a null source has the key "-", any other its value behind "+"
        key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("key")
        sums = out.groupBy(key, F.col(f"bucket_{e}").alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        before = F.sum("in_bucket").over(Window.partitionBy("key").orderBy("bucket")) - F.col("in_bucket")
        sums = sums.select("key", "bucket", before.alias("before"))
        run = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy(f"place_{e}", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn("key", key).withColumn("bucket", F.col(f"bucket_{e}")).withColumn("run", run).join(sums, ["key", "bucket"])
        passed = F.col("before") + F.col("run") + F.lit(e) * F.col("source_size")
        out = out.withColumn(f"finish_{e}", F.when(F.col("target") > 0, passed / F.col("target")).otherwise(F.lit(0.0)))
        out = out.drop("key", "bucket", "run", "before", f"bucket_{e}")
    return out.drop("buckets", "n", "weight")


def _key(e: int) -> Column:
    return F.struct(F.col(f"finish_{e}").alias("finish"), F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("~")).alias("source"), F.lit(e).alias("epoch"), F.col(f"place_{e}").alias("place"), F.col("id").alias("id"))


def _mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> tuple[DataFrame, int, list[Column]]:
    """The timed documents, the number of sources, and of each epoch whether a document's place is in the mix."""
    size = word_count(text_or_empty(text_col)) if size is None else size
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sized")
    by = written(targets(sized, weights=weights, share=share, most=most).coalesce(1), "targets")
    rows, n_sources, budget = by.agg(F.sum("n"), F.count(F.lit(1)), F.max("budget")).first()
    timed = written(_timed(sized.select("id", "source", "size"), small(by, n_sources), most, seed), "timed")

    # the bin of finish time in which the running total passes the budget
    bins = max(1, math.ceil((rows or 0) * most / BUCKET_ROWS))
    entries = timed.select(F.explode(F.array(*[F.struct(_key(e).alias("key"), F.col("size").alias("size")) for e in range(most)])).alias("x")).select("x.*")
    entries = entries.withColumn("bin", F.floor(F.col("key.finish") * bins))
    by_bin = entries.groupBy("bin").agg(F.sum("size").alias("in_bin")).withColumn("part", F.floor(F.col("bin") / 1000))
    by_part = by_bin.groupBy("part").agg(F.sum("in_bin").alias("in_part"))
    by_part = by_part.select("part", (F.sum("in_part").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("in_part")).alias("before"))
    total = F.sum("in_bin").over(Window.partitionBy("part").orderBy("bin"))
    ends = by_bin.withColumn("end", total).join(by_part, "part").select("bin", (F.col("end") + F.col("before")).alias("end"), (F.col("end") + F.col("before") - F.col("in_bin")).alias("begin"))
    cut = ends.where(F.col("end") > F.lit(budget or 0.0)).orderBy("bin").first()
    if cut is None:
        within = lambda e: F.lit(True)
    else:
        run = F.sum("size").over(Window.partitionBy("bin").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        inside = entries.where(F.col("bin") == cut["bin"]).withColumn("run", run + F.lit(cut["begin"]))
        last = inside.where(F.col("run") <= F.lit(budget)).agg(F.max("key").alias("key")).first()["key"]
        if last is None:
            within = lambda e: F.floor(F.col(f"finish_{e}") * bins) < cut["bin"]
        else:
            kinds = timed.select(_key(0).alias("key")).schema["key"].dataType
            key = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kinds.fields])
            within = lambda e: _key(e) <= key
    return timed, n_sources, [within(e) for e in range(most)]


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, epochs (times it is in the mix) and the
    finish time of its first epoch."""
    timed, _, within = _mixed(docs, **options)
    epochs = sum((w.cast("int") for w in within[1:]), within[0].cast("int"))
    out = timed.withColumn("epochs", epochs).withColumn("taken", F.col("size") * F.col("epochs")).withColumnRenamed("finish_0", "finish")
    return out.select("id", "source", "size", "source_size", "target", "taken", "epochs", "finish")


def mixed_stream(docs: DataFrame, **options) -> DataFrame:
    """The mix in its global order: a row for each time a document is taken, range-sorted by finish time."""
    m = mix(docs, **options)
    copies = m.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    finish = F.col("finish") + F.when(F.col("target") > 0, F.col("epoch") * F.col("source_size") / F.col("target")).otherwise(F.lit(0.0))
    return copies.withColumn("finish", finish).repartitionByRange("finish", "source", "id").sortWithinPartitions("finish", "source", "id")


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken. What an epoch takes of a source is the start of
    its order, so its last document tells the others: a row a source, and no text is shuffled while sources are few. Rows of the
    same id and source are taken equally often: as often as the one of them that comes first."""
    timed, n_sources, within = _mixed(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    at = lambda e, id_: F.struct(_place(id_, e, seed).alias("place"), F.col(id_).alias("id"))
    own = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")).alias("__key")
    last = written(timed.groupBy(own(F.col("source"))).agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.when(w, at(e, "id"))).alias(f"__last_{e}") for e, w in enumerate(within)]), "last")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__id"), own(F.col(source_col)))
    met = rows.join(F.broadcast(last), "__key") if n_sources <= SOURCES else hot_join(rows, last, "__key", "__n", F.xxhash64("__id"))
    epochs = sum((F.coalesce(at(e, "__id") <= F.col(f"__last_{e}"), F.lit(False)).cast("int") for e in range(len(within))), F.lit(0))
    taken = met.withColumn("__epochs", epochs).where("__epochs > 0")
    return taken.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__epochs")))).select("__doc.*")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM ranked
), leveled AS (
  SELECT *, (budget - ((sum(cap) OVER o) - cap)) / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), targets AS (
  SELECT source, source_size, budget, least(cap, coalesce((SELECT max(level) FROM leveled WHERE level <= cap / weight) * weight, cap)) AS target FROM leveled
), stream AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.budget, e.epoch,
         md5('mix:' || e.epoch || ':' || coalesce(s.doc_id::VARCHAR, '')) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1]) AS epoch) e
), timed AS (
  SELECT *, CASE WHEN target > 0 THEN (sum(size) OVER (PARTITION BY source, epoch ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) + epoch * source_size)::DOUBLE / target ELSE 0.0 END AS finish
  FROM stream
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, coalesce('+' || source, '~'), epoch, place, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) <= budget AS taken_now FROM timed
)
SELECT doc_id, size, source_size, target, sum(CASE WHEN taken_now THEN size ELSE 0 END)::BIGINT AS taken
FROM cut GROUP BY doc_id, size, source_size, target
"""
