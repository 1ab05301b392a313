"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only.

Rows reach the index as (digest, id). A *memtable* is the hash map of Spark's partial aggregation: each task folds its
rows to one entry a digest before anything is shuffled, so that a digest that a third of all rows share costs one entry
a task. A flush writes the entries as *runs* of level 0: Parquet files sorted by digest, with min/max statistics and Bloom
filters on the digest that are sized to the run, by which `probe` skips files. A level of ``fan_in`` runs is compacted: they are
merged into one run of the next level, which keeps the chosen (smallest or largest) identifier and the count; that may fill the
next level in turn. A bulk load flushes ``fan_in`` runs at once, so the query finds one run on level 1.

Entries of several rows are hits. Their filter, a bitmap of the digests' hashes, tells every row that is surely none, so its text
stays where it is; the others meet the hits by digest, the rows of large groups dealt over salts. Hits are verified byte by
byte against the text of the row that stays; rows whose bytes differ though the digest agrees are grouped anew by the
text itself.

Defined results: a null text counts as empty; a null id stays only if its group has no other; of several rows with the id that
stays exactly one is kept, that of the smallest hash of all columns but maps, so the choice is the same on every run; an empty
table gives an empty result; other columns never matter otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_ROWS, hot_join, scratch, text_or_empty, written

#: Runs that a bulk load flushes, and that fill a level.
FAN_IN = 4
#: Bits that the filter over all hits has for each, and bytes up to which it is broadcast.
HIT_BITS, HIT_FILTER_BYTES = 16, 64_000_000
_BITMAP = 32_768  # bits of one bitmap of Spark's bitmap functions


class DigestIndex:
    """Runs of (digest, keep_id, n) in levels. keep: which identifier of equal digests stays, "min" or "max". Runs that were merged
    stay on disk, since tables read before may still be in use; they go with the index's folder."""

    def __init__(self, spark: SparkSession, *, keep: str = "min", fan_in: int = FAN_IN, root: str | None = None):
        if keep not in ("min", "max"):
            raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
        if fan_in < 2:
            raise ValueError(f"fan_in must be 2 or more, not {fan_in}")
        self.spark, self.keep, self.fan_in = spark, keep, fan_in
        self.root = root or scratch(spark, "digest-index")
        self.levels: list[list[str]] = [[]]
        self._made = 0
        self._schema = None  # of an entry, known from the first flush on

    def _best(self, col: str) -> Column:
        return (F.max if self.keep == "max" else F.min)(col).alias("keep_id")

    def _write(self, entries: DataFrame, level: int, by: list[str]) -> str:
        path = f"{self.root}/level-{level}/{self._made}"
        self._made += 1
        # of filters for several numbers of entries, the smallest that serves the file is written
        writer = entries.sortWithinPartitions(*by, "digest").write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return path

    def flush(self, rows: DataFrame, runs: int = 1) -> DigestIndex:
        """Adds rows(digest, id) in one pass, as sorted runs of level 0."""
        dealt = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int"))
        entries = dealt.groupBy("run", "digest").agg(self._best("id"), F.count(F.lit(1)).alias("n"))
        self._schema = entries.drop("run").schema
        path = self._write(entries, 0, ["run"])
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        self._add(0, [p for p in (f"{path}/run={i}" for i in range(runs)) if files.exists(jvm.org.apache.hadoop.fs.Path(p))])
        return self

    def _add(self, level: int, runs: list[str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level] += runs
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._add(level + 1, [self._write(self._merged(full), level + 1, [])])

    def compact(self) -> DigestIndex:
        """Merges all runs into one, on the highest level."""
        runs = [p for level in self.levels for p in level]
        if len(runs) > 1:
            top = max(1, len(self.levels) - 1)
            self.levels = [[] for _ in range(top)] + [[self._write(self._merged(runs), top, [])]]
        return self

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(*runs).select("digest", "keep_id", "n")

    def _merged(self, runs: list[str]) -> DataFrame:
        return self._read(runs).groupBy("digest").agg(self._best("keep_id"), F.sum("n").alias("n"))

    def table(self) -> DataFrame:
        """Every digest with the identifier that stays and its count."""
        runs = [p for level in self.levels for p in level]
        return self._merged(runs) if len(runs) > 1 else self._read(runs)

    def probe(self, digests: list[str]) -> DataFrame:
        """The entries of a few digests; statistics and Bloom filters skip the files that cannot hold them."""
        found = self._read([p for level in self.levels for p in level]).where(F.col("digest").isin(digests))
        return found.groupBy("digest").agg(self._best("keep_id"), F.sum("n").alias("n"))


def _filtered(keyed: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """keyed with __may: false for rows that are surely no hits, by a bitmap of the hits' hashes. Bitmaps are broadcast."""
    bits = max(1, -(-HIT_BITS * n // _BITMAP)) * _BITMAP
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    maps = hits.select(place("__digest").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__map"))
    rows = keyed.withColumn("__place", place("__digest")).withColumn("__bucket", F.bitmap_bucket_number("__place"))
    at = F.bitmap_bit_position("__place").cast("int")
    byte = F.conv(F.hex(F.expr("substring(__map, cast(bitmap_bit_position(__place) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    return rows.join(F.broadcast(maps), "__bucket", "left").withColumn("__may", may).drop("__bucket", "__place", "__map")


def _marked(keyed: DataFrame, hits: DataFrame, n: int, broadcast_rows: int, filter_bytes: int) -> DataFrame:
    """keyed with the hits' __keep_id and __n, null for single rows. Few hits are broadcast; of many, a filter is, so that the texts
    that move are those of hits and a few more; beyond the filter's bound all rows meet the hits by digest."""
    if n <= broadcast_rows:
        return keyed.join(F.broadcast(hits), "__digest", "left")
    met = lambda rows: hot_join(rows, hits, "__digest", "__n", F.xxhash64("__id"), how="left")
    if HIT_BITS * n > 8 * filter_bytes:
        return met(keyed)
    rows = _filtered(keyed, hits, n)
    kinds = {f.name: f.dataType for f in hits.schema}
    sure = rows.where(~F.col("__may")).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("__keep_id", "__n")])
    return met(rows.where("__may")).unionByName(sure).drop("__may")


def _regrouped(copies: DataFrame, bad: DataFrame, keep: str) -> DataFrame:
    """Groups of the digests where bytes differ, by the text itself."""
    rows = copies.drop("__keep_id", "__n").join(bad, "__digest", "left_semi")
    best = F.max("__id") if keep == "max" else F.min("__id")
    groups = rows.groupBy("__digest", "__text").agg(best.alias("__keep_id"), F.count(F.lit(1)).alias("__n"))
    return rows.join(groups, ["__digest", "__text"])


def annotate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, digest=None, broadcast_rows: int = BROADCAST_ROWS, filter_bytes: int = HIT_FILTER_BYTES) -> DataFrame:
    """The rows of docs as a struct ``__doc`` with __id, __digest, __keep_id, __n (rows of the group) and __kept.

    digest: Column -> Column, SHA-256 by default; a parameter so that tests can force collisions.
    """
    spark = docs.sparkSession
    digest = digest or (lambda c: F.sha2(c, 256))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    keyed = keyed.withColumn("__digest", digest(F.col("__text")))
    index = DigestIndex(spark, keep=keep, fan_in=fan_in).flush(keyed.select(F.col("__digest").alias("digest"), F.col("__id").alias("id")), runs=fan_in)
    hits = index.table().where("n > 1").select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep_id"), F.col("n").alias("__n"))
    marked = _marked(keyed, hits, hits.count(), broadcast_rows, filter_bytes)
    singles = marked.where("__n is null").withColumn("__keep_id", F.col("__id")).withColumn("__n", F.lit(1).cast("long")).withColumn("__kept", F.lit(True))

    copies = marked.where("__n is not null")
    stays = copies.where(F.col("__id").eqNullSafe(F.col("__keep_id"))).groupBy("__digest").agg(F.max("__text").alias("__other"), F.max("__n").alias("__m"))
    # a digest of many rows is dealt over salts, with the text to compare copied to each
    salts = lambda n: F.ceil(n / F.lit(512.0)).cast("int")
    left = copies.withColumn("__salt", F.pmod(F.xxhash64("__id"), salts(F.col("__n")).cast("long")).cast("int"))
    right = stays.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts(F.col("__m")) - 1))).drop("__m")
    verified = left.join(right, ["__digest", "__salt"]).withColumn("__same", F.col("__text") == F.col("__other")).drop("__other", "__salt")
    # what is compared is written once: the check for collisions and the result both read it
    verified = written(verified.drop("__text"), "verified")
    differs = verified.where(~F.col("__same")).select("__digest").distinct()
    grouped = verified.drop("__same")
    if not differs.isEmpty():
        again = _regrouped(copies, differs, keep).drop("__text")
        grouped = grouped.join(differs, "__digest", "left_anti").select(*grouped.columns).unionByName(again.select(*grouped.columns))
    plain = [F.col("__doc")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy("__digest", "__keep_id", "__n").orderBy(F.xxhash64(*plain))
    chosen = F.col("__id").eqNullSafe(F.col("__keep_id"))
    stay = grouped.where(chosen).withColumn("__kept", F.row_number().over(first) == 1)
    go = grouped.where(~chosen).withColumn("__kept", F.lit(False))
    return singles.drop("__text").unionByName(stay).unionByName(go)


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    out = annotate(docs.select(id_col, text_col), **options)
    return out.select(F.col("__id").alias("doc_id"), F.col("__keep_id").alias("keep_id"), F.col("__n").alias("group_size"), F.col("__kept").alias("kept"), F.col("__digest").alias("text_sha256"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    return annotate(docs, **options).where("__kept").select("__doc.*")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
