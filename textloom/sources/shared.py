"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small table (two or three scalars a row) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a key beyond which `hot_join` deals them over several tasks.
HOT_ROWS = 2_000
#: Rows of a few scalars that one task may read, so that a table of so many needs no dealing.
TASK_ROWS = 1_000_000

#: Rows of an Arrow batch, where the session has Spark's default of 10,000: a batch of whole texts should take some MB.
ARROW_ROWS, _ARROW_KEY = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, if unset, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, unless they were set: texts vary from bytes to megabytes, and a batch of them is
    held by both the JVM and the worker."""
    if spark.conf.get(_ARROW_KEY) == "10000":
        spark.conf.set(_ARROW_KEY, str(ARROW_ROWS))


#: Paths that `scratch` gave out and that may still be deleted.
_given: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _given.append(f"{shared_dir(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}")
    return _given[-1]


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that were written within: for results that have been stored by then."""
    before = len(_given)
    try:
        yield
    finally:
        while len(_given) > before:
            drop_table(spark, _given.pop())


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """The same rows, read back from a table in the shared folder: cuts the lineage and survives lost executors. Options are the writer's."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all tables that operators of this application wrote for themselves. For when the results that read them have been stored;
    `temporary_tables` does so for one stretch of a program."""
    while _given:
        drop_table(spark, _given.pop())


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if its counted rows are within the limit; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def hot_join(many: DataFrame, one: DataFrame, keys: str | list[str], rows: str, spread: Column, *, how: str = "inner", each: int | None = None, limit: int = BROADCAST_ROWS, total: int | None = None) -> DataFrame:
    """Join of many rows a key with one row a key, whose column ``rows`` says how many rows the key has in ``many``; ``spread``
    (of ``many``) deals the rows of a key of more than ``each`` over salts. Which keys these are is broadcast; if they are more
    than ``limit``, only the largest are dealt (ten times as many rows, and so on): the others' rows fit a task all the same.
    ``one`` is read three times. ``total``, if known, is the number of rows of ``many``: up to ``TASK_ROWS`` nothing is dealt. Keys that
    are null match nothing."""
    keys, each = [keys] if isinstance(keys, str) else keys, each or HOT_ROWS
    if total is not None and total <= TASK_ROWS:
        return many.join(one, keys, how)
    sizes = [each * 10**i for i in range(10)]
    counts = one.agg(*[F.count(F.when(F.col(rows) > s, 1)) for s in sizes]).first()
    size, hot = next(((s, c) for s, c in zip(sizes, counts, strict=True) if c <= limit), (sizes[-1], 0))
    if not hot:
        return many.join(one, keys, how)
    salts = F.when(F.col(rows) > size, F.ceil(F.col(rows) / F.lit(float(each)))).otherwise(F.lit(1)).cast("int")
    large = F.broadcast(one.where(F.col(rows) > size).select(*keys, salts.alias("__salts")))
    left = many.withColumn("__spread", spread).join(large, keys, "left")
    left = left.withColumn("__salt", F.coalesce(F.pmod(F.col("__spread"), F.col("__salts").cast("long")).cast("int"), F.lit(0))).drop("__salts", "__spread")
    return left.join(one.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))), [*keys, "__salt"], how).drop("__salt")
