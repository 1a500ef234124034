"""What several operators share: the shared folder, Arrow passes over texts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts reach 100 kB, so the default of 10,000 rows would not bound a worker's memory.
BATCH_ROWS = 512
HELD_OUT_REMAINDER = 1
#: A key with more than one in so many of the rows is frequent.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, a temporary one where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tallyweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(name: str) -> str:
    """A column name that no user's table has."""
    return f"{name}_{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files when the query ends; otherwise they wait for the driver's garbage collection.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made in here leave no shuffle files behind when they have run. The session's setting is put back."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; a lost executor costs no recomputation.

    Nothing needs the shuffles before the cut any more, and an iteration would pile up those of all its rounds.
    """
    shared_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def total(df: DataFrame, *sums: Column) -> tuple:
    """The aggregates of the whole frame."""
    with _tidy(df.sparkSession):
        return tuple(df.agg(*sums).first())


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches small enough for long texts.

    Where the session has Spark's default for spark.sql.execution.arrow.maxRecordsPerBatch, it gets BATCH_ROWS; a number
    that the user has set stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == HELD_OUT_REMAINDER


def thinned(df: DataFrame, key: Column, rate: Column | float) -> DataFrame:
    """Rows whose key's hash falls below the rate: a sample that every run and every executor agrees on."""
    u = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 40)) / float(1 << 40)
    return df.where(u < rate)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with facts on key, which facts hold once; `size` says how many of the `total` rows have a key.

    Keys with more than one in HOT of the rows number at most HOT, so their facts are broadcast, and no task gets all
    the rows of a frequent key; the others are joined by key. Both inputs are read twice.
    """
    hot = F.broadcast(facts.where(F.col(size) > total / HOT))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col(size) <= total / HOT), key)
    return rows.join(hot, key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (u, v): root is the smallest node reachable from it.

    Alternates large-star and small-star contraction until nothing changes, which takes some log(nodes) rounds. Each
    round groups by a node and keeps a minimum (combined before the shuffle), so a hub with very many neighbours is
    split like any skewed join. Self-links and links with a null are ignored.
    """
    edges = cut(
        links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def state(e: DataFrame) -> tuple:
        return total(e, F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))

    def pair(u: Column, v: Column) -> Column:
        return F.struct(u.alias("u"), v.alias("v"))

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    before, after = None, state(edges)
    while after[0] and after != before:
        both = edges.select(F.inline(F.array(pair(u, v), pair(v, u))))
        low = both.groupBy(u.alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "n"))
        large = both.join(low, u == F.col("n")).where("v > u").select(v.alias("u"), m.alias("v"))
        low = large.groupBy(u.alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, u == F.col("n"))
        edges = cut(small.select(F.inline(F.array(pair(u, m), pair(v, m)))).where("u <> v").distinct())
        before, after = after, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
