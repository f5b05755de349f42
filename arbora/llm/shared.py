"""Helpers shared by the operators: scratch tables, skew-safe joins, connected components."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in so many of all rows; so at most this many keys are hot.
HOT_PARTS = 1024
#: Rows of an Arrow batch that Python workers and executors exchange while a table is written: whole texts are long rows.
BATCH_ROWS = 1000


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a new one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        key = spark.sparkContext.applicationId
        root = _OWN.setdefault(key, _OWN.get(key) or tempfile.mkdtemp(prefix="arbora-"))
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Jobs planned meanwhile hold at most BATCH_ROWS rows in an Arrow batch, or fewer where the session asks for that."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before each that no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs.  Its cleaner acts when the driver's JVM collects garbage, and
    needs a second round for what the first one lets go of."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys``."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def joined_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with ``keyed`` (a written table of one row a key; ``count`` says how many ``rows``
    have it), safe under skew.

    Keys with more than ``total / HOT_PARTS`` rows number fewer than HOT_PARTS: only their hashes reach the driver, they
    are broadcast, and their rows never move.  Every other key is small against a partition; rows of all others go
    through a shuffled join.  Without such keys the join is a plain one.
    """
    place = F.xxhash64(*keys)
    hot = [r[0] for r in keyed.filter(F.col(count) > total // HOT_PARTS).select(place).distinct().collect()]
    keyed = keyed.drop(count)
    if not hot:
        return rows.join(keyed.hint("merge"), keys, how)
    is_hot = place.isin(hot)
    out = rows.filter(is_hot).join(F.broadcast(keyed.filter(is_hot)), keys, how)
    return out.unionByName(rows.filter(~is_hot).join(keyed.filter(~is_hot).hint("merge"), keys, how))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component), component = smallest node reachable.

    Rounds of hooking every node to its smallest neighbour, pointer jumping and contraction; each round's tables are
    written to the shared folder, and nothing but an emptiness test reaches the driver.  Nodes without an edge are not
    returned; null ends and loops are ignored.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name)
    comp = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), name)
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up"))
        parent = written(parent, name)
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            jumped = written(parent.join(above, "up").select("node", F.col("up2").alias("up")), name)
            dropped(parent)
            parent = jumped
        ups = lambda old, new: parent.select(F.col("node").alias(old), F.col("up").alias(new))
        fewer = edges.join(ups("a", "a2"), "a").join(ups("b", "b2"), "b")
        fewer = fewer.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a < b").distinct()
        fewer = written(fewer, name)
        moved = comp.join(ups("component", "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        moved = written(moved, name)
        dropped(edges, comp, parent)
        edges, comp = fewer, moved
    return comp
