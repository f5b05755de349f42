"""Branching trees: rows of branch_id, pos, step_id, position 0 being the connecting step on the mother branch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored


def tree_edges(branches: DataFrame) -> DataFrame:
    """The edges parent, child between following steps of each branch, the connector being the first parent."""
    w = Window.partitionBy("branch_id").orderBy("pos")
    out = branches.select("branch_id", F.col("step_id").alias("parent"), F.lead("step_id").over(w).alias("child"))
    return out.filter("child is not null and child <> parent").select("branch_id", "parent", "child").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Per step its edges in and out."""
    ends = edges.select(F.col("parent").alias("step_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("child").alias("step_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("step_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def bifurcations(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("n_out > 1").select("step_id")


def depths(edges: DataFrame) -> DataFrame:
    """Edges between each step and its root, by pointer doubling: about log2(depth) joins, and no driver recursion."""
    up = edges.groupBy(F.col("child").alias("step_id")).agg(F.min("parent").alias("up"))
    roots = edges.select(F.col("parent").alias("step_id")).distinct().join(up, "step_id", "left_anti")
    table = stored(up.withColumn("depth", F.lit(1).cast("long")).unionByName(roots.select("step_id", F.col("step_id").alias("up"), F.lit(0).cast("long").alias("depth"))), "depth")
    while True:
        above = table.select(F.col("step_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = stored(table.join(above, "up").select("step_id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "depth")
        table = new.drop("moved")
        if new.filter("moved").isEmpty():
            return table.select("step_id", F.col("up").alias("root"), "depth")


def contracted(edges: DataFrame) -> DataFrame:
    """The tree without steps that have one edge in and one out: parent, child, steps (edges of the path between)."""
    d = degrees(edges)
    inner = d.filter("n_in = 1 and n_out = 1").select("step_id")
    table = stored(edges.groupBy("child").agg(F.min("parent").alias("parent")).withColumn("steps", F.lit(1).cast("long")), "paths")
    inner = stored(inner, "inner")
    while True:
        via = table.join(inner.withColumnRenamed("step_id", "parent"), "parent", "left_semi")
        if via.isEmpty():
            break
        above = table.select(F.col("child").alias("parent"), F.col("parent").alias("p2"), F.col("steps").alias("more"))
        jumped = via.join(above, "parent").select("child", F.col("p2").alias("parent"), (F.col("steps") + F.col("more")).alias("steps"))
        rest = table.join(inner.withColumnRenamed("step_id", "parent"), "parent", "left_anti").select("child", "parent", "steps")
        table = stored(rest.unionByName(jumped), "paths")
    return table.join(inner.withColumnRenamed("step_id", "child"), "child", "left_anti").select("parent", "child", "steps")


def last_steps(branches: DataFrame, n: int) -> DataFrame:
    """The last ``n`` steps of each branch without its connector and step 0, the last one first."""
    own = branches.filter("pos > 0 and step_id <> 0")
    place = F.row_number().over(Window.partitionBy("branch_id").orderBy(F.desc("pos")))
    return own.withColumn("back", place).filter(F.col("back") <= n).select("branch_id", "back", "step_id")


def previous_steps(branches: DataFrame) -> DataFrame:
    """Per step the one before it: that of the last branch (largest branch_id) that lists it after another."""
    w = Window.partitionBy("branch_id").orderBy("pos")
    pairs = branches.select("branch_id", "step_id", F.lag("step_id").over(w).alias("previous")).filter("previous is not null")
    return pairs.groupBy("step_id").agg(F.max_by("previous", "branch_id").alias("previous"))


def branch_ends(branches: DataFrame) -> DataFrame:
    """The last step of each branch."""
    return branches.groupBy("branch_id").agg(F.max_by("step_id", "pos").alias("step_id"), F.max("pos").cast("int").alias("steps"))


def restarted(branches: DataFrame, branch: int) -> DataFrame:
    """The tree without a branch: steps of later branches that connect to it hang on its own connector."""
    gone = branches.filter(F.col("branch_id") == branch)
    connector = gone.filter("pos = 0").select(F.col("step_id").alias("_c"))
    inner = gone.filter("pos > 0").select(F.col("step_id").alias("_s"))
    rest = branches.filter(F.col("branch_id") != branch)
    heads = rest.filter("pos = 0").join(F.broadcast(inner), F.col("step_id") == F.col("_s"), "left")  # the steps of one branch
    heads = heads.crossJoin(F.broadcast(connector)).withColumn("step_id", F.when(F.col("_s").isNotNull(), F.col("_c")).otherwise(F.col("step_id")))  # one row
    return rest.filter("pos > 0").unionByName(heads.select(*branches.columns))


def queue_order(potentials: DataFrame, by: str = "radius") -> DataFrame:
    """The queue of potential branches: widest first (``radius``) or narrowest old radius first (``old_radius``)."""
    key = F.desc("radius") if by == "radius" else F.asc("old_radius")
    return potentials.withColumn("place", F.row_number().over(Window.partitionBy("case").orderBy(key, "seq")))


def _merged(rows: pd.DataFrame, reach: float, turn: float) -> pd.DataFrame:
    rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
    p, t, r = rows[["x", "y", "z"]].to_numpy(float), rows[["tx", "ty", "tz"]].to_numpy(float), rows["radius"].to_numpy(float)
    alive = np.ones(len(rows), bool)
    for i in range(len(rows)):
        if alive[i]:
            later = np.flatnonzero(alive[i + 1 :]) + i + 1
            near = np.linalg.norm(p[later] - p[i], axis=1) < reach * r[i]
            same = np.arccos(np.clip(t[later] @ t[i], -1, 1)) < turn
            alive[later[near & same]] = False
    return rows[alive]


def merged_potentials(potentials: DataFrame, reach: float = 2.0, turn: float = 0.5) -> DataFrame:
    """Per case, greedily in order: a potential branch drops the later ones within ``reach`` radii that point the same
    way within ``turn`` radians.  The rule is sequential within a case, whose queue is short; cases run in parallel."""
    return potentials.groupBy("case").applyInPandas(lambda rows: _merged(rows, reach, turn), potentials.schema)
