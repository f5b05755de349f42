"""Connected components and neighbour relations of voxels and edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half of the neighbours of a voxel; the other half are their opposites.
FACES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
ALL_HALF = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


_OWN: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that the cluster shares (spark.checkpoint.dir; a temporary one where it is unset) and
    read again: loops neither grow lineage nor depend on one executor."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        key = spark.sparkContext.applicationId
        root = _OWN.setdefault(key, _OWN.get(key) or tempfile.mkdtemp(prefix="arbora-"))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def label_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Rows (node, component): the smallest node that is reachable over ``edges`` (a, b).

    Every round each root takes the smallest root next to it, roots are compressed once and edges are rewritten to
    roots; edges inside a component vanish, so a path of n nodes takes about log n rounds.
    """
    roots = nodes.select(F.col("node"), F.col("node").alias("component"))
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        if rest.isEmpty():
            return roots
        ends = rest.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(rest.select(F.col("b").alias("n"), F.col("a").alias("m")))
        up = stored(ends.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("r")), "up")
        for _ in range(3):
            up = up.alias("u").join(up.select(F.col("n").alias("r"), F.col("r").alias("rr")).alias("v"), "r", "left").select("n", F.coalesce("rr", "r").alias("r"))
        up = stored(up, "up")
        of = lambda c: up.select(F.col("n").alias(c), F.col("r").alias(f"{c}_root"))  # noqa: E731, B023
        rest = rest.join(of("a"), "a").join(of("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).filter("a <> b").distinct()
        rest = stored(rest, "edges")
        roots = roots.join(of("component"), "component", "left").select("node", F.coalesce("component_root", "component").alias("component"))
        roots = stored(roots, "roots")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def voxel_components(mask: DataFrame, size: tuple, connectivity: int = 6, same: str | None = None) -> DataFrame:
    """The mask's voxels with ``label``: the first scan index (x slowest) of their component under 6 or 26 neighbours;
    with ``same``, only neighbours of one value of that column are joined."""
    if connectivity not in (6, 26):
        raise ValueError("connectivity is 6 or 26")
    _, ny, nz = size
    ident = (F.col("x").cast("long") * ny + F.col("y")) * nz + F.col("z")
    own = mask.filter("v > 0").withColumn("node", ident)
    keep = [same] if same else []
    steps = FACES if connectivity == 6 else ALL_HALF
    moved = own.select(*keep, F.col("node").alias("a"), F.inline(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (F.col("z") + k).alias("z")) for i, j, k in steps])))
    edges = moved.join(own.select(*keep, "x", "y", "z", F.col("node").alias("b")), [*keep, "x", "y", "z"]).select("a", "b")
    comp = label_components(own.select("node"), edges)
    return own.join(comp, "node").drop("node").withColumnRenamed("component", "label")


def largest_component(labelled: DataFrame) -> DataFrame:
    """The voxels of the label with most voxels, the smaller label among equals."""
    best = labelled.groupBy("label").count().agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label"))
    return labelled.join(F.broadcast(best), "label", "left_semi")  # one row


def components_of_seeds(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """The components that hold a seed (x, y, z); the largest where no seed hits any."""
    hit = labelled.join(seeds.select("x", "y", "z").distinct(), ["x", "y", "z"]).select("label").distinct()
    if hit.isEmpty():
        return largest_component(labelled)
    return labelled.join(hit, "label", "left_semi")


def label_neighbours(labels: DataFrame) -> DataFrame:
    """The pairs (a, b), both ways, of different positive labels that share a face; labels are x, y, z, label."""
    own = labels.filter("label > 0")
    moved = own.select(F.col("label").alias("a"), F.inline(F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (F.col("z") + k).alias("z")) for i, j, k in FACES])))
    touch = moved.join(own.select("x", "y", "z", F.col("label").alias("b")), ["x", "y", "z"]).filter("a <> b").select("a", "b").distinct()
    return touch.unionByName(touch.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def end_clusters(labels: DataFrame) -> DataFrame:
    """Labels that touch exactly one other label."""
    return label_neighbours(labels).groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("a").alias("label"))


def grown(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Nodes reached from ``seeds`` (node, seed) within ``rounds`` steps over undirected ``edges`` (a, b): node, seed,
    step; the earliest front wins, the smaller seed among equals."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ring")
    reached = stored(seeds.groupBy("node").agg(F.min("seed").alias("seed")).withColumn("step", F.lit(0)), "reached")
    for r in range(1, rounds + 1):
        front = reached.filter(F.col("step") == r - 1).select(F.col("node").alias("a"), "seed")
        new = both.join(front, "a").groupBy(F.col("b").alias("node")).agg(F.min("seed").alias("seed")).join(reached.select("node"), "node", "left_anti")
        new = stored(new.withColumn("step", F.lit(r)), "front")
        if new.isEmpty():
            break
        reached = stored(reached.unionByName(new), "reached")
    return reached
