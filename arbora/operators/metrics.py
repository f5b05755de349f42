"""Overlap metrics of predictions and truths: rows of x, y, z, p, t (both class numbers, 0 being background)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dice_scores(pairs: DataFrame) -> DataFrame:
    """Dice overall (class 0: places of equal foreground class on both sides) and per class: class, dice; a class that
    neither has is absent, and overall is 1 where there's no foreground at all."""
    p, t = F.col("p"), F.col("t")
    tag = lambda c, both, n: F.struct(c.cast("int").alias("class"), both.cast("long").alias("both"), n.cast("long").alias("n"))
    hit = (p == t) & (p > 0)
    rows = pairs.select(F.explode(F.array(tag(p, hit, F.lit(1)), tag(t, F.lit(False), F.lit(1)))).alias("r")).select("r.*")
    overall = pairs.agg(F.lit(0).cast("int").alias("class"), (F.lit(2.0) * F.count_if(hit)).alias("a"), (F.count_if(p > 0) + F.count_if(t > 0)).alias("b"))
    each = rows.filter("class > 0").groupBy("class").agg((F.lit(2.0) * F.sum("both")).alias("a"), F.sum("n").alias("b"))
    return overall.unionByName(each).select("class", F.coalesce(F.try_divide("a", "b"), F.lit(1.0)).alias("dice"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts tp, tn, fp, fn of foreground, sensitivity and specificity (null where undefined)."""
    code = F.col("p").cast("boolean").cast("int") * 2 + F.col("t").cast("boolean").cast("int")
    out = pairs.agg(*[F.count_if(code == k).alias(n) for k, n in ((3, "tp"), (0, "tn"), (2, "fp"), (1, "fn"))])
    return out.withColumn("sensitivity", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("specificity", F.try_divide("tn", F.col("tn") + F.col("fp")))


def masked_dice(pairs: DataFrame, mask: DataFrame) -> DataFrame:
    """Dice of predictions that count only inside ``mask`` (x, y, z)."""
    inside = mask.select("x", "y", "z").distinct().withColumn("_in", F.lit(1))
    rows = pairs.join(inside, ["x", "y", "z"], "left").withColumn("p", F.when(F.col("_in").isNotNull(), F.col("p")).otherwise(0))
    return dice_scores(rows)


def branch_coverage(points: DataFrame, covered: DataFrame, hop: float = 0.1) -> DataFrame:
    """Per truth branch, its length, the length up to the first point that isn't covered, and the share.

    ``points``: line_id, seq, x, y, z, arc, radius; ``covered``: line_id, seq of the points inside the prediction.  A walk
    goes on in hops of ``hop`` radii, so a miss ends the branch where it lies.
    """
    seen = covered.select("line_id", "seq").distinct().withColumn("_hit", F.lit(True))
    rows = points.join(seen, ["line_id", "seq"], "left")
    out = rows.groupBy("line_id").agg(F.max("arc").alias("length"), F.min(F.when(F.col("_hit").isNull(), F.col("arc") - hop * F.col("radius"))).alias("miss"))
    reached = F.coalesce(F.greatest(F.col("miss"), F.lit(0.0)), F.col("length"))
    return out.select("line_id", "length", reached.alias("reached"), F.coalesce(F.try_divide(reached, F.col("length")), F.lit(1.0)).alias("share"))


def mean_of_timed(steps: DataFrame, column: str) -> DataFrame:
    """The mean of a step column over steps after the first that have a value other than 0; null where there's none."""
    return steps.filter((F.col("step_id") > 0) & F.col(column).isNotNull() & (F.col(column) != 0)).agg(F.avg(column).alias(f"mean_{column}"))
