"""Robust local regression (LOWESS) of one column on another, per segment, at evenly spaced points.

The bandwidth of a point reaches to the nearest share of the segment's rows, so it is wide where listings are few; it is
the rank of a distance among the counts of distinct values. Each robust pass takes weight from rows far from the curve,
by the bisquare of their distance over six median ones. Rows enter the fits as sums per distinct ``x``; a segment is never
sorted or gathered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.operators.joins import with_group_values
from dealwright.operators.quantiles import exact_quantiles, weighted_quantile
from dealwright.session import materialise

#: Share of the rows that a point's fit sees, robust passes, and median distances beyond which a row has no weight.
SPAN, PASSES, FAR = 2 / 3, 3, 6.0


def _local_lines(spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value at each point of the weighted line through (distance ``_d``, ``_y`` / ``_n``) around it; a level where
    the line is not determined, null without any weight."""
    reach = F.abs("_d") / F.col("_h")
    near = F.when(F.col("_h") > 0, F.pow(1 - F.pow(F.least(reach, F.lit(1.0)), 3), 3)).otherwise((F.col("_d") == 0).cast("double"))
    w, wy = near * F.col("_n"), near * F.col("_y")
    total = spread.groupBy(*keys, "point", "grid_x").agg(
        F.sum(w).alias("s0"), F.sum(w * F.col("_d")).alias("s1"), F.sum(w * F.col("_d") * F.col("_d")).alias("s2"),
        F.sum(wy).alias("t0"), F.sum(wy * F.col("_d")).alias("t1"),
    )
    spread_out = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), spread_out)
    level = F.try_divide(F.col("t0"), F.col("s0"))
    flat = spread_out <= 1e-9 * F.col("s0") * F.col("s2")
    return total.select(*keys, "point", "grid_x", F.when(flat, level).otherwise(line).alias("smoothed"))


def _between(curve: Column, place: Column, points: int) -> Column:
    """The curve between its points, by straight lines."""
    first = F.least(F.lit(points - 2), F.floor(place)).cast("int")
    low, high = F.get(curve, first), F.get(curve, first + 1)
    return low + (high - low) * (place - first)


def lowess(
    df: DataFrame, x: str, y: str, points: int = 20, span: float = SPAN, passes: int = PASSES, keys: Sequence[str] = SEGMENT
) -> DataFrame:
    """(keys, point, grid_x, smoothed): the curve at ``points`` evenly spaced values of ``x`` in each group.

    A point's fit is a line through the ceil(``span`` n) rows nearest to it, with tricube weights; in ``passes`` further fits
    rows are weighed by the bisquare of their distance from the curve, which is straight between points. Where half of a
    group's rows lie on the curve it stays as it is, and so does a point whose rows have all lost their weight. Rows with
    a null in either column play no part; groups with a single value of ``x`` have no curve.
    """
    if points < 2:
        raise ValueError("a curve needs two points")
    keys = list(keys)
    present = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = present.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_v"))
    one = F.lit(1.0)

    def per_x(weighed: DataFrame, weight: Column) -> DataFrame:
        return weighed.groupBy(*keys, "_x").agg(F.sum(weight).alias("_n"), F.sum(weight * F.col("_v")).alias("_y"))

    sums = materialise(per_x(rows, one))
    edges = sums.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_n").alias("_all"))
    edges = materialise(edges.where(F.col("_hi") > F.col("_lo")))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)

    def spread(summed: DataFrame) -> DataFrame:
        placed = with_group_values(summed, edges, keys, "inner", stored=True).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        return placed.withColumn("grid_x", F.col("_lo") + F.col("point") * step).withColumn("_d", F.col("_x") - F.col("grid_x"))

    wanted = F.ceil(F.lit(span) * F.col("_all")) / F.col("_all")
    distances = spread(sums).select(*keys, "point", F.abs("_d").alias("_far"), "_n", wanted.alias("_share"))
    reach = materialise(weighted_quantile(distances, [*keys, "point"], "_far", "_n", "_share", "_h"))

    def fit(summed: DataFrame) -> DataFrame:
        return _local_lines(with_group_values(spread(summed), reach, [*keys, "point"], "inner", stored=True), keys)

    curve = materialise(fit(sums))
    for _ in range(passes):
        whole = curve.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("point", "smoothed"))).alias("_curve"))
        whole = whole.select(*keys, F.transform("_curve", lambda p: p["smoothed"]).alias("_curve"))
        attached = with_group_values(with_group_values(rows, edges, keys, "inner", stored=True), whole, keys, "inner")
        place = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (points - 1)
        left = materialise(attached.select(*keys, "_x", "_v", F.abs(F.col("_v") - _between(F.col("_curve"), place, points)).alias("_r")))
        typical = exact_quantiles(left, keys, "_r", {"_s": 0.5})
        part = F.col("_r") / (FAR * F.col("_s"))
        bisquare = F.when(F.col("_s") <= 0, 1.0).when(part >= 1, 0.0).otherwise(F.pow(1 - part * part, 2))
        again = fit(per_x(with_group_values(left, typical, keys, "inner").withColumn("_weight", bisquare), F.col("_weight")))
        before = curve.withColumnRenamed("smoothed", "_before").drop("grid_x")
        curve = materialise(
            again.join(before, [*keys, "point"]).select(*keys, "point", "grid_x", F.coalesce("smoothed", "_before").alias("smoothed"))
        )
    return curve
