"""Exact group quantiles that never gather a group in one task.

Spark's own ``percentile`` merges one value-to-count map per group, so a segment holding a third of all rows
ends up in a single buffer. Here rows are first counted per (group, cell), with map-side combining. A cell is a range
of values on a logarithmic scale, wide enough that a task has many rows of each: a group has at most about 23,000 cells
whatever its size. Running totals over cells find the few that hold the wanted ranks; they are stored, and a second pass
over the rows counts per value in these cells alone, so most values are never shuffled. A wanted cell with more than
``CELL_VALUES`` different values is cut into ``SUB_CELLS`` equal parts of its range, again and again, and only the parts
that hold a wanted rank are kept; what is left is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.session import materialise

CELLS_PER_UNIT = 16
CELL_VALUES, SUB_CELLS = 20_000, 4096


def value_cell(value: Column) -> Column:
    """Order-preserving cell number: equal values share a cell, larger values never get a smaller one."""
    cell = F.floor(F.signum(value) * F.log1p(F.abs(value)) * CELLS_PER_UNIT)
    return F.coalesce(cell.cast("bigint"), F.lit(0))


def _held(rows: DataFrame, wanted_cells: DataFrame, keys: Sequence[str], counted: Mapping[str, Column]) -> DataFrame:
    """(keys, _cell, _n, _below, _v, counted) of the different values in wanted cells; ``rows`` are read once more for it."""
    return (
        rows.join(materialise(wanted_cells), [*keys, "_cell"])
        .groupBy(*keys, F.col("_cell").cast("string").alias("_cell"), "_v")
        .agg(F.first("_n").alias("_n"), F.first("_below").alias("_below"), *(c.alias(n) for n, c in counted.items()))
        .select(*keys, "_cell", "_n", "_below", "_v", *counted)
    )


def _refined(held: DataFrame, keys: Sequence[str], holding) -> DataFrame:
    """``held`` (keys, _cell, _n, _below, _v, _c) cut down to cells of few values, each with what lies below it."""
    held = materialise(held)
    while True:
        sizes = held.groupBy(*keys, "_cell").agg(
            F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        large = materialise(sizes.where((F.col("_values") > CELL_VALUES) & (F.col("_lo") < F.col("_hi"))))
        if large.isEmpty():
            return held
        at = F.least(
            F.lit(SUB_CELLS - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SUB_CELLS)
        ).cast("int")
        cut = held.join(large.drop("_values"), [*keys, "_cell"]).withColumn("_sub", at)
        upto = Window.partitionBy(*keys, "_cell").orderBy("_sub")
        parts = (
            cut.groupBy(*keys, "_cell", "_sub")
            .agg(F.sum("_c").alias("_cc"), F.first("_n").alias("_n"), F.first("_below").alias("_from"))
            .withColumn("_under", F.col("_from") + F.sum("_cc").over(upto) - F.col("_cc"))
            .where(holding(F.col("_under"), F.col("_cc")))
            .select(*keys, "_cell", "_sub", "_under")
        )
        smaller = cut.join(parts, [*keys, "_cell", "_sub"]).select(
            *keys, F.concat_ws("/", "_cell", "_sub").alias("_cell"), "_n", F.col("_under").alias("_below"), "_v", "_c"
        )
        small = held.join(large.select(*keys, "_cell"), [*keys, "_cell"], "left_anti")
        held = materialise(small.select(*smaller.columns).unionByName(smaller))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], count_as: str | None = None
) -> DataFrame:
    """One row per group with linearly interpolated quantiles, nulls ignored. ``df`` is read twice.

    ``probabilities`` maps output names to levels in [0, 1]. ``count_as`` adds the number of values.
    Rows with a null key belong to no group.
    """
    keys = list(keys)
    present = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, value]]))
    if isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType)):
        present = present.where(~F.isnan(value))
    rows = present.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_cell", value_cell(F.col("_v")))
    group = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_cell")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = (
        rows.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_cc"))
        .withColumns({"_n": F.sum("_cc").over(whole), "_below": F.sum("_cc").over(group) - F.col("_cc")})
    )
    levels = list(probabilities.items())

    def rank(position: int, upper: bool) -> Column:
        exact = F.lit(float(levels[position][1])) * (F.col("_n") - 1)
        return (F.ceil(exact) if upper else F.floor(exact)).cast("bigint")

    def holds(start: Column, size: Column, k: Column) -> Column:
        return (start <= k) & (k < start + size)

    ranks = [(i, upper) for i in range(len(levels)) for upper in (False, True)]
    def holding(below: Column, size: Column) -> Column:
        return reduce(lambda a, b: a | b, [holds(below, size, rank(*r)) for r in ranks])

    wanted_cells = cells.where(holding(F.col("_below"), F.col("_cc"))).select(*keys, "_cell", "_n", "_below")
    held = _refined(_held(rows, wanted_cells, keys, {"_c": F.count(F.lit(1))}), keys, holding)

    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_v")
    picked = held.withColumn("_start", F.col("_below") + F.sum("_c").over(in_cell) - F.col("_c"))
    at_rank = {
        (i, upper): F.max(F.when(holds(F.col("_start"), F.col("_c"), rank(i, upper)), F.col("_v")))
        for i, upper in ranks
    }
    picks = [at_rank[r].alias(f"_{'hi' if r[1] else 'lo'}{r[0]}") for r in ranks]
    rows = picked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)

    outputs = []
    for i, (name, level) in enumerate(levels):
        fraction = F.lit(float(level)) * (F.col("_n") - 1) - rank(i, False)
        outputs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * fraction).alias(name))
    if count_as:
        outputs.append(F.col("_n").alias(count_as))
    return rows.select(*keys, *outputs)


#: Running sums of weights are compared up to this share of their total.
WEIGHT_SLACK = 1e-9


def weighted_quantile(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, share: str | None = None, name: str = "quantile"
) -> DataFrame:
    """One row per group: the smallest value up to which the weights add up to their wanted part of the total.

    ``share`` is the column with the part each row's weight calls for, half by default: the weighted median. Rows with a
    null key, value or weight, or without a positive weight, count for nothing. As in ``exact_quantiles`` weights are
    added up per cell of values, so that no group is sorted as a whole, and ``df`` is read twice.
    """
    keys = list(keys)
    called = F.col(share).cast("double") if share else F.lit(0.5)
    rows = df.select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_c"), called.alias("_share")
    )
    present = [F.col(c).isNotNull() for c in [*keys, "_v"]]
    rows = rows.where(reduce(lambda a, b: a & b, present)).where((F.col("_c") > 0) & ~F.isnan("_v"))
    rows = rows.withColumn("_cell", value_cell(F.col("_v")))
    group = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_cell")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = (
        rows.groupBy(*keys, "_cell")
        .agg(F.sum("_c").alias("_cc"), F.sum(F.col("_c") * F.col("_share")).alias("_part"))
        .withColumns(
            {
                "_n": F.struct(F.sum("_part").over(whole).alias("at"), F.sum("_cc").over(whole).alias("all")),
                "_below": F.sum("_cc").over(group) - F.col("_cc"),
            }
        )
    )
    wanted, slack = F.col("_n.at"), F.col("_n.all") * WEIGHT_SLACK

    def holding(below: Column, size: Column) -> Column:
        return (below <= wanted + slack) & (below + size >= wanted - slack)

    wanted_cells = cells.where(holding(F.col("_below"), F.col("_cc"))).select(*keys, "_cell", "_n", "_below")
    held = _refined(_held(rows, wanted_cells, keys, {"_c": F.sum("_c")}), keys, holding)
    upto = F.col("_below") + F.sum("_c").over(Window.partitionBy(*keys, "_cell").orderBy("_v"))
    reached = held.withColumn("_upto", upto).where(F.col("_upto") >= wanted - slack)
    return reached.groupBy(*keys).agg(F.min("_v").alias(name))
