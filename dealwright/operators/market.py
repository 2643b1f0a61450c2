"""Market summaries per segment: the tables behind the overview charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.functions.scoring import bin_number
from dealwright.operators.joins import with_group_values
from dealwright.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def market_summary(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Listings, median, lowest and highest price, mean age."""
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_listings"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("age").alias("avg_age"),
    )
    return plain.join(exact_quantiles(df, keys, "price", {"median_price": 0.5}), list(keys), "left")


def price_quantiles(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    return exact_quantiles(df, keys, "price", QUARTILES)


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Row counts in equal-width bins between each group's lowest and highest value."""
    keys = list(keys)
    edges = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return (
        with_group_values(rows, edges, keys, "inner")
        .withColumn("bin", bin_number(F.col("_v"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy(*keys, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            F.col("bin").cast("int").alias("bin"),
            (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_from"),
            (F.col("_lo") + F.col("bin") * width).alias("bin_to"),
            "n",
        )
    )


def price_histogram(df: DataFrame, bins: int = 40, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Price histogram with the quartile markers of each segment."""
    return with_group_values(histogram(df, "price", bins, keys), price_quantiles(df, keys), keys)


def box_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, extremes, count, and whiskers: the most extreme values within 1.5 box heights."""
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    quartiles = exact_quantiles(df, keys, value, QUARTILES)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        with_group_values(counted, quartiles, keys, "inner")
        .groupBy(*keys, "q25", "q50", "q75")
        .agg(
            F.sum("_c").alias("n"),
            F.min(value).alias("min_value"),
            F.max(value).alias("max_value"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("n_beyond"),
        )
    )


def price_by_year_box(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    return box_stats(df, "price", [*keys, "year"])


def price_by_region_box(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Box per region, regions by falling median."""
    return box_stats(df, "price", [*keys, "region"]).orderBy(*keys, F.desc("q50"), "region")


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 20, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Straight-line fit of ``y`` on ``x`` inside each equal-width bin of ``x``."""
    keys = list(keys)
    edges = df.groupBy(*keys).agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    rows = with_group_values(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), edges, keys, "inner")
    return (
        rows.withColumn("bin", bin_number(F.col(x), F.col("_lo"), F.col("_hi"), bins).cast("int"))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias("x_mean"),
            F.avg(y).alias("y_mean"),
            F.regr_slope(F.col(y).cast("double"), F.col(x)).alias("slope"),
            F.regr_intercept(F.col(y).cast("double"), F.col(x)).alias("intercept"),
        )
    )


def smooth_trend(
    df: DataFrame, x: str, y: str, points: int = 20, span: float = 1 / 3, keys: Sequence[str] = SEGMENT
) -> DataFrame:
    """Local linear smoother with tricube weights at evenly spaced points of ``x``.

    The weight depends on ``x`` alone, so rows are first added up per distinct ``x``; each of those then counts
    only at the grid points within reach (``span`` of the range on either side).
    """
    keys = list(keys)
    sums = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_y"))
    )
    edges = sums.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    reach = F.col("_width") * span
    at = F.col("_lo") + F.col("point") * step
    first = F.greatest(F.lit(0), F.ceil((F.col("_x") - reach - F.col("_lo")) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("_x") + reach - F.col("_lo")) / step)).cast("int")
    spread = (
        with_group_values(sums, edges, keys, "inner")
        .withColumn("_width", F.col("_hi") - F.col("_lo"))
        .where(F.col("_width") > 0)
        .where(first <= last)
        .withColumn("point", F.explode(F.sequence(first, last)))
        .withColumn("grid_x", at)
        .withColumn("_d", F.col("_x") - F.col("grid_x"))
        .withColumn("_w", F.pow(1 - F.pow(F.least(F.abs(F.col("_d")) / reach, F.lit(1.0)), 3), 3))
    )
    weight = F.col("_w") * F.col("_n")
    total = spread.groupBy(*keys, "point", "grid_x").agg(
        F.sum(weight).alias("s0"),
        F.sum(weight * F.col("_d")).alias("s1"),
        F.sum(weight * F.col("_d") * F.col("_d")).alias("s2"),
        F.sum(F.col("_w") * F.col("_y")).alias("t0"),
        F.sum(F.col("_w") * F.col("_d") * F.col("_y")).alias("t1"),
    )
    spread_out = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = F.try_divide(F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1"), spread_out)
    level = F.try_divide(F.col("t0"), F.col("s0"))
    flat = spread_out <= 1e-12 * F.col("s0") * F.col("s2")
    return total.select(*keys, "point", "grid_x", F.when(flat, level).otherwise(line).alias("smoothed"))


def category_counts(
    df: DataFrame,
    columns: Sequence[str] = ("region", "fuel", "transmission", "colour_label", "stereo_label"),
    keys: Sequence[str] = SEGMENT,
) -> DataFrame:
    """Value counts of several categories in one pass."""
    present = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in present])
    return (
        df.select(*keys, F.inline(pairs))
        .groupBy(*keys, "category", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*keys, "category", F.desc("n"), "value")
    )


def sample_counts(df: DataFrame) -> DataFrame:
    """Rows per segment, per make and in total; nulls mark the totals."""
    return df.rollup(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
