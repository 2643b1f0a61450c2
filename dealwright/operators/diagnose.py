"""Model diagnostics on held-out rows, for every segment at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.functions.hashing import digest_number, seeded_digest
from dealwright.operators.market import histogram
from dealwright.operators.joins import with_group_values
from dealwright.operators.quantiles import exact_quantiles

#: Rows of one range of the random order, about.
RANGE_ROWS = 10_000


def residuals(df: DataFrame, predicted: str = "prediction_label", actual: str = "price") -> DataFrame:
    rest = F.col(actual) - F.col(predicted)
    return df.withColumns({"residual": rest, "abs_residual": F.abs(rest)})


def evaluate(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """MAE, RMSE, R squared, correlation and median absolute error of ``residuals`` rows, per group."""
    rest, price = F.col("residual"), F.col("price").cast("double")
    plain = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("abs_residual").alias("mae"),
        F.sqrt(F.avg(rest * rest)).alias("rmse"),
        (1 - F.try_divide(F.avg(rest * rest), F.var_pop(price))).alias("r2"),
        F.corr(price, F.col("prediction_label")).alias("pearson"),
    )
    medians = exact_quantiles(df, keys, "abs_residual", {"median_ae": 0.5})
    return plain.join(medians, list(keys))


def leaderboard(df: DataFrame, predictions: Mapping[str, str], keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Error of each candidate, given as model name to prediction column, best first in every group."""
    each = F.array(
        *[F.struct(F.lit(name).alias("candidate"), F.col(c).alias("_p")) for name, c in predictions.items()]
    )
    rest = F.col("price") - F.col("_p")
    scores = (
        df.select(*keys, "price", F.inline(each))
        .where(F.col("_p").isNotNull())
        .groupBy(*keys, "candidate")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(rest)).alias("mae"), F.sqrt(F.avg(rest * rest)).alias("rmse"))
    )
    # Errors equal to a millionth are ties; the rows per group are the few candidates.
    best_first = Window.partitionBy(*keys).orderBy(F.round("mae", 6), "candidate")
    return scores.withColumn("place", F.row_number().over(best_first))


def best_model(board: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    return board.where("place = 1").select(*keys, F.col("candidate").alias("best_model"))


def permuted(
    df: DataFrame,
    features: Sequence[str],
    repeats: int = 3,
    keys: Sequence[str] = SEGMENT,
    id_column: str = "listing_id",
) -> DataFrame:
    """Every row once per repeat, with another row's features as ``other_<feature>``.

    In each repeat the rows of a segment stand in the order of a seeded digest and take the features of the next one,
    the last those of the first. The order is cut into ranges of the digest, about ``RANGE_ROWS`` rows each: a row
    finds the next one in its range, the last of a range takes the first of the next, from a table of one row per range.
    Rows move without their digest, which hardly compresses and is made again where they are sorted.
    """
    keys = list(keys)
    ranges = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / RANGE_ROWS).alias("_ranges"))
    order = seeded_digest(F.col("repeat"), F.col(id_column))
    rows = (
        with_group_values(df, ranges, keys, "inner")
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        .withColumn("_range", F.shiftright(digest_number(order) * F.col("_ranges"), 32))
        .drop("_ranges")
    )
    taken = F.struct(*features)
    place = Window.partitionBy(*keys, "repeat").orderBy("_range")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = rows.groupBy(*keys, "repeat", "_range").agg(F.min_by(taken, F.struct(order, id_column)).alias("_first"))
    firsts = firsts.withColumn("_next", F.coalesce(F.lead("_first").over(place), F.first("_first").over(whole))).drop("_first")
    inside = Window.partitionBy(*keys, "repeat", "_range").orderBy("_order", id_column)
    together = rows.repartition(*keys, "repeat", "_range").withColumn("_order", order)
    moved = with_group_values(together.withColumn("_other", F.lead(taken).over(inside)), firsts, [*keys, "repeat", "_range"], "inner")
    chosen = F.coalesce("_other", "_next")
    return moved.withColumns({f"other_{f}": chosen[f] for f in features}).drop("_range", "_order", "_other", "_next")


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    predict_with: Mapping[str, Column],
    repeats: int = 3,
    keys: Sequence[str] = SEGMENT,
    attach: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Rise of the mean absolute error when one feature is taken from another row: mean and deviation over repeats.

    ``predict_with[f]`` is the prediction with ``other_<f>`` in place of ``f``; rows carry ``prediction_label``.
    The repeats are the seeds of their orders. ``attach`` adds what predictions read of the group, such as its model, to
    the rows once they have moved.
    """
    keys = list(keys)
    shuffled = attach(permuted(df, features, repeats, keys))
    base = F.abs(F.col("price") - F.col("prediction_label"))
    worse = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), (F.abs(F.col("price") - predict_with[f]) - base).alias("_rise"))
            for f in features
        ]
    )
    return (
        shuffled.select(*keys, "repeat", F.inline(worse))
        .groupBy(*keys, "feature", "repeat")
        .agg(F.avg("_rise").alias("_rise"))
        .groupBy(*keys, "feature")
        .agg(F.avg("_rise").alias("importance"), F.stddev_samp("_rise").alias("stddev"))
    )


def importance_rank(importances: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Importances in rising order within each group."""
    return importances.orderBy(*keys, "importance", "feature")


def residual_histogram(df: DataFrame, bins: int = 30, keys: Sequence[str] = SEGMENT) -> DataFrame:
    return histogram(df, "residual", bins, keys)


def residual_vs_predicted(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Actual, predicted and residual of each row, with the range of the diagonal line of its segment."""
    line = df.groupBy(*keys).agg(
        F.least(F.min(F.col("price").cast("double")), F.min("prediction_label")).alias("xy_min"),
        F.greatest(F.max(F.col("price").cast("double")), F.max("prediction_label")).alias("xy_max"),
    )
    rows = df.select(*keys, "listing_id", F.col("price").alias("actual"), F.col("prediction_label").alias("predicted"),
                     "residual", "abs_residual")
    return with_group_values(rows, line, keys, "inner")


def model_info(entries: DataFrame, best: DataFrame, tails: DataFrame) -> DataFrame:
    """Header of the diagnostics: day trained, rows, best model, tail bounds and sizes."""
    shown = entries.where("kind = 'specific'").select(
        *SEGMENT, F.substring(F.col("training_date").cast("string"), 1, 10).alias("training_day"), "n_training_samples"
    )
    tail_columns = tails.select(
        *SEGMENT, "q25", "q75", "low_n", F.col("low").isNotNull().alias("low_model"), "high_n",
        F.col("high").isNotNull().alias("high_model"),
    )
    return shown.join(best, list(SEGMENT), "left").join(tail_columns, list(SEGMENT), "left")
