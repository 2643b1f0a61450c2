"""Valuation: estimate, interval, tail correction and what-ifs, for any number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.config import SEGMENT, BlendSettings
from dealwright.functions import scoring
from dealwright.operators import train
from dealwright.operators.joins import with_group_values

def attach_specific(df: DataFrame, models: DataFrame) -> DataFrame:
    """Add each row's segment model under the prefix ``s_``; rows of segments without one keep nulls.

    ``models`` is a stored table, as ``train_specific`` and ``train_ridge`` return.
    """
    renamed = models.select(*SEGMENT, *[F.col(c).alias(f"s_{c}") for c in models.columns if c not in SEGMENT])
    return with_group_values(df, renamed, SEGMENT, stored=True)


def drop_models(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("s_") or c.startswith("general_") and c.endswith("_effect")])


def predict_blended(
    df: DataFrame,
    models: DataFrame,
    general: train.GeneralModel | None,
    blend: BlendSettings = BlendSettings(),
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``specific``, ``general``, ``weight`` and ``prediction_label``.

    ``reason`` says why a row has no estimate. The models stay attached, so what-ifs can be scored in place.
    """
    out = attach_specific(df, models)
    out = general.attach(out) if general else out
    general_value = general.value() if general else F.lit(None).cast("double")
    out = out.withColumns(
        {
            "specific": train.specific_value("s_", features=features),
            "general": general_value,
            "weight": scoring.blend_weight(F.col("s_n"), blend),
        }
    )
    return out.withColumn(
        "prediction_label", scoring.blended(F.col("specific"), F.col("general"), F.col("s_n"), blend)
    ).withColumn("reason", F.when(F.col("prediction_label").isNull(), "no model available"))


def predict_interval(df: DataFrame, quantiles: train.QuantileModel) -> DataFrame:
    """Add the 80% and 50% intervals as structs (lo, hi)."""
    rows = quantiles.attach(df)
    return rows.withColumns(
        {
            "ci_80": F.struct(F.col("q10").alias("lo"), F.col("q90").alias("hi")),
            "ci_50": F.struct(F.col("q25").alias("lo"), F.col("q75").alias("hi")),
        }
    ).drop(*train.QUANTILE_LEVELS)


def line_of(model: str) -> Column:
    """Value of a line kept in a struct column."""
    m = F.col(model)
    return m["intercept"] + m["b_age"] * F.col("age") + m["b_odometer"] * F.col("odometer")


def ridge_of(model: str, features=train.NUMERIC_FEATURES) -> Column:
    """Value of a ridge kept in a struct column."""
    total = F.col(model)["intercept"]
    for i, f in enumerate(features):
        total = total + F.col(model)["coefficients"][i] * train.feature_value(f)
    return total


def tail_adjust(df: DataFrame, tails: DataFrame, value=ridge_of) -> DataFrame:
    """Pull estimates beyond the quartiles half way to the tail model; adds ``estimate`` and ``tail``."""
    bounds = tails.select(
        *SEGMENT, F.col("q25").alias("t_q25"), F.col("q75").alias("t_q75"), F.col("low").alias("t_low"),
        F.col("high").alias("t_high"),
    )
    point = F.col("prediction_label")
    return (
        with_group_values(df, bounds, SEGMENT, stored=True)
        .withColumn(
            "tail", scoring.tail_side(point, F.col("t_q25"), F.col("t_q75"), F.col("t_low"), F.col("t_high"))
        )
        .withColumn("estimate", scoring.tail_adjusted(point, F.col("tail"), value("t_low"), value("t_high")))
        .drop("t_q25", "t_q75", "t_low", "t_high")
    )


def regional_compare(
    df: DataFrame,
    region: str,
    base: str = "specific",
    skip_own: bool = False,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Value in another region against the estimate; with ``skip_own``, nothing for rows already there.

    The segment model is still attached, so this is one more expression on the row, not a second pass.
    """
    there = train.specific_value("s_", region=F.lit(region), features=features)
    elsewhere = F.col("region") != region if skip_own else F.lit(True)
    return df.withColumns(
        {
            "comparison_value": F.when(elsewhere, there),
            "regional_diff": F.when(elsewhere, there - F.col(base)),
            "regional_diff_pct": F.when(elsewhere, scoring.pct_change(there, F.col(base))),
        }
    )


def depreciation(
    df: DataFrame, distance: float = 10000.0, base: str = "specific", features: Sequence[str] | None = None
) -> DataFrame:
    """Value a year on, with and without the given distance, and the drops from today's value."""
    older = F.col("age") + 1
    driven = train.specific_value("s_", age=older, odometer=F.col("odometer") + distance, features=features)
    parked = train.specific_value("s_", age=older, features=features)
    return (
        df.withColumns({"value_10k": driven, "value_0k": parked})
        .withColumns(
            {"depreciation_10k": F.col(base) - F.col("value_10k"), "depreciation_0k": F.col(base) - F.col("value_0k")}
        )
        .withColumn("reliable", (F.col("depreciation_10k") > 0) & (F.col("depreciation_0k") > 0))
    )


def future_features(df: DataFrame, years: int = 1, distance: float = 0.0) -> DataFrame:
    """Feature rows as they will be after some years and some distance."""
    age = F.col("age") + years
    odometer = F.col("odometer") + distance
    at_least_one = F.when(age < 1, 1).otherwise(age)
    return df.withColumns(
        {
            "year": F.col("year") - years,
            "age": age,
            "odometer": odometer,
            "km_per_year": F.try_divide(odometer, at_least_one),
        }
    )


def asking_vs_estimate(df: DataFrame, asking: str = "price", estimate: str = "prediction_label") -> DataFrame:
    return df.withColumns(
        {
            "diff": F.col(asking) - F.col(estimate),
            "diff_pct": scoring.pct_change(F.col(asking), F.col(estimate)),
        }
    )
