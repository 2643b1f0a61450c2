"""Raw listings to model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.config import CATEGORICAL_FEATURES, TEXT_DEFAULTS, FeatureSettings
from dealwright.functions import parsing


def parse_prices(df: DataFrame) -> DataFrame:
    """Add ``price`` in whole dollars from ``price_display``; null when none can be read."""
    return df.withColumn("price", parsing.whole_price(F.col("price_display")))


def unpriced(df: DataFrame) -> DataFrame:
    """Quarantine rows of ``parse_prices``: the listings whose price text holds no amount."""
    return df.where(F.col("price").isNull()).select(
        "listing_id",
        "make",
        "model",
        F.lit("price not readable").alias("reason"),
        F.col("price_display").alias("payload"),
    )


def priced(df: DataFrame) -> DataFrame:
    return df.where(F.col("price").isNotNull())


def project_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the configured columns that exist."""
    return df.select(*[c for c in columns if c in df.columns])


def fill_text_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({c: v for c, v in TEXT_DEFAULTS.items() if c in df.columns})


def derive_age_km(df: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Add ``age`` and ``km_per_year``; ages under one year count as one, an unknown age stays unknown."""
    age = F.lit(as_of_year) - F.col("year")
    years = F.when(age < 1, 1).otherwise(age)
    return df.withColumns({"age": age.cast("int"), "km_per_year": F.try_divide(F.col("odometer"), years)})


def coerce_flags(df: DataFrame) -> DataFrame:
    """``is_new`` to 0/1 with null as 0; the other flags to 0/1, kept null when unknown."""
    changes = {c: F.col(c).cast("int") for c in ("is_4wd", "is_dealer") if c in df.columns}
    if "is_new" in df.columns:
        changes["is_new"] = F.coalesce(F.col("is_new").cast("int"), F.lit(0))
    return df.withColumns(changes) if changes else df


def coerce_categoricals(df: DataFrame, columns: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Categories as text with one spelling per value."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    changes = {c: parsing.canonical_category(F.col(c), c in numeric) for c in columns if c in df.columns}
    return df.withColumns(changes) if changes else df


def default_labels(df: DataFrame) -> DataFrame:
    """Replace the free-text columns by 'Unknown' labels, as when no classifier has been trained."""
    for text, label in (("exterior_colour", "colour_label"), ("stereo_description", "stereo_label")):
        if text in df.columns:
            df = df.withColumn(label, F.lit("Unknown")).drop(text)
    return df


def feature_engineering(
    df: DataFrame, settings: FeatureSettings = FeatureSettings(), labeller=default_labels, outliers=None
) -> DataFrame:
    """Raw listings to the feature table.

    ``labeller`` turns the free-text columns into labels. ``outliers`` is applied last, when prices are known.
    Listings without a readable price are left out here; ``unpriced`` returns them.
    """
    out = df.transform(parse_prices).transform(priced).transform(project_features, settings.columns)
    out = out.transform(fill_text_defaults).transform(labeller)
    out = out.transform(derive_age_km, settings.as_of_year).transform(coerce_flags).transform(coerce_categoricals)
    return outliers(out) if outliers else out


def build_data_points(specs: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Specs of cars to value, one per row, to feature rows; not new and not a dealer unless stated."""
    out = specs
    for flag in ("is_new", "is_dealer"):
        if flag not in out.columns:
            out = out.withColumn(flag, F.lit(False))
    out = out.withColumns({c: F.col(c).cast("int") for c in ("is_4wd", "is_new", "is_dealer")})
    return out.transform(derive_age_km, as_of_year).transform(coerce_categoricals)
