"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealwright.operators import clean, filters
from dealwright.sources.listings import AS_OF_YEAR, FEATURES_SQL, dealt_out, listings

_NEEDS = {"price": ["price_display"], "age": ["year"], "km_per_year": ["odometer", "year"]}
THIN_SQL = FEATURES_SQL + """,
thin AS (SELECT * REPLACE (thin_model AS model) FROM features)"""


def features(spark: SparkSession, sf_dir: str, *columns: str, thin: bool = False) -> DataFrame:
    """Fixed-price listings with a readable price, cleaned, with just the columns asked for.

    ``thin`` uses the finer segments (type and size), many of which are too small for a model of their own.
    """
    needed = {raw for c in columns for raw in _NEEDS.get(c, [c])} | {"price_display", "bid_count"}
    if thin:
        needed = needed - {"model"} | {"thin_model"}
    df = listings(spark, sf_dir, *sorted(needed))
    if thin:
        df = df.withColumnRenamed("thin_model", "model")
    df = df.transform(filters.filter_non_auction).transform(clean.parse_prices).transform(clean.priced)
    if {"age", "km_per_year"} & set(columns):
        if "odometer" not in df.columns:
            df = df.withColumn("odometer", F.lit(None).cast("double"))
        df = df.transform(clean.derive_age_km, AS_OF_YEAR)
    df = df.transform(clean.fill_text_defaults).transform(clean.coerce_flags)
    text = [c for c in ("region", "transmission", "fuel", "cylinders") if c in df.columns]
    return dealt_out(spark, sf_dir, df.transform(clean.coerce_categoricals, text).select(*columns))
