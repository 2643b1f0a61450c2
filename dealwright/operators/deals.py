"""Scored listings to ranked deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.functions.scoring import discount_pct


def add_discount(df: DataFrame) -> DataFrame:
    return df.withColumn("discount_pct", discount_pct(F.col("prediction_label"), F.col("price")))


def undervalued_pct(df: DataFrame, low: float = 40, high: float = 80) -> DataFrame:
    """Discount within the inclusive percentages, for a positive estimate."""
    return df.where((F.col("prediction_label") > 0) & F.col("discount_pct").between(low, high))


def undervalued_abs(df: DataFrame, low: float = 5000, high: float = 100000) -> DataFrame:
    """Ask below the estimate by strictly more than ``low`` and less than ``high`` dollars."""
    gap = F.col("prediction_label")
    return df.where((F.col("price") < gap - low) & (F.col("price") > gap - high))


def rank_deals(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("discount_pct"), "listing_id")


def top_deals(df: DataFrame, base_url: str, n: int = 10) -> DataFrame:
    """Links of the best deals."""
    best = rank_deals(df).limit(n)
    return best.select("listing_id", F.concat(F.lit(base_url), F.col("listing_id")).alias("url"), "discount_pct")


def deal_summary(df: DataFrame) -> DataFrame:
    """Deals found, mean discount and price range; the figures are null when nothing was found."""
    return df.agg(
        F.count(F.lit(1)).alias("n_deals"),
        F.avg("discount_pct").alias("avg_discount"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def deals_per_segment(segments: DataFrame, deals: DataFrame) -> DataFrame:
    """Deals found in every searched segment, 0 for none."""
    found = deals.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n_deals"))
    return (
        segments.select(*SEGMENT)
        .distinct()
        .join(found, list(SEGMENT), "left")
        .withColumn("n_deals", F.coalesce("n_deals", F.lit(0)))
    )
