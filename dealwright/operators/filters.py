"""Row selection: auctions, thin segments, configured rules, ranges."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.config import SEGMENT, FilterRule
from dealwright.operators.joins import with_group_values

COMPARISONS = {
    "==": operator.eq,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "!=": lambda column, value: ~column.eqNullSafe(value),
}


def filter_non_auction(df: DataFrame) -> DataFrame:
    """Fixed-price listings only; all of them when bids are not recorded."""
    return df.where(F.col("bid_count").isNull()) if "bid_count" in df.columns else df


def segment_sizes(df: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def segment_counts(df: DataFrame, name: str, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Add the number of rows of each row's segment."""
    return with_group_values(df, segment_sizes(df, keys).withColumnRenamed("n", name), keys)


def min_rows_gate(df: DataFrame, minimum: int, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Rows of the segments holding at least ``minimum`` rows."""
    large = segment_sizes(df, keys).where(F.col("n") >= minimum)
    return with_group_values(df, large.select(*keys), keys, "left_semi")


def rule_condition(rule: FilterRule) -> Column:
    if rule.operator not in COMPARISONS:
        raise ValueError(f"unknown comparison {rule.operator!r}")
    return COMPARISONS[rule.operator](F.col(rule.column), F.lit(rule.value))


def apply_filters(df: DataFrame, rules: Iterable[FilterRule | None]) -> DataFrame:
    """Rows meeting every usable rule; a rule without column, operator or value, or on a missing column, is skipped."""
    usable = [
        rule_condition(r)
        for r in rules or ()
        if r and r.column and r.operator and r.value is not None and r.column in df.columns
    ]
    return df.where(reduce(operator.and_, usable)) if usable else df


def select_listing(df: DataFrame, listing_id, id_column: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """The one listing to value, and the rest; a null id selects nothing."""
    chosen = F.col(id_column).eqNullSafe(F.lit(listing_id)) & F.lit(listing_id is not None)
    return df.where(chosen), df.where(~chosen)


def whole_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """The full range of each column in whole numbers, as the range selectors start out."""
    aggregates = [F.floor(F.min(c)) for c in columns] + [F.ceil(F.max(c)) for c in columns]
    row = df.agg(*aggregates).first()
    half = len(columns)
    return {c: (row[i], row[i + half]) for i, c in enumerate(columns) if row[i] is not None}


def range_filters(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows inside every inclusive range."""
    for column, (low, high) in ranges.items():
        df = df.where(F.col(column).between(low, high))
    return df


def listing_url(df: DataFrame, base: str, id_column: str = "listing_id") -> DataFrame:
    return df.withColumn("url", F.concat(F.lit(base), F.col(id_column).cast("string")))


def attach_listing_info(df: DataFrame, info: DataFrame) -> DataFrame:
    """Add title, price text and original region by listing id."""
    columns = [c for c in ("title", "price_display") if c in info.columns]
    extra = [F.col("region").alias("orig_region")] if "region" in info.columns else []
    return df.join(info.select("listing_id", *columns, *extra), "listing_id", "left")


def display_projection(df: DataFrame, comparison_region: str | None = None) -> DataFrame:
    """The deal columns that exist, in display order, named and formatted for reading."""

    def dollars(c):
        return F.concat(F.lit("$"), F.format_number(F.col(c), 0))

    def percent(c, sign=""):
        return F.format_string(f"%{sign}.1f%%", F.col(c))

    region = "region" if "region" in df.columns else "orig_region"
    layout = [
        ("make", "Make", F.col),
        ("model", "Model", F.col),
        ("title", "Title", F.col),
        ("price", "price", dollars),
        ("prediction_label", "Est. Value", dollars),
        ("discount_pct", "Discount", percent),
        (region, "Region", F.col),
    ]
    if comparison_region:
        layout += [
            ("comparison_value", f"{comparison_region} Value", dollars),
            ("regional_diff_pct", "Region Diff", lambda c: percent(c, "+")),
        ]
    layout.append(("listing_id", "ListingId", F.col))
    return df.select(*[show(c).alias(name) for c, name, show in layout if c in df.columns])
