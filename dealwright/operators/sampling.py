"""Reproducible splits: exact shares per segment without sorting a segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.functions.hashing import digest_number, seeded_digest
from dealwright.operators.joins import with_group_values


#: Rows that share the first digits of their digest, at most about, even if all rows are one group.
CELL_ROWS = 4096


def cell_digits(rows: int) -> int:
    """Hex digits that cut so many rows into cells of at most about ``CELL_ROWS``."""
    digits = 1
    while rows > CELL_ROWS * 16**digits:
        digits += 1
    return digits


def smallest_by_hash(df: DataFrame, keys: Sequence[str], id_column: str, size, seed: int, flag: str) -> DataFrame:
    """Flag exactly ``size(n)`` rows of each group: those with the smallest seeded digests.

    Digests are counted by their first hex digits, as many as the number of rows calls for; only the one cell per
    group that holds the cut is sorted, so rows are never gathered by group. ``id_column`` must be unique within a group.
    """
    keys = list(keys)
    digest = seeded_digest(seed, F.col(id_column))
    hashed = df.select(*keys, F.col(id_column).cast("string").alias("_id"), digest.alias("_h"))
    hashed = hashed.withColumn("_cell", F.substring("_h", 1, cell_digits(df.count())))
    group = Window.partitionBy(*keys).orderBy("_cell")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut_cells = (
        hashed.groupBy(*keys, "_cell")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumns({"_n": F.sum("_c").over(whole), "_below": F.sum("_c").over(group) - F.col("_c")})
        .withColumn("_k", size(F.col("_n")))
        .where((F.col("_below") < F.col("_k")) & (F.col("_k") <= F.col("_below") + F.col("_c")))
        .select(*keys, "_cell", (F.col("_k") - F.col("_below")).alias("_take"))
    )
    in_cell = Window.partitionBy(*keys, "_cell").orderBy("_h", "_id")
    cuts = (
        with_group_values(hashed, cut_cells, [*keys, "_cell"], "inner")
        .withColumn("_rank", F.row_number().over(in_cell))
        .where(F.col("_rank") == F.col("_take"))
        .select(*keys, F.struct("_h", "_id").alias("_cut"))
    )
    here = F.struct(digest.alias("_h"), F.col(id_column).cast("string").alias("_id"))
    return (
        with_group_values(df, cuts, keys)
        .withColumn(flag, F.coalesce(here <= F.col("_cut"), F.lit(False)))
        .drop("_cut")
    )


def oos_split(
    df: DataFrame, fraction: float = 0.4, seed: int = 42, id_column: str = "listing_id", keys: Sequence[str] = SEGMENT
) -> DataFrame:
    """Add ``is_oos``: exactly round-half-even(fraction * n) rows of every segment."""
    return smallest_by_hash(
        df, keys, id_column, lambda n: F.bround(F.lit(float(fraction)) * n).cast("bigint"), seed, "is_oos"
    )


def oos_split_by_threshold(
    df: DataFrame, fraction: float = 0.4, seed: int = 42, id_column: str = "listing_id"
) -> DataFrame:
    """Add ``is_oos`` by a hash threshold: no shuffle at all, the share holds on average."""
    position = digest_number(seeded_digest(seed, F.col(id_column)))
    return df.withColumn("is_oos", position < int(fraction * 2**32))


def anti_split(df: DataFrame, sample: DataFrame, id_column: str = "listing_id") -> DataFrame:
    """Rows whose key is not in the sample; where the sample is a flag on the same rows, filter by the flag instead."""
    return df.join(sample.select(id_column), id_column, "left_anti")


def union_parts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put row sets back together by column name; a column absent from one is null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
