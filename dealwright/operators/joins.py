"""Joining rows to one-row-per-group values, whatever the number of groups and however uneven they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from dealwright.session import materialise


def with_group_values(
    df: DataFrame, values: DataFrame, keys: Sequence[str], how: str = "left", stored: bool = False
) -> DataFrame:
    """Join ``values``, rows one per group, to the rows of ``df``.

    The values are a stored table (written here unless ``stored`` says they are), so Spark knows their bytes when it
    plans: it copies them to the rows where they are small, by its own threshold, and otherwise shuffles both sides, where
    adaptive execution splits the large groups of ``df`` over several tasks.
    """
    return df.join(values if stored else materialise(values), list(keys), how)
