"""Seeded, engine-independent hashes used for splits, folds and permutations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | Column, key: Column) -> Column:
    """Hex digest of 'seed|key': a reproducible random order."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat(seed, F.lit("|"), key.cast("string")))


def digest_number(digest: Column) -> Column:
    """The first 32 bits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
