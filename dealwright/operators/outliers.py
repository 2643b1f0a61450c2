"""Listings whose price does not fit their features, per segment.

Two strategies: an isolation forest, and a robust z-score on price and yearly distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.config import CATEGORICAL_FEATURES, SEGMENT, OutlierSettings
from dealwright.operators.joins import with_group_values
from dealwright.operators.quantiles import exact_quantiles
from dealwright.session import SMALL, materialise

ROWS_PER_SCORING_GROUP = 50_000
#: Types that a task reads as doubles just as Spark casts them.
PLAIN_NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)


# --- Robust z-score -----------------------------------------------------------------------------------------


def _medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str], prefix: str) -> DataFrame:
    """Medians of several columns per group in one pass, as ``<prefix><column>``."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns]
    )
    medians = exact_quantiles(df.select(*keys, F.inline(pairs)), [*keys, "_name"], "_value", {"_median": 0.5})
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(f"{prefix}{c}") for c in columns]
    )


def robust_scores(
    df: DataFrame, columns: Sequence[str] = ("price", "km_per_year"), keys: Sequence[str] = SEGMENT
) -> DataFrame:
    """Add ``<column>_z``: distance from the segment median in units of 1.4826 median absolute deviations."""
    keys = list(keys)
    centres = materialise(_medians(df, columns, keys, "_median_"))
    away = with_group_values(df.select(*keys, *columns), centres, keys, "inner", stored=True).select(
        *keys, *[F.abs(F.col(c) - F.col(f"_median_{c}")).alias(c) for c in columns]
    )
    spreads = _medians(away, columns, keys, "_mad_")
    limits = materialise(centres.join(spreads, keys))
    z = {
        f"{c}_z": F.try_divide(0.6745 * F.abs(F.col(c) - F.col(f"_median_{c}")), F.col(f"_mad_{c}")) for c in columns
    }
    scored = with_group_values(df, limits, keys, stored=True).withColumns(z)
    return scored.drop(*[f"{p}{c}" for p in ("_median_", "_mad_") for c in columns])


def flag_robust(
    df: DataFrame,
    threshold: float = 3.5,
    columns: Sequence[str] = ("price", "km_per_year"),
    keys: Sequence[str] = SEGMENT,
) -> DataFrame:
    """Add ``is_outlier``: any column lies more than ``threshold`` robust deviations from its median."""
    scored = robust_scores(df, columns, keys)
    beyond = F.greatest(*[F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) for c in columns], F.lit(0.0)) > threshold
    return scored.withColumn("is_outlier", beyond).drop(*[f"{c}_z" for c in columns])


# --- Isolation forest ---------------------------------------------------------------------------------------


def category_codes(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SEGMENT, suffix: str = ""
) -> DataFrame:
    """Replace categories by their position among the segment's sorted categories, null by -1; with a ``suffix`` the
    positions are further columns.

    The lists hold distinct categories of a small vocabulary per segment, never rows.
    """
    if not columns:
        return df
    vocabularies = df.groupBy(*keys).agg(
        *[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"_{c}_words") for c in columns]
    )
    position = {
        c: F.when(F.col(c).isNull(), -1).otherwise(F.array_position(f"_{c}_words", F.col(c).cast("string")) - 1)
        for c in columns
    }
    coded = with_group_values(df, vocabularies, keys)
    return coded.withColumns({f"{c}{suffix}": p.cast("double") for c, p in position.items()}).drop(
        *[f"_{c}_words" for c in columns]
    )


def forest_features(df: DataFrame, exclude: Sequence[str] = ("listing_id", *SEGMENT)) -> tuple[list[str], list[str]]:
    """Columns the forest looks at, price included, and those among them that are categories.

    Of the text columns only the known categories count: titles and other free text have no small vocabulary.
    """
    words = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    columns = [c for c in df.columns if c not in exclude and (c not in words or c in CATEGORICAL_FEATURES)]
    return columns, [c for c in words if c in columns]


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    deep = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_trees(
    x: np.ndarray, tree: np.ndarray, trees: int, rows_per_tree: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Isolation trees as complete binary arrays: split feature (-1 in a leaf), threshold, path length.

    Row i of ``x`` belongs to tree ``tree[i]``. Each node splits a random non-constant feature at a random point of its
    range, down to the depth of a balanced tree of ``rows_per_tree`` rows. All trees grow together, level by level.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    depth = max(int(np.ceil(np.log2(max(rows_per_tree, 2)))), 1)
    size = 2 ** (depth + 1) - 1
    feature = np.full((trees, size), -1, dtype=np.int16)
    threshold = np.zeros((trees, size))
    path = np.zeros((trees, size), dtype=np.float32)
    node, open_rows = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for level in range(depth + 1):
        first, width = 2**level - 1, 2**level
        cell = (tree * width + node - first)[open_rows]
        values = x[open_rows]
        count = np.bincount(cell, minlength=trees * width).reshape(trees, width)
        here = slice(first, first + width)
        path[:, here] = level + average_path(count)
        if level == depth or not len(cell):
            break
        order = np.argsort(cell, kind="stable")
        filled, starts = np.unique(cell[order], return_index=True)
        low, high = np.zeros((trees * width, d)), np.zeros((trees * width, d))
        low[filled] = np.minimum.reduceat(values[order], starts, axis=0)
        high[filled] = np.maximum.reduceat(values[order], starts, axis=0)
        varies = high > low
        chance = np.where(varies, rng.random(varies.shape), -1.0)
        chosen = chance.argmax(axis=1)
        at = np.arange(trees * width)
        splits = varies.any(axis=1) & (count.ravel() > 1)
        lo, hi = low[at, chosen], high[at, chosen]
        cut = lo + rng.random(len(at)) * (hi - lo)
        feature[:, here] = np.where(splits, chosen, -1).reshape(trees, width)
        threshold[:, here] = cut.reshape(trees, width)
        open_rows[open_rows] = splits[cell]
        rows = np.flatnonzero(open_rows)
        current = node[rows]
        right = x[rows, feature[tree[rows], current]] > threshold[tree[rows], current]
        node[rows] = 2 * current + 1 + right
    return feature, threshold, path


def path_scores(
    x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray, rows_per_tree: int
) -> np.ndarray:
    """Anomaly score in (0, 1): near 1 for rows that random splits isolate early."""
    trees, size = feature.shape
    levels = int(np.log2(size + 1))
    # a leaf hands its path to all below it, so that every row goes down to the last level without asking where it stops
    path, closed = path.copy(), feature < 0
    for level in range(levels - 1):
        here, below = slice(2**level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
        ends = np.repeat(closed[:, here], 2, axis=1)
        closed[:, below] |= ends
        path[:, below] = np.where(ends, np.repeat(path[:, here], 2, axis=1), path[:, below])
    split, cut, path = np.maximum(feature, 0).astype(np.intp).ravel(), threshold.ravel(), path.ravel()
    first = np.arange(trees) * size
    depth = np.empty(len(x))
    for start in range(0, len(x), 500):  # few rows, so that what is looked up stays in the processor's caches
        rows = x[start : start + 500]
        values, before = rows.ravel(), np.arange(len(rows))[:, None] * rows.shape[1]
        node = np.repeat(first[None, :], len(rows), axis=0)
        for _ in range(levels - 1):
            right = values.take(split.take(node) + before) > cut.take(node)
            node *= 2
            node -= first - 1
            node += right
        depth[start : start + 500] = path.take(node).mean(axis=1)
    return 2.0 ** (-depth / max(float(average_path(np.array(rows_per_tree))), 1e-12))


def drawn_rows(
    df: DataFrame, sizes: DataFrame, settings: OutlierSettings, keys: Sequence[str], id_column: str = "listing_id"
) -> DataFrame:
    """A row for each tree that a listing is drawn for, with ``tree``.

    One rule for a segment of any size n: a (listing, tree) pair is drawn if a seeded hash of both falls below
    rows_per_tree / n. So a tree has about rows_per_tree rows, all of a smaller segment's, and is drawn in the JVM.
    """
    chance = F.least(F.lit(1.0), F.lit(float(settings.rows_per_tree)) / F.col("_rows"))
    low = (chance * F.lit(float(1 << 62))).cast("bigint")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), "tree", F.col(id_column)), 2) < low
    sized = with_group_values(df, sizes, keys, "inner", stored=True)
    # the trees as rows that a condition thins out are compiled, a lambda over an array of them is not
    return sized.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(settings.trees - 1)))).where((chance >= 1) | drawn)


def fit_forests(
    df: DataFrame,
    sizes: DataFrame,
    settings: OutlierSettings = OutlierSettings(),
    keys: Sequence[str] = SEGMENT,
) -> DataFrame:
    """One serialised forest per segment, from rows (keys, listing_id, _x): ``_x`` holds the features as numbers.

    ``sizes`` is a stored table of (keys, _rows). A group handed to Python holds about trees x rows_per_tree rows.
    """
    keys = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "listing_id"])
        rows = int(min(settings.rows_per_tree, pdf["_rows"].iloc[0]))
        x = np.nan_to_num(np.stack(pdf["_x"].to_numpy()).astype(float))
        feature, threshold, path = grow_trees(x, pdf["tree"].to_numpy(), settings.trees, rows, settings.seed)
        out = pdf[keys].head(1).copy()
        out["rows_per_tree"], out["nodes"] = rows, feature.shape[1]
        out["features"], out["thresholds"], out["paths"] = feature.tobytes(), threshold.tobytes(), path.tobytes()
        return out

    schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("rows_per_tree", T.IntegerType()),
            T.StructField("nodes", T.IntegerType()),
            T.StructField("features", T.BinaryType()),
            T.StructField("thresholds", T.BinaryType()),
            T.StructField("paths", T.BinaryType()),
        ]
    )
    drawn = drawn_rows(df.select(*keys, "listing_id", "_x"), sizes, settings, keys)
    return drawn.groupBy(*keys).applyInPandas(fit, schema)


def _as_numbers(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """The columns side by side as doubles, null as 0."""
    wide = [rows.column(c).cast(pa.float64(), safe=False).fill_null(0.0).to_numpy() for c in columns]
    return np.column_stack(wide) if wide else np.empty((rows.num_rows, 0))


def score_forest(
    df: DataFrame,
    forests: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = SEGMENT,
    numbers: Sequence[str] = (),
    drop: Sequence[str] = ("_x",),
) -> DataFrame:
    """All columns of ``df`` but those to ``drop``, and ``score``: every row by the forest of its segment.

    Rows meet their forest in groups of about ``ROWS_PER_SCORING_GROUP``: a large segment is cut into that many
    parts by a hash of the id, and its forest is copied to each part. The forest looks at the array ``_x`` or, so that no
    number moves twice, at the columns ``numbers``.
    """
    keys = list(keys)
    parts = F.ceil(F.col("_rows") / ROWS_PER_SCORING_GROUP).cast("int")
    sized = with_group_values(df, sizes, keys, "inner", stored=True)
    rows = sized.withColumn("_part", F.pmod(F.xxhash64("listing_id"), parts).cast("int")).drop("_rows")
    copies = forests.join(sizes, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_rows")
    kept = [c for c in df.columns if c not in drop]

    def score(group: pa.Table, forest: pa.Table) -> pa.Table:
        scores = np.zeros(group.num_rows)
        if group.num_rows and forest.num_rows:
            f = {c: forest.column(c)[0].as_py() for c in ("nodes", "rows_per_tree", "features", "thresholds", "paths")}
            if numbers:
                x = _as_numbers(group, numbers)
            else:
                x = group.column("_x").combine_chunks()
                x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
                x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(group.num_rows, -1)
            shape = (-1, f["nodes"])
            scores = path_scores(
                np.nan_to_num(x),
                np.frombuffer(f["features"], dtype=np.int16).reshape(shape),
                np.frombuffer(f["thresholds"]).reshape(shape),
                np.frombuffer(f["paths"], dtype=np.float32).reshape(shape),
                f["rows_per_tree"],
            )
        return group.select(kept).append_column("score", pa.array(scores))

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    by = [*keys, "_part"]
    return rows.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(score, schema)


def flag_isolation_forest(
    df: DataFrame, settings: OutlierSettings = OutlierSettings(), keys: Sequence[str] = SEGMENT
) -> DataFrame:
    """Add ``is_outlier``: the share ``contamination`` of every segment that is easiest to isolate.

    Rows keep their columns through scoring; beside them move the positions of categories and what else is no plain number
    yet. A row without make or model belongs to no segment and is never flagged.
    """
    keys = list(keys)
    columns, words = forest_features(df, ("listing_id", *keys))
    named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    coded = category_codes(df.where(named), words, keys, suffix="_code")
    plain = {f.name for f in df.schema.fields if isinstance(f.dataType, PLAIN_NUMBERS)}
    numbers = {c: c if c in plain else f"_{c}_number" for c in columns}
    made = {n: F.col(f"{c}_code").cast("int") if c in words else F.col(c).cast("double") for c, n in numbers.items() if n != c}
    rows = materialise(coded.withColumns(made).select(*df.columns, *made), SMALL)
    sizes = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numbers.values()])
    forests = materialise(fit_forests(rows.withColumn("_x", x), sizes, settings, keys))
    scores = materialise(score_forest(rows, forests, sizes, keys, list(numbers.values()), list(made)), SMALL)
    cuts = exact_quantiles(scores, keys, "score", {"_cut": 1 - settings.contamination})
    flagged = with_group_values(scores, cuts, keys).withColumn("is_outlier", F.col("score") > F.col("_cut"))
    flagged = flagged.select(*df.columns, "is_outlier")
    return flagged.unionByName(df.where(~named).withColumn("is_outlier", F.lit(False)))


# --- The switch ---------------------------------------------------------------------------------------------


def flag_outliers(df: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    """Add ``is_outlier`` by the configured method."""
    if settings.method == "none":
        return df.withColumn("is_outlier", F.lit(False))
    if settings.method == "robust":
        return flag_robust(df, settings.robust_z)
    if settings.method == "isolation_forest":
        return flag_isolation_forest(df, settings)
    raise ValueError(f"unknown outlier method {settings.method!r}")


def remove_outliers(df: DataFrame, settings: OutlierSettings = OutlierSettings()) -> DataFrame:
    if settings.method == "none":
        return df
    return flag_outliers(df, settings).where(~F.coalesce("is_outlier", F.lit(False))).drop("is_outlier")


def outlier_report(flagged: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """Rows, removed rows and their share per segment."""
    removed: Column = F.sum(F.col("is_outlier").cast("int"))
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        removed.alias("n_removed"),
        (removed / F.count(F.lit(1)) * 100).alias("removed_pct"),
    )


def removed_listings(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_outlier").select("listing_id", "year", "odometer", "price")
