"""Price models by absolute error and by quantile, for all segments and levels in one job.

The pinball loss of a level tau is minimised by majorisation: in each round a row counts with the inverse of its distance
from the current fit, and the next fit follows from weighted sums of products, grouped by segment and level and combined
on the map side. Segments and levels that have settled leave, with their rows. The last step is exact: along the intercept
(or, without one, along the whole fit) the best move is a weighted quantile of what is left. Level one half is the fit by
absolute error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealwright.config import NUMERIC_FEATURES, QUANTILE_LEVELS, SEGMENT
from dealwright.operators.joins import with_group_values
from dealwright.operators.quantiles import exact_quantiles, weighted_quantile
from dealwright.operators.train import CENTRES, EFFECT_SHRINKAGE, SPREADS, QuantileModel, feature_value, ridge_value
from dealwright.session import materialise

ROUNDS, SETTLED = 16, 1e-4
#: A row's distance from the fit counts as this part of the mean one at least: falls to three tenths each round, down to the second.
FIRST_FLOOR, LAST_FLOOR = 0.5, 1e-3


def _prepared(df: DataFrame, keys: Sequence[str], features: Sequence[str], intercept: bool) -> tuple[DataFrame, list[str]]:
    """Stored rows (keys, _z0 .. , _y): the features near one in size, and a one for the intercept in front."""
    centre = (lambda f: CENTRES.get(f, 0.0)) if intercept else (lambda f: 0.0)
    z = [(feature_value(f) - centre(f)) / SPREADS.get(f, 1.0) for f in features]
    columns = [F.lit(1.0), *z] if intercept else z
    names = [f"_z{i}" for i in range(len(columns))]
    rows = df.where(F.col("price").isNotNull()).select(
        *keys, *(c.alias(n) for c, n in zip(columns, names, strict=True)), F.col("price").cast("double").alias("_y")
    )
    return materialise(rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)))), names


def _fit_value(names: Sequence[str]) -> Column:
    return reduce(lambda total, i: total + F.col("_b")[i] * F.col(names[i]), range(len(names)), F.lit(0.0))


def _sums(met: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Weighted sums of each group and level, and the loss of the fit they start from."""
    rest = F.col("_y") - _fit_value(names)
    rows = met.select(*keys, "_level", "_tau", *names, "_y", rest.alias("_r"), (1 / (F.abs(rest) + F.col("_floor"))).alias("_w"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    w = F.col("_w")
    return rows.groupBy(*keys, "_level").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(F.col("_r") > 0, F.col("_tau") * F.col("_r")).otherwise((F.col("_tau") - 1) * F.col("_r"))).alias("_now"),
        F.array(*(F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs)).alias("_zz"),
        F.array(*(F.sum(w * F.col(n) * F.col("_y")) for n in names)).alias("_zy"),
        F.array(*(F.sum(n) for n in names)).alias("_z"),
    )


def _state_type(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    for name, kind in (("_level", "string"), ("_tau", "double"), ("_b", "array<double>"), ("_n", "bigint"),
                       ("_best", "array<double>"), ("_loss", "double"), ("_now", "double"), ("_floor", "double"), ("_rounds", "int"), ("_open", "boolean")):
        fields.append(T.StructField(name, T._parse_datatype_string(kind)))
    return T.StructType(fields)


def _next(size: int):
    """The state after a round from the one before (old columns) and its sums."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = [(i, j) for i in range(size) for j in range(i, size)]
        for pdf in batches:
            if not len(pdf):
                continue
            square = np.zeros((len(pdf), size, size))
            flat = np.stack(pdf["_zz"].to_numpy()).astype(float)
            for k, (i, j) in enumerate(at):
                square[:, i, j] = square[:, j, i] = flat[:, k]
            tau = pdf["_tau"].to_numpy(float)
            right = np.stack(pdf["_zy"].to_numpy()).astype(float)
            rounds = pdf["_rounds"].to_numpy(int)
            # the first step has equal weights: least squares, which no later choice may be worse than
            pull = np.where(rounds > 0, 2 * tau - 1, 0.0)
            right = right + pull[:, None] * np.stack(pdf["_z"].to_numpy()).astype(float)
            # so small a penalty decides only between features that say the same
            ease = 1e-10 * np.trace(square, axis1=1, axis2=2) / size + 1e-300
            found = np.linalg.solve(square + ease[:, None, None] * np.eye(size), right[:, :, None])[:, :, 0]
            loss, before, least = (pdf[c].to_numpy(float) for c in ("_now", "_before", "_loss"))
            mean = loss / pdf["_n"].to_numpy(float)
            part = np.maximum(FIRST_FLOOR * 0.3**rounds, LAST_FLOOR)
            settled = (part <= LAST_FLOOR) & (np.abs(before - loss) <= SETTLED * loss) | (loss <= 0)
            # a fit without loss stays: its floor would be none
            keep = loss <= 0
            old, best = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("_b", "_best"))
            better = loss < least
            yield pdf.assign(
                _b=list(np.where(keep[:, None], old, found)), _best=list(np.where(better[:, None], old, best)),
                _loss=np.where(better, loss, least), _floor=np.maximum(mean * part, 1e-12), _rounds=rounds + 1,
                _open=~settled & (rounds + 1 < ROUNDS),
            ).drop(columns=["_zz", "_zy", "_z", "_before"])

    return solve


def fit_levels(
    df: DataFrame,
    levels: Mapping[str, float] = QUANTILE_LEVELS,
    keys: Sequence[str] = SEGMENT,
    features: Sequence[str] = NUMERIC_FEATURES,
    intercept: bool = True,
    min_rows: int = 1,
) -> DataFrame:
    """A stored table (keys, level, n, intercept, coefficients, loss) of linear fits of price at every level.

    ``loss`` is the mean pinball loss. Null features count as 0, rows without a price or with a null key are left out. With
    an intercept, a share of rows as large as the level lies at or below the fit; without one it is exactly 0.
    """
    keys, features = list(keys), list(features)
    rows, names = _prepared(df, keys, features, intercept)
    size = len(names)
    kind = _state_type(rows, keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_mean"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("_level"), F.lit(float(p)).alias("_tau")) for n, p in levels.items())))
    start = F.array(*([F.col("_mean")] if intercept else []), *[F.lit(0.0)] * (size - intercept))
    state = counts.where(F.col("_n") >= min_rows).select(*keys, "_n", "_mean", each.alias("_l")).select(
        *keys, "_l._level", "_l._tau", start.alias("_b"), "_n", start.alias("_best"),
        F.lit(float("inf")).alias("_loss"), F.lit(float("inf")).alias("_now"),
        (1e9 * F.abs("_mean") + 1e9).alias("_floor"), F.lit(0).alias("_rounds"), F.lit(True).alias("_open"),
    )
    open_, done = materialise(state.select(*kind.names)), []
    while not open_.isEmpty():
        sums = _sums(rows.join(open_.select(*keys, "_level", "_tau", "_b", "_floor"), keys), keys, names)
        old = open_.select(*keys, "_level", "_tau", "_b", "_best", "_loss", F.col("_now").alias("_before"), "_rounds")
        new = materialise(sums.join(old, [*keys, "_level"]).mapInPandas(_next(size), kind))
        done.append(new.where(~F.col("_open")))
        open_ = new.where("_open")
    fitted = reduce(DataFrame.unionByName, done) if done else open_
    fitted = materialise(fitted.withColumn("_b", F.col("_best")))

    along = F.lit(1.0) if intercept else _fit_value(names)
    left = rows.join(fitted.select(*keys, "_level", "_tau", "_b"), keys).select(
        *keys, "_level", "_tau", F.try_divide(F.col("_y") - _fit_value(names), along).alias("_t"),
        F.abs(along).alias("_weight"), along.alias("_d"),
    )
    left = left.withColumn("_share", F.when(F.col("_d") > 0, F.col("_tau")).otherwise(1 - F.col("_tau")))
    steps = weighted_quantile(left, [*keys, "_level"], "_t", "_weight", "_share", "_step")
    moved = fitted.join(steps, [*keys, "_level"], "left").withColumn("_step", F.coalesce("_step", F.lit(0.0)))
    spread = F.array(*(F.lit(SPREADS.get(f, 1.0)) for f in features))
    own = F.slice("_b", 1 + intercept, max(1, len(features))) if features else F.array().cast("array<double>")
    grown = F.lit(1.0) if intercept else 1 + F.col("_step")
    coefficients = F.zip_with(own, spread, lambda b, s: b * grown / s) if features else own
    final = moved.withColumn("coefficients", coefficients)
    centre = reduce(
        lambda total, i: total + F.col("coefficients")[i] * CENTRES.get(features[i], 0.0), range(len(features)), F.lit(0.0)
    )
    constant = F.col("_b")[0] + F.col("_step") - centre if intercept else F.lit(0.0)
    return materialise(
        final.select(
            *keys, F.col("_level").alias("level"), F.col("_n").alias("n"), constant.alias("intercept"), "coefficients",
            (F.col("_loss") / F.col("_n")).alias("loss"),
        )
    )


def fit_absolute(
    df: DataFrame,
    keys: Sequence[str] = SEGMENT,
    features: Sequence[str] = NUMERIC_FEATURES,
    intercept: bool = True,
    min_rows: int = 1,
) -> DataFrame:
    """Least absolute deviations of price per group: ``n``, ``intercept``, ``coefficients`` and ``mae`` on its own rows."""
    found = fit_levels(df, {"half": 0.5}, keys, features, intercept, min_rows)
    return found.select(*keys, "n", "intercept", "coefficients", (2 * F.col("loss")).alias("mae"))


def train_absolute(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = SEGMENT,
    shrinkage: float = EFFECT_SHRINKAGE,
) -> DataFrame:
    """A stored table like ``train_ridge``'s, by absolute error: a linear fit and a shrunken median of each region's rest."""
    keys, features = list(keys), list(features)
    models = materialise(fit_absolute(df, keys, features).drop("mae"))
    left = with_group_values(df.where(F.col("price").isNotNull()), models, keys, "inner", stored=True).select(
        *keys, "region", (F.col("price") - ridge_value(features)).alias("_rest")
    )
    medians = exact_quantiles(left, [*keys, "region"], "_rest", {"_median": 0.5}, count_as="_rows")
    effect = F.col("_median") * F.col("_rows") / (F.col("_rows") + shrinkage)
    effects = medians.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("region", effect.alias("effect")))).alias("region_effects")
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    joined = models.join(effects, keys, "left").withColumn("region_effects", F.coalesce("region_effects", none))
    return materialise(joined)


@dataclass(frozen=True)
class QuantileRegression:
    """Linear quantiles per segment, and leaf quantiles where a segment is too small for them."""

    lines: DataFrame
    features: tuple[str, ...]
    keys: tuple[str, ...]
    levels: Mapping[str, float]
    fallback: QuantileModel | None = None

    def attach(self, df: DataFrame) -> DataFrame:
        """Add q10..q90 in rising order: where lines cross, their values change places."""
        names = sorted(self.levels, key=self.levels.get)
        line = F.struct("intercept", "coefficients")
        wide = self.lines.groupBy(*self.keys).agg(
            *(F.max_by(F.when(F.col("level") == n, line), F.col("level") == n).alias(f"_line_{n}") for n in names)
        )
        base = self.fallback.attach(df) if self.fallback else df.withColumns({n: F.lit(None).cast("double") for n in names})
        out = with_group_values(base, wide, list(self.keys))
        values = []
        for n in names:
            total = F.col(f"_line_{n}.intercept")
            for i, f in enumerate(self.features):
                total = total + F.col(f"_line_{n}.coefficients")[i] * feature_value(f)
            values.append(total)
        out = out.withColumn("_lines", F.array_sort(F.array(*values)))
        chosen = {n: F.coalesce(F.col("_lines")[i], F.col(n)) for i, n in enumerate(names)}
        return out.withColumns(chosen).select(*df.columns, *names)


def train_quantile_regression(
    df: DataFrame,
    features: Sequence[str] = ("age", "odometer"),
    keys: Sequence[str] = SEGMENT,
    levels: Mapping[str, float] = QUANTILE_LEVELS,
    min_rows: int = 50,
    fallback: QuantileModel | None = None,
) -> QuantileRegression:
    """Quantile lines of every segment with ``min_rows`` rows; other segments use the ``fallback``."""
    lines = fit_levels(df, levels, keys, features, min_rows=min_rows)
    return QuantileRegression(lines, tuple(features), tuple(keys), dict(levels), fallback)
