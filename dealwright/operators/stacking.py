"""The cross-segment model bagged over folds, and candidates blended by weights from their out-of-fold predictions.

One pass over the rows adds up counts, sums and products per (make, model, fold). Whatever a fold leaves to the others is
total minus fold, so the models that have not seen a fold, for all folds together, follow from that small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealwright.config import SEGMENT
from dealwright.functions.hashing import digest_number, seeded_digest
from dealwright.operators.joins import with_group_values
from dealwright.operators.train import EFFECT_SHRINKAGE, GeneralModel
from dealwright.session import materialise

FOLDS = 5
_MOMENTS = ("n", "y", "a", "o", "aa", "oo", "ao", "ay", "oy")


def fold_of(id_column: str, folds: int = FOLDS, seed: int = 42) -> Column:
    """The fold of a row, by a seeded digest of its id."""
    return F.pmod(digest_number(seeded_digest(seed, F.col(id_column))), F.lit(folds)).cast("int")


def _complete(df: DataFrame) -> DataFrame:
    return df.where(F.col("price").isNotNull() & F.col("age").isNotNull() & F.col("odometer").isNotNull())


def _sums(df: DataFrame) -> DataFrame:
    y, a, o = (F.col(c).cast("double") for c in ("price", "age", "odometer"))
    parts = (F.lit(1), y, a, o, a * a, o * o, a * o, a * y, o * y)
    sums = [F.sum(p).alias(n) for n, p in zip(_MOMENTS, parts, strict=True)]
    return _complete(df).groupBy(*SEGMENT, "fold").agg(*sums)


def _without(sums: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """Sums per (keys, left_out) over all folds but the one left out; groups that are in that fold alone have none."""
    own = sums.groupBy(*keys, "fold").agg(*(F.sum(m).alias(m) for m in _MOMENTS))
    each = own.withColumn("left_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("left_out <> fold")
    return each.groupBy(*keys, "left_out").agg(*(F.sum(m).alias(m) for m in _MOMENTS))


def _lines(pooled: DataFrame) -> DataFrame:
    """(left_out, n, intercept, b_age, b_odometer, mean) from pooled sums; a feature that says nothing new has no slope."""
    n = F.col("n")
    var = {c: F.col(c[0] + c[1]) / n - F.col(c[0]) * F.col(c[1]) / n / n for c in ("aa", "oo", "ao", "ay", "oy")}
    det = var["aa"] * var["oo"] - var["ao"] * var["ao"]
    both = det > 1e-9 * var["aa"] * var["oo"]
    only_a = ~both & (var["oo"] <= 0) & (var["aa"] > 0)
    b_a = F.when(both, (var["ay"] * var["oo"] - var["oy"] * var["ao"]) / det).when(only_a, var["ay"] / var["aa"])
    b_o = F.when(both, (var["oy"] * var["aa"] - var["ay"] * var["ao"]) / det).when(var["oo"] > 0, var["oy"] / var["oo"])
    found = pooled.select(
        "left_out", "n", F.coalesce(b_a, F.lit(0.0)).alias("b_age"), F.coalesce(b_o, F.lit(0.0)).alias("b_odometer"),
        (F.col("y") / n).alias("mean"), (F.col("a") / n).alias("_a"), (F.col("o") / n).alias("_o"),
    )
    level = F.col("mean") - F.col("b_age") * F.col("_a") - F.col("b_odometer") * F.col("_o")
    return found.select("left_out", "n", level.alias("intercept"), "b_age", "b_odometer", "mean")


@dataclass(frozen=True)
class FoldedGeneral:
    """The models that have not seen a fold: ``lines`` a row per fold, effects of makes and of models a row per fold.

    Each fold has two candidates, the pooled line and the plain mean, both with shrunken effects of make and model.
    """

    lines: DataFrame
    makes: DataFrame
    models: DataFrame
    folds: int
    seed: int

    def out_of_fold(self, df: DataFrame, id_column: str = "listing_id") -> DataFrame:
        """``df`` with ``fold``, ``by_line`` and ``by_mean``: what the models say that have not seen the row's fold."""
        rows = df.withColumn("fold", fold_of(id_column, self.folds, self.seed))
        for values, keys in ((self.lines, []), (self.makes, ["make"]), (self.models, list(SEGMENT))):
            rows = with_group_values(rows, values.withColumnRenamed("left_out", "fold"), [*keys, "fold"], stored=True)
        line = F.col("intercept") + F.col("b_age") * F.col("age") + F.col("b_odometer") * F.col("odometer")
        effects = {c: F.coalesce(F.col(f"make_{c}"), F.lit(0.0)) + F.coalesce(F.col(f"model_{c}"), F.lit(0.0)) for c in ("line", "mean")}
        return rows.withColumns({"by_line": line + effects["line"], "by_mean": F.col("mean") + effects["mean"]}).select(
            *df.columns, "fold", "by_line", "by_mean"
        )

    def blended(self, line: float, mean: float) -> GeneralModel:
        """One model: the mean over folds of both candidates, blended by the weights. It is a line with effects again."""
        whole = self.lines.agg(*(F.avg(c).alias(c) for c in ("intercept", "b_age", "b_odometer", "mean")), F.max("n").alias("n")).first()

        def effect(values: DataFrame, keys: Sequence[str], name: str, as_: str) -> DataFrame:
            both = F.sum(F.col(f"{name}_line") * line + F.col(f"{name}_mean") * mean) / self.folds
            return materialise(values.groupBy(*keys).agg(both.alias(as_)))

        return GeneralModel(
            whole["intercept"] * line + whole["mean"] * mean,
            whole["b_age"] * line,
            whole["b_odometer"] * line,
            whole["n"],
            effect(self.makes, ["make"], "make", "general_make_effect"),
            effect(self.models, SEGMENT, "model", "general_model_effect"),
        )


def train_general_folds(
    df: DataFrame, folds: int = FOLDS, seed: int = 42, shrinkage: float = EFFECT_SHRINKAGE, id_column: str = "listing_id"
) -> FoldedGeneral:
    """Both candidates fitted without each fold. A make or model that only one fold has gets no effect for that fold."""
    sums = materialise(_sums(df.withColumn("fold", fold_of(id_column, folds, seed))))
    lines = materialise(_lines(_without(sums, [], folds)))
    line_rest = F.col("y") - F.col("n") * F.col("intercept") - F.col("b_age") * F.col("a") - F.col("b_odometer") * F.col("o")
    mean_rest = F.col("y") - F.col("n") * F.col("mean")

    def rests(keys: Sequence[str]) -> DataFrame:
        rows = with_group_values(_without(sums, keys, folds), lines.drop("n"), ["left_out"], "inner", stored=True)
        return rows.select(*keys, "left_out", "n", line_rest.alias("_line"), mean_rest.alias("_mean"))

    def shrunk(total: Column) -> Column:
        return total / (F.col("n") + shrinkage)

    makes = rests(["make"])
    makes = materialise(makes.select("make", "left_out", *(shrunk(F.col(f"_{c}")).alias(f"make_{c}") for c in ("line", "mean"))))
    models = with_group_values(rests(SEGMENT), makes, ["make", "left_out"], "inner", stored=True)
    left = [shrunk(F.col(f"_{c}") - F.col("n") * F.col(f"make_{c}")).alias(f"model_{c}") for c in ("line", "mean")]
    return FoldedGeneral(lines, makes, materialise(models.select(*SEGMENT, "left_out", *left)), folds, seed)


def blend_weights(df: DataFrame, candidates: Sequence[str], target: str = "price") -> dict[str, float]:
    """Weights, none negative and 1 together, with which the candidates' columns come closest to the target in squares.

    All rows are added up to one matrix of products of the candidates' errors; only that comes to the driver. Rows on which
    a candidate is silent are left out; without any rows the weights are equal.
    """
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [target, *candidates]]))
    errors = [F.col(target) - F.col(c) for c in candidates]
    size = len(candidates)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.agg(*(F.sum(errors[i] * errors[j]).alias(f"_{i}_{j}") for i, j in pairs)).first()
    if sums[0] is None:
        return dict.fromkeys(candidates, 1 / size)
    gram = np.zeros((size, size))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"_{i}_{j}"]
    best, weights = np.inf, np.full(size, 1 / size)
    for k in range(1, size + 1):  # the few candidates allow to try which of them count
        for some in combinations(range(size), k):
            part = gram[np.ix_(some, some)]
            inverse = np.linalg.pinv(part).sum(axis=1) if k > 1 else np.ones(1)
            if inverse.sum() == 0 or (inverse / inverse.sum() < -1e-12).any():
                continue
            own = inverse / inverse.sum()
            loss = own @ part @ own
            if loss < best * (1 - 1e-12):
                best, weights = loss, np.zeros(size)
                weights[list(some)] = own
    return dict(zip(candidates, map(float, weights), strict=True))


def train_general_bag(
    df: DataFrame, folds: int = FOLDS, seed: int = 42, shrinkage: float = EFFECT_SHRINKAGE, id_column: str = "listing_id"
) -> GeneralModel:
    """The general model bagged over folds: its two candidates blended by how well each does on rows it has not seen."""
    folded = train_general_folds(df, folds, seed, shrinkage, id_column)
    unseen = folded.out_of_fold(_complete(df).select(id_column, *SEGMENT, "age", "odometer", "price"), id_column)
    weights = blend_weights(unseen, ["by_line", "by_mean"])
    return folded.blended(weights["by_line"], weights["by_mean"])
