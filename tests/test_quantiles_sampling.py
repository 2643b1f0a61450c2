import numpy as np
import pytest
from pyspark.sql import functions as F

from dealwright.operators.quantiles import exact_quantiles
from dealwright.operators.sampling import oos_split, smallest_by_hash

LEVELS = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.9, "g": 1.0}


def check(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", LEVELS, count_as="n").collect()}
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for name, level in LEVELS.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, level), rel=1e-12, abs=1e-12)


def test_cells_of_doubles_are_refined_until_they_are_small(spark, monkeypatch):
    from dealwright.operators import quantiles

    rng = np.random.default_rng(5)
    values = np.concatenate([rng.uniform(0.4, 0.6, 60_000), 0.5 + rng.normal(0, 1e-9, 20_000), np.full(9000, 0.55), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    sizes = []
    plain = quantiles._refined

    def watched(held, keys, holding):
        found = plain(held, keys, holding)
        sizes.append(max(r["count"] for r in found.groupBy("_cell").count().collect()))
        return found

    monkeypatch.setattr(quantiles, "CELL_VALUES", 500)
    monkeypatch.setattr(quantiles, "_refined", watched)
    got = exact_quantiles(df, [], "v", LEVELS).first()
    for name, level in LEVELS.items():
        assert got[name] == pytest.approx(np.quantile(values, level), rel=1e-12, abs=1e-12)
    assert sizes and max(sizes) <= 500


def test_only_values_of_wanted_cells_are_grouped(spark, monkeypatch):
    from dealwright.operators import quantiles

    values = np.random.default_rng(6).permutation(40_000)
    df = spark.createDataFrame([(int(v), float(v % 7)) for v in values], "v long, w double")
    seen = []
    plain = quantiles._refined

    def watched(held, keys, holding):
        plan = held._jdf.queryExecution().optimizedPlan().toString()
        found = plain(held, keys, holding)
        seen.append((plan.index("Join ") > plan.index("Aggregate "), found.count()))
        return found

    monkeypatch.setattr(quantiles, "CELL_VALUES", 300)
    monkeypatch.setattr(quantiles, "_refined", watched)
    got = exact_quantiles(df, [], "v", {"a": 0.25, "b": 0.5}).first()
    assert (got.a, got.b) == (9999.75, 19999.5)
    order = np.arange(40_000)
    upto = np.cumsum(order % 7)
    half = quantiles.weighted_quantile(df, [], "v", "w").first()["quantile"]
    assert half == order[np.argmax(upto >= upto[-1] / 2)]
    # whole numbers are cut like doubles, and the join with wanted cells comes before the grouping by value
    assert len(seen) == 2 and all(before and n < 1000 for before, n in seen)


def test_worked_example(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "v int")
    r = exact_quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert (r.a, r.b, r.c) == (1.75, 3.0, 5.25)


def test_against_numpy_with_hot_group_ties_and_signs(spark):
    rng = np.random.default_rng(1)
    check(
        spark,
        {
            "hot": np.round(rng.lognormal(10, 1, 20000)),
            "one value": np.full(500, 7.0),
            "mixed": rng.normal(0, 3, 301),
            "tiny": rng.uniform(0, 1e-6, 40),
            "huge": rng.uniform(-1e300, 1e300, 30),
            "single": [5.0],
        },
    )


def test_nulls_and_nan_are_ignored(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None)], "k string, v double")
    rows = exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert [(r.k, r.m) for r in rows] == [("a", 2.0)]


@pytest.mark.parametrize("n, expected", [(1, 0), (4, 2), (5, 2), (6, 2), (1000, 400), (1001, 400)])
def test_oos_count(spark, n, expected):
    df = spark.range(n).select(F.lit("m").alias("make"), F.lit("x").alias("model"), F.col("id").alias("listing_id"))
    flags = oos_split(df)
    assert flags.count() == n and flags.where("is_oos").count() == expected


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).cast("string").alias("make"), F.lit("x").alias("model"), F.col("id").alias("listing_id")
    )
    first = {r.listing_id for r in oos_split(df.repartition(1)).where("is_oos").collect()}
    second = {r.listing_id for r in oos_split(df.repartition(13)).where("is_oos").collect()}
    assert first == second


def test_smallest_by_hash_takes_all_of_a_small_group(spark):
    df = spark.range(10).select(F.lit("m").alias("make"), F.col("id").alias("listing_id"))
    out = smallest_by_hash(df, ["make"], "listing_id", lambda n: F.least(n, F.lit(100)).cast("bigint"), 1, "picked")
    assert out.where("picked").count() == 10
