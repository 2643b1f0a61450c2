import numpy as np
import pytest
from pyspark.sql import functions as F

from dealwright.operators import diagnose, market

SEG = "make string, model string, "


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = [("A", f"m{i % 2}", f"L{i}", int(rng.lognormal(9, 0.5)), int(rng.integers(1, 20)), float(rng.integers(0, 60) * 1000),
             "NS"[i % 2 == 0]) for i in range(500)]
    return spark.createDataFrame(data, SEG + "listing_id string, price long, age int, odometer double, region string").cache()


def test_summary(rows):
    pdf = rows.toPandas()
    for r in market.market_summary(rows).collect():
        part = pdf[pdf.model == r.model]
        assert (r.n_listings, r.min_price, r.max_price) == (len(part), part.price.min(), part.price.max())
        assert r.median_price == part.price.median() and r.avg_age == pytest.approx(part.age.mean())


def test_histogram_counts_every_row(rows):
    bins = market.price_histogram(rows).toPandas()
    assert bins.n.sum() == 500 and bins.bin.between(1, 40).all() and bins.groupby("model").bin.max().eq(40).all()


def test_box_whiskers(rows):
    pdf = rows.toPandas()
    for r in market.price_by_region_box(rows).collect():
        p = pdf[(pdf.model == r.model) & (pdf.region == r.region)].price
        q1, q3 = p.quantile([0.25, 0.75])
        inside = p[(p >= q1 - 1.5 * (q3 - q1)) & (p <= q3 + 1.5 * (q3 - q1))]
        assert (r.whisker_low, r.whisker_high, r.n_beyond) == (inside.min(), inside.max(), len(p) - len(inside))


def test_smoother_reproduces_a_straight_line(spark):
    df = spark.createDataFrame([("A", "x", float(i), 3.0 * i + 7) for i in range(200)], SEG + "o double, y double")
    for r in market.smooth_trend(df, "o", "y").collect():
        assert r.smoothed == pytest.approx(3 * r.grid_x + 7)


def test_category_counts(rows):
    counts = market.category_counts(rows, ("region", "absent")).collect()
    assert sum(r.n for r in counts) == 500 and {r.category for r in counts} == {"region"}


def test_sample_counts(rows):
    got = {(r.make, r.model): r.n for r in market.sample_counts(rows).collect()}
    assert got[None, None] == 500 and got["A", None] == 500 and got["A", "m0"] == 250


def test_metrics(rows):
    scored = diagnose.residuals(rows.withColumn("prediction_label", F.col("price") * 0.9 + 500.0))
    pdf = scored.toPandas()
    for r in diagnose.evaluate(scored).collect():
        part = pdf[pdf.model == r.model]
        rest = part.price - part.prediction_label
        assert r.mae == pytest.approx(rest.abs().mean()) and r.rmse == pytest.approx(np.sqrt((rest**2).mean()))
        assert r.median_ae == pytest.approx(rest.abs().median()) and r.pearson == pytest.approx(1.0)
        assert r.r2 == pytest.approx(1 - (rest**2).sum() / ((part.price - part.price.mean()) ** 2).sum())


def test_leaderboard_puts_the_better_model_first(rows):
    scored = rows.withColumns({"good": F.col("price") + 1.0, "bad": F.lit(0.0)})
    board = diagnose.leaderboard(scored, {"good": "good", "bad": "bad"})
    assert {r.best_model for r in diagnose.best_model(board).collect()} == {"good"}


@pytest.mark.parametrize("block", [10, 10_000])
def test_permutation_moves_every_value_once(rows, monkeypatch, block):
    monkeypatch.setattr(diagnose, "RANGE_ROWS", block)
    moved = diagnose.permuted(rows, ["age", "listing_id"], repeats=2).toPandas()
    assert len(moved) == 1000
    for _, part in moved.groupby(["model", "repeat"]):
        assert sorted(part.other_listing_id) == sorted(part.listing_id)
        assert (part.other_listing_id != part.listing_id).mean() > 0.9


def test_permutation_does_not_depend_on_its_ranges(rows, monkeypatch):
    def pairs():
        moved = diagnose.permuted(rows, ["listing_id"], repeats=2)
        return sorted(tuple(r) for r in moved.select("repeat", "listing_id", "other_listing_id").collect())

    whole = pairs()
    monkeypatch.setattr(diagnose, "RANGE_ROWS", 7)
    assert pairs() == whole


def test_importance_is_zero_for_an_unused_feature(rows):
    scored = rows.withColumn("prediction_label", F.col("price").cast("double"))
    predict = {"age": F.col("prediction_label"), "price": F.col("other_price").cast("double")}
    got = {(r.model, r.feature): r.importance for r in diagnose.permutation_importance(scored, ["age", "price"], predict).collect()}
    assert got["m0", "age"] == 0 and got["m0", "price"] > 100


def test_diagonal(rows):
    scored = diagnose.residuals(rows.withColumn("prediction_label", F.lit(1.0)))
    r = diagnose.residual_vs_predicted(scored).first()
    assert r.xy_min == 1.0 and r.xy_max > 1000


def test_permuted_rows_move_without_digest_and_model(spark):
    """What crosses the network three times over is a listing's own fields; digests and segment models are added after."""
    from dealwright.plans import all_queries

    df = all_queries.QUERIES["permutation_importance"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_COL") :].split("\n")[1]
    assert "listing_id" in below and "_order" not in below and "s_region_effects" not in below
