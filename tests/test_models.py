import numpy as np
import pytest
from pyspark.sql import functions as F

from dealwright.config import DealSearch, OutlierSettings, TrainingSettings
from dealwright.operators import outliers, train, value
from dealwright.plans import deal_search, valuation
from dealwright.session import materialise

FEATURES = ["engine_size", "odometer", "year", "is_new", "age", "km_per_year"]


def make_rows(n=400, segments=2, seed=0, noise=300.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        year = int(rng.integers(2005, 2026))
        age = 2026 - year
        odometer = float(rng.integers(1, 30) * 5000)
        region = ["North", "South"][int(rng.integers(0, 2))]
        engine = float(rng.integers(10, 40) * 100)
        price = int(30000 - 900 * age - 0.05 * odometer + (1500 if region == "North" else 0) + rng.normal(0, noise))
        rows.append((f"L{i}", "Make", f"M{i % segments}", region, engine, odometer, year, int(rng.integers(0, 2)), price, age,
                     odometer / max(age, 1)))
    return rows


SCHEMA = ("listing_id string, make string, model string, region string, engine_size double, odometer double, year int,"
          "is_new int, price long, age int, km_per_year double")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).cache()


def closed_form(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    xc, yc = x - mx, y - my
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return b, my - mx @ b


def test_ridge_is_the_closed_form(rows):
    pdf = rows.toPandas()
    models = {r.model: r for r in train.fit_ridge(rows, features=FEATURES).collect()}
    for model, part in pdf.groupby("model"):
        b, b0 = closed_form(part[FEATURES].to_numpy(float), part["price"].to_numpy(float), 1.0)
        assert np.allclose(models[model].coefficients, b, rtol=1e-6, atol=1e-8)
        assert models[model].intercept == pytest.approx(b0, rel=1e-6)


def test_bag_is_the_mean_of_leave_one_fold_out_fits(rows):
    from dealwright.functions.hashing import digest_number, seeded_digest

    fold = F.pmod(digest_number(seeded_digest(42, F.col("listing_id"))), F.lit(5)).alias("fold")
    pdf = rows.select("*", fold).toPandas()
    got = {r.model: r for r in train.bag_ridge(rows, features=FEATURES).collect()}
    for model, part in pdf.groupby("model"):
        fits, errors = [], []
        for k in range(5):
            rest, out = part[part.fold != k], part[part.fold == k]
            b, b0 = closed_form(rest[FEATURES].to_numpy(float), rest["price"].to_numpy(float), 1.0)
            fits.append((b, b0))
            errors.extend((out["price"] - out[FEATURES].to_numpy(float) @ b - b0) ** 2)
        assert np.allclose(got[model].coefficients, np.mean([f[0] for f in fits], axis=0), rtol=1e-5, atol=1e-8)
        assert got[model].rmse == pytest.approx(np.sqrt(np.mean(errors)), rel=1e-6)


def test_line_matches_least_squares_and_falls_back_when_collinear(spark, rows):
    pdf = rows.toPandas()
    for r in train.fit_lines(rows).collect():
        part = pdf[pdf.model == r.model]
        a = np.column_stack([np.ones(len(part)), part["age"], part["odometer"]])
        b = np.linalg.lstsq(a, part["price"], rcond=None)[0]
        assert np.allclose([r.intercept, r.b_age, r.b_odometer], b, rtol=1e-6)
    flat = spark.createDataFrame([("A", "B", p, 3, o) for p, o in ((10, 1.0), (20, 2.0), (30, 3.0))],
                                 "make string, model string, price long, age int, odometer double")
    r = train.fit_lines(flat).first()
    assert (r.b_age, r.b_odometer) == (0.0, pytest.approx(10.0))


def test_tail_gate(spark):
    def segment(n):
        prices = list(range(n))
        return spark.createDataFrame(
            [(f"L{i}", "A", "B", "N", 1.0, float(i), 2000, 0, p, 3, 1.0) for i, p in enumerate(prices)], SCHEMA
        )

    few = train.train_tails(segment(36)).first()
    enough = train.train_tails(segment(40)).first()
    assert (few.low_n, few.low, few.high_n, few.high) == (9, None, 9, None)
    assert enough.low_n == 10 and enough.low is not None and enough.high_n == 10 and enough.high is not None


def test_quantiles_do_not_cross_and_thin_leaves_fall_back(spark, rows):
    banded = train.add_bands(rows)
    model = train.train_quantiles(banded, min_leaf_rows=10)
    out = model.attach(banded)
    assert out.count() == rows.count()
    assert out.where("q10 > q25 OR q25 > q50 OR q50 > q75 OR q75 > q90 OR q10 IS NULL").count() == 0
    stranger = banded.limit(1).withColumn("model", F.lit("never seen"))
    assert model.attach(stranger).first().q50 == pytest.approx(model.overall["q50"])


def all_models(rows, **settings):
    return valuation.train_models(rows, TrainingSettings(**settings), OutlierSettings(method="robust"))


def test_valuation_of_specs(rows):
    out = valuation.value_specs(rows, all_models(rows), "North").toPandas().set_index("listing_id")
    truth = rows.toPandas().set_index("listing_id")["price"]
    assert (out["estimate"] - truth).abs().mean() < 1500
    south = out[out.region == "South"]
    assert south["regional_diff"].between(800, 2200).all()
    assert out[out.region == "North"]["comparison_value"].isna().all()
    assert out["reliable"].all() and (out["depreciation_10k"] > out["depreciation_0k"]).all()
    assert out["ci_80"].map(lambda c: c["lo"]).le(out["ci_50"].map(lambda c: c["lo"])).all()


def test_unknown_segment_uses_the_general_model_or_says_why(spark, rows):
    stranger = rows.limit(1).withColumn("model", F.lit("never seen"))
    models = all_models(rows)
    known = value.predict_blended(stranger, models.specific, models.general).first()
    assert known.specific is None and known.prediction_label == known.general and known.reason is None
    none = value.predict_blended(stranger, models.specific, None).first()
    assert none.prediction_label is None and none.reason == "no model available"


def test_future_features(spark):
    df = spark.createDataFrame([(2016, 100000.0, 10, 10000.0)], "year int, odometer double, age int, km_per_year double")
    driven = value.future_features(df, distance=10000).first()
    parked = value.future_features(df).first()
    assert tuple(driven) == (2015, 110000.0, 11, 10000.0)
    assert parked.km_per_year == pytest.approx(9090.909, abs=1e-3)


def test_deals_are_found_and_ranked(spark):
    cheap = ("deal", "Make", "M0", "North", 2000.0, 50000.0, 2016, 0, 9000, 10, 5000.0)
    rows = spark.createDataFrame(make_rows(noise=50.0) + [cheap], SCHEMA)
    found = deal_search.search_deals(rows, DealSearch(comparison_region="South"), OutlierSettings(method="none")).collect()
    assert [r.listing_id for r in found] == ["deal"]
    assert 40 <= found[0].discount_pct <= 80 and found[0].regional_diff < 0
    assert deal_search.search_deals(rows, DealSearch(segments=(("Make", "M1"),)), OutlierSettings(method="none")).count() == 0


@pytest.mark.parametrize("discount, kept", [(40.0, True), (80.0, True), (39.99, False), (80.01, False)])
def test_percent_bounds_are_inclusive(spark, discount, kept):
    from dealwright.operators import deals

    df = spark.createDataFrame([(100.0, discount)], "prediction_label double, discount_pct double")
    assert (deals.undervalued_pct(df).count() == 1) is kept


@pytest.mark.parametrize("price, kept", [(15000, False), (14999, True)])
def test_dollar_bounds_are_strict(spark, price, kept):
    from dealwright.operators import deals

    df = spark.createDataFrame([(20000.0, price)], "prediction_label double, price int")
    assert (deals.undervalued_abs(df).count() == 1) is kept


def test_forest_flags_the_share_and_the_planted_row(spark):
    odd = ("odd", "Make", "M0", "North", 9000.0, 900000.0, 1950, 1, 990000, 76, 12000.0)
    rows = spark.createDataFrame(make_rows(600) + [odd], SCHEMA)
    flagged = outliers.flag_isolation_forest(rows).toPandas().set_index("listing_id")
    assert len(flagged) == 601 and flagged.loc["odd", "is_outlier"]
    share = flagged.groupby("model")["is_outlier"].mean()
    assert (share <= 0.05 + 0.01).all() and (share > 0.02).all()


def test_forest_scores_match_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    drawn = np.concatenate([rng.permutation(500)[:64] for _ in range(20)])
    feature, threshold, path = outliers.grow_trees(x[drawn], np.repeat(np.arange(20), 64), 20, 64, 7)
    got = outliers.path_scores(x, feature, threshold, path, 64)
    for r in range(0, 500, 50):
        depths = []
        for t in range(20):
            node = 0
            while feature[t, node] >= 0:
                node = 2 * node + 1 + int(x[r, feature[t, node]] > threshold[t, node])
            depths.append(path[t, node])
        expected = 2 ** (-np.mean(depths) / outliers.average_path(np.array(64)))
        assert got[r] == pytest.approx(float(expected), rel=1e-6)


def test_scoring_in_parts_gives_the_same_scores(rows, monkeypatch):
    x = F.array(*[F.col(c).cast("double") for c in ("odometer", "price", "age")])
    numeric = rows.select("make", "model", "listing_id", "region", x.alias("_x"))
    sizes = materialise(numeric.groupBy("make", "model").agg(F.count(F.lit(1)).alias("_rows")))
    forests = materialise(outliers.fit_forests(numeric, sizes))
    whole = {r.listing_id: r.score for r in outliers.score_forest(numeric, forests, sizes).collect()}
    monkeypatch.setattr(outliers, "ROWS_PER_SCORING_GROUP", 25)
    parts = {r.listing_id: (r.score, r.region) for r in outliers.score_forest(numeric, forests, sizes).collect()}
    assert whole == {k: v[0] for k, v in parts.items()} and len(whole) == 400 and {v[1] for v in parts.values()} >= {"North"}


def test_every_tree_draws_about_its_rows_by_one_rule(spark):
    rows = spark.range(40_000).select(F.lit("A").alias("make"), F.when(F.col("id") < 39_900, "big").otherwise("small").alias("model"),
                                      F.col("id").cast("string").alias("listing_id"))
    sizes = materialise(rows.groupBy("make", "model").agg(F.count(F.lit(1)).alias("_rows")))
    drawn = outliers.drawn_rows(rows, sizes, OutlierSettings(), ["make", "model"])
    counts = {(r.model, r.tree): r["count"] for r in drawn.groupBy("model", "tree").count().collect()}
    assert all(counts["small", t] == 100 for t in range(100))
    assert all(190 < counts["big", t] < 330 for t in range(100)) and 250 < sum(counts["big", t] for t in range(100)) / 100 < 262


@pytest.mark.parametrize("method", ["robust", "isolation_forest"])
def test_listings_without_make_or_model_survive_outlier_removal(spark, method):
    rows = spark.createDataFrame(make_rows(), SCHEMA)
    some = rows.withColumn("make", F.when(F.col("model") == "M0", F.col("make")))
    kept = outliers.remove_outliers(some, OutlierSettings(method=method))
    assert kept.where("make IS NULL").count() == some.where("make IS NULL").count() > 0
    assert 0 < kept.where("make IS NOT NULL").count() < some.where("make IS NOT NULL").count() + 1


def test_general_model_counts_a_make_once(spark):
    rows = [("A", "same", 20000), ("B", "same", 10000)]
    df = spark.createDataFrame([(m, n, "North", i % 7, float(i % 11), p) for m, n, p in rows for i in range(300)],
                               "make string, model string, region string, age int, odometer double, price long")
    model = train.train_general(df)
    got = {r.make: r.p for r in model.attach(df).select("make", model.value().alias("p")).groupBy("make").agg(F.avg("p").alias("p")).collect()}
    assert got["A"] == pytest.approx(20000, rel=0.01) and got["B"] == pytest.approx(10000, rel=0.01)
    new = model.attach(df.limit(1).withColumn("model", F.lit("unseen"))).select(model.value().alias("p")).first().p
    assert new == pytest.approx(got[df.first().make], rel=0.05)


def test_drawing_rows_runs_no_lambda(spark):
    """Trees are drawn by a compiled condition: the same hash of seed, tree and listing as one by one."""
    rows = spark.range(3000).selectExpr("'A' AS make", "IF(id < 2990, 'big', 'small') AS model", "concat('L', id) AS listing_id")
    sizes = materialise(rows.groupBy("make", "model").agg(F.count(F.lit(1)).alias("_rows")))
    settings = OutlierSettings(trees=5)
    drawn = outliers.drawn_rows(rows, sizes, settings, ["make", "model"])
    assert "lambda" not in drawn._jdf.queryExecution().executedPlan().toString()
    low = int(settings.rows_per_tree / 2990 * float(1 << 62))
    pairs = rows.crossJoin(spark.range(5).selectExpr("int(id) AS tree"))
    plain = pairs.where(f"model = 'small' OR shiftrightunsigned(xxhash64({settings.seed}, tree, listing_id), 2) < {low}")
    assert sorted(drawn.select("listing_id", "tree").collect()) == sorted(plain.select("listing_id", "tree").collect())


def test_segments_are_judged_before_outliers_go(spark):
    rows = make_rows(40)[:19] + [("odd", "Make", "M0", "North", 2000.0, 50000.0, 2016, 0, 990000, 10, 5000.0)]
    df = spark.createDataFrame([(*r[:2], "M0", *r[3:]) for r in rows], SCHEMA)
    assert df.count() == 20
    search = DealSearch(min_discount_pct=-1000, max_discount_pct=1000)
    found = deal_search.search_deals(df, search, OutlierSettings(method="robust"))
    assert 15 <= found.count() < 20  # a model although fewer than 20 are left


@pytest.mark.parametrize("model", ["ridge", "bag"])
def test_ridge_prices_follow_engine_and_fuel(spark, model):
    rng = np.random.default_rng(8)
    listed = []
    for i in range(400):
        engine, diesel, km, age = float(rng.integers(1000, 4000)), bool(i % 2), float(rng.integers(0, 200000)), int(rng.integers(1, 20))
        price = int(8000 + 3 * engine + 2500 * diesel - 0.02 * km - 300 * age)
        listed.append((f"L{i}", "A", "B", "North", engine, km, 2026 - age, 0, price, age, km / age, "Diesel" if diesel else "Petrol", "Manual", 1, 0))
    df = spark.createDataFrame(listed, SCHEMA + ", fuel string, transmission string, is_4wd int, is_dealer int")
    training = TrainingSettings(model=model)
    models = valuation.train_models(df, training, OutlierSettings(method="none"))
    base = df.limit(1).withColumns({"engine_size": F.lit(2000.0), "fuel": F.lit("Petrol"), "listing_id": F.lit("a")})
    other = base.withColumns({"engine_size": F.lit(3000.0), "listing_id": F.lit("b")}).unionByName(
        base.withColumns({"fuel": F.lit("Diesel"), "listing_id": F.lit("c")}))
    got = {r.listing_id: r.specific for r in valuation.value_specs(base.unionByName(other), models, "South").collect()}
    assert got["b"] - got["a"] == pytest.approx(3000, rel=0.02) and got["c"] - got["a"] == pytest.approx(2500, rel=0.05)
    assert len(deal_search.search_deals(df, DealSearch(), OutlierSettings(method="robust"), training).columns) > 5


def test_models_are_the_same_without_broadcasts_and_with_a_hot_segment(spark):
    listed = make_rows(100)
    rows = spark.createDataFrame(listed + [(f"h{i}", "Make", "M0", *r[3:]) for i, r in enumerate(listed)], SCHEMA)

    def both():
        search = DealSearch(min_discount_pct=-50, max_discount_pct=80, comparison_region="South")
        found = deal_search.search_deals(rows, search, OutlierSettings(method="robust"))
        valued = valuation.value_specs(rows, all_models(rows), "North")
        return [sorted(str(tuple(r)) for r in d.select("listing_id", F.round(c, 4)).collect())
                for d, c in ((found, "discount_pct"), (valued, "estimate"))]

    copied = both()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = both()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert copied == shuffled and all(copied)


def test_category_codes(spark):
    df = spark.createDataFrame([("A", "B", "b"), ("A", "B", "a"), ("A", "B", None)], "make string, model string, c string")
    assert [r.c for r in outliers.category_codes(df, ["c"]).collect()] == [1.0, 0.0, -1.0]


def test_outlier_switch(rows):
    assert outliers.remove_outliers(rows, OutlierSettings(method="none")).count() == 400
    assert outliers.flag_outliers(rows, OutlierSettings(method="robust")).columns[-1] == "is_outlier"
    with pytest.raises(ValueError):
        outliers.flag_outliers(rows, OutlierSettings(method="other"))


def test_tree_fits_deal_rows_by_their_number(spark, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor

    from dealwright.operators import ensemble

    sizes = []
    for kind in (GBTRegressor, DecisionTreeRegressor):
        def fit(self, dataset, params=None, own=kind.fit):
            sizes.append(sorted(r["count"] for r in dataset.groupBy(F.spark_partition_id()).count().collect()))
            return own(self, dataset, params)

        monkeypatch.setattr(kind, "fit", fit)
    monkeypatch.setattr(ensemble, "TASK_ROWS", 50, raising=False)
    names = ("engine_size", "odometer", "year", "age", "km_per_year")
    rows = [(f"m{i % 3}", f"x{i % 7}", *(float(i * k % 97) for k in range(1, 6)), 1000 + i % 113) for i in range(1000)]
    df = spark.createDataFrame(rows, ["make", "model", *names, "price"]).coalesce(1)
    model = ensemble.train_general_trees(df, ("make", "model"), names, rounds=2, depth=2)
    leaves = ensemble.fit_leaves(df, names, depth=2)
    assert [len(s) for s in sizes] == [20, 20] and all(s[-1] <= 60 for s in sizes)
    assert ensemble.predict_general_trees(df, model, names).where("general IS NOT NULL").count() == 1000
    assert ensemble.add_leaf(df, leaves, names).select("leaf").distinct().count() > 1


def test_forest_rows_move_once(spark, monkeypatch):
    """Numbers are not copied into an array beside themselves; scores are those of the array, whatever the columns' types."""
    rows = spark.createDataFrame(make_rows(), SCHEMA).withColumns({
        "is_new": F.col("price") % 2 == 0, "cylinders": F.when(F.col("price") % 3 > 0, "4"),
        "fee": (F.col("price") / 7).cast("decimal(12,3)"), "age": F.when(F.col("price") % 5 > 0, F.col("age").cast("short")),
    })
    calls, plain = [], outliers.score_forest

    def spied(df, forests, sizes, keys, numbers, drop):
        assert "_x" not in df.columns and len(df.columns) < len(rows.columns) + 4
        calls.append((df, numbers))
        told = plain(df, forests, sizes, keys, numbers, drop)
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers])
        by_array = {r.listing_id: r.score for r in plain(df.withColumn("_x", x), forests, sizes, keys).collect()}
        assert by_array == {r.listing_id: r.score for r in told.collect()} and len(by_array) == rows.count()
        assert told.columns == [*rows.columns, "score"]
        return told

    monkeypatch.setattr(outliers, "score_forest", spied)
    flagged = outliers.flag_isolation_forest(rows)
    assert flagged.columns == [*rows.columns, "is_outlier"] and len(calls) == 1
    assert set(calls[0][1]) >= {"is_new", "age", "price", "_cylinders_number", "_fee_number", "_region_number"}
