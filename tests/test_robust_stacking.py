"""Fits by absolute error and quantile, folds and blends, density clusters, local regression: against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealwright.config import QUANTILE_LEVELS, OutlierSettings, TrainingSettings
from dealwright.operators import density, labels, lowess, quantiles, robust, stacking, train
from dealwright.plans import deal_search, valuation

KEYS = ("make", "model")


def listings_frame(spark, rng, sizes, price):
    rows = []
    for s, n in enumerate(sizes):
        for _ in range(n):
            age, km = int(rng.integers(1, 15)), float(rng.integers(1, 40)) * 5000
            rows.append((len(rows), "M", f"s{s}", "north" if rng.random() < 0.5 else "south", age, km, price(s, age, km, rng)))
    return spark.createDataFrame(rows, "listing_id long, make string, model string, region string, age int, odometer double, price double"), rows


def pinball(rest, tau):
    return np.where(rest > 0, tau * rest, (tau - 1) * rest).sum()


def test_weighted_quantiles_against_a_sort(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(np.round(v, 2)), float(w), 0.3) for g, v, w in zip(rng.integers(0, 3, 900), rng.normal(0, 50, 900), rng.random(900) * 3)]
    rows += [(0, None, 1.0, 0.5), (1, 5.0, 0.0, 0.5), (1, 5.0, None, 0.5), (2, float("nan"), 1.0, 0.5)]
    df = spark.createDataFrame(rows, "g int, v double, w double, s double")
    got = {r.g: r["quantile"] for r in quantiles.weighted_quantile(df, ["g"], "v", "w", "s").collect()}
    for g in range(3):
        mine = sorted((v, w) for k, v, w, _ in rows if k == g and v is not None and v == v and w)
        total = sum(w for _, w in mine) * 0.3
        assert got[g] == next(v for i, (v, _) in enumerate(mine) if sum(w for _, w in mine[: i + 1]) >= total)


def test_many_different_values_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "CELL_VALUES", 50)
    df = spark.range(3000).select(F.lit(1).alias("g"), (F.col("id") / 7000 + 5).alias("v"), F.lit(2.0).alias("w"))
    assert quantiles.weighted_quantile(df, ["g"], "v", "w").first()["quantile"] == pytest.approx(1499 / 7000 + 5)


def test_absolute_fit_is_near_the_best_and_shrugs_off_outliers(spark):
    rng = np.random.default_rng(2)
    clean = lambda s, a, k, r: 30000 + 1000 * s - 900 * a - 0.05 * k + r.normal(0, 500)
    spoilt = lambda s, a, k, r: clean(s, a, k, r) * (8 if r.random() < 0.1 else 1)
    df, rows = listings_frame(spark, rng, (300, 60, 25), spoilt)
    got = {r.model: r for r in robust.fit_absolute(df, features=("age", "odometer")).collect()}
    lines = {r.model: r for r in train.fit_lines(df).collect()}
    for s, n in enumerate((300, 60, 25)):
        mine = [r for r in rows if r[2] == f"s{s}"]
        x, y = np.array([[1, r[4], r[5]] for r in mine]), np.array([r[6] for r in mine])
        r = got[f"s{s}"]
        mae = np.abs(y - x @ [r.intercept, *r.coefficients]).mean()
        line = lines[f"s{s}"]
        assert r.n == n and mae <= r.mae * (1 + 1e-9) and mae < np.abs(y - x @ [line.intercept, line.b_age, line.b_odometer]).mean()
        best = min(np.abs(y - x @ np.linalg.solve(x[list(some)], y[list(some)])).mean() for some in _triples(x, rng))
        assert mae <= best * 1.01
    assert got["s0"].coefficients[0] == pytest.approx(-900, abs=60)


def _triples(x, rng):
    """Some of the sets of rows through which a best fit may go."""
    for _ in range(4000):
        some = rng.choice(len(x), 3, replace=False)
        if abs(np.linalg.det(x[some])) > 1:
            yield some


def test_held_out_error_is_not_above_the_lines(spark):
    rng = np.random.default_rng(3)
    df, _ = listings_frame(spark, rng, (400, 400), lambda s, a, k, r: 30000 - 900 * a - 0.05 * k + r.standard_t(1.5) * 800)
    fitted, held = df.where("listing_id % 3 <> 0"), df.where("listing_id % 3 = 0")
    a = robust.fit_absolute(fitted, features=("age", "odometer")).select(*KEYS, F.col("intercept").alias("a_intercept"), F.col("coefficients").alias("a_coefficients"))
    line = train.fit_lines(fitted)
    scored = held.join(a, list(KEYS)).join(line, list(KEYS))
    by_fit = F.avg(F.abs(F.col("price") - train.ridge_value(("age", "odometer"), "a_")))
    by_line = F.avg(F.abs(F.col("price") - train.line_value()))
    mae, line_mae = scored.agg(by_fit, by_line).first()
    assert mae <= line_mae


def test_odd_segments(spark):
    rows = [(1, "M", "one", "r", 3, 10.0, 500.0), (2, "M", "same", "r", 3, 10.0, 700.0), (3, "M", "same", "r", 3, 10.0, 700.0),
            (4, "M", "none", "r", 3, 10.0, None), (5, "M", "nulls", None, None, None, 90.0), (6, "M", "nulls", None, 2, None, 110.0)]
    df = spark.createDataFrame(rows, "listing_id long, make string, model string, region string, age int, odometer double, price double")
    got = {r.model: r for r in robust.fit_absolute(df, features=("age", "odometer")).collect()}
    assert set(got) == {"one", "same", "nulls"}
    assert got["one"].intercept + 3 * got["one"].coefficients[0] + 10 * got["one"].coefficients[1] == pytest.approx(500)
    assert got["same"].mae == pytest.approx(0, abs=1e-6)
    assert robust.fit_absolute(df.limit(0), features=("age",)).count() == 0


def test_quantile_lines_cover_their_share_and_rise(spark):
    rng = np.random.default_rng(4)
    price = lambda s, a, k, r: 30000 - 800 * a + r.exponential(300 * a)
    df, _ = listings_frame(spark, rng, (12_000, 20), price)
    fresh, _ = listings_frame(spark, rng, (12_000,), price)
    leaves = train.train_quantiles(train.add_bands(df))
    model = robust.train_quantile_regression(df, fallback=leaves)
    assert {r.model for r in model.lines.select("model").distinct().collect()} == {"s0"}
    rows = model.attach(train.add_bands(fresh)).toPandas()
    for name, level in QUANTILE_LEVELS.items():
        assert abs((rows["price"] <= rows[name]).mean() - level) <= 0.02
    assert (np.diff(rows[list(QUANTILE_LEVELS)].to_numpy(), axis=1) >= 0).all()
    width = (rows["q90"] - rows["q10"]).groupby(rows["age"]).mean()
    assert width.loc[14] > 3 * width.loc[2]  # intervals widen with age as the noise does
    small = model.attach(train.add_bands(df.where("model = 's1'"))).toPandas()
    assert small[list(QUANTILE_LEVELS)].notna().all().all()


@pytest.mark.parametrize("kind", ["absolute"])
def test_deal_search_prices_by_absolute_error(spark, kind):
    rng = np.random.default_rng(5)
    df, _ = listings_frame(spark, rng, (60, 60), lambda s, a, k, r: 20000 - 700 * a + r.normal(0, 300))
    settings = TrainingSettings(model=kind, features=("age", "odometer"))
    models = deal_search.fit_segments(df, settings)
    scored = deal_search.score(df, models, training=settings).toPandas()
    assert (scored["prediction_label"] - scored["price"]).abs().mean() < 400


# --- folds and blends


def test_folded_models_have_not_seen_their_fold(spark):
    rng = np.random.default_rng(6)
    df, rows = listings_frame(spark, rng, (80, 40, 3), lambda s, a, k, r: 20000 + 3000 * s - 500 * a + r.normal(0, 900))
    model = stacking.train_general_folds(df)
    got = {r.listing_id: r for r in model.out_of_fold(df).collect()}
    folds = {r.listing_id: r.fold for r in got.values()}
    for fold in range(5):
        seen = [r for r in rows if folds[r[0]] != fold]
        y = np.array([r[6] for r in seen])
        b, *_ = np.linalg.lstsq(np.array([[1, r[4], r[5]] for r in seen]), y, rcond=None)
        rest = {r[0]: r[6] - b @ [1, r[4], r[5]] for r in seen}
        make = sum(rest.values()) / (len(seen) + 20)
        by_model = defaultdict(list)
        for r in seen:
            by_model[r[2]].append(rest[r[0]] - make)
        for r in rows:
            if folds[r[0]] == fold:
                effect = sum(by_model[r[2]]) / (len(by_model[r[2]]) + 20)
                assert got[r[0]].by_line == pytest.approx(b @ [1, r[4], r[5]] + make + effect, rel=1e-6)


def test_blend_weights_are_the_best_on_the_simplex(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=400)
    columns = np.stack([y + rng.normal(0, 1, 400), y + rng.normal(0, 0.5, 400), rng.normal(0, 3, 400)])
    df = spark.createDataFrame([(float(t), *map(float, c)) for t, c in zip(y, columns.T)], "price double, a double, b double, c double")
    got = stacking.blend_weights(df, ["a", "b", "c"])
    assert sum(got.values()) == pytest.approx(1) and min(got.values()) >= 0
    loss = lambda w: ((y - w @ columns) ** 2).sum()
    mine = loss(np.array(list(got.values())))
    for _ in range(3000):
        assert mine <= loss(rng.dirichlet(np.ones(3))) * (1 + 1e-9)
    assert stacking.blend_weights(df.limit(0), ["a", "b"]) == {"a": 0.5, "b": 0.5}


def test_bagged_general_model_is_the_mean_of_its_folds(spark):
    rng = np.random.default_rng(8)
    df, _ = listings_frame(spark, rng, (80, 40), lambda s, a, k, r: 20000 + 3000 * s - 500 * a + r.normal(0, 900))
    folded = stacking.train_general_folds(df)
    model = folded.blended(1.0, 0.0)
    value = model.attach(df.limit(1)).select(model.value().alias("v"), "model", "age", "odometer").first()
    parts = [
        r.intercept + r.b_age * value.age + r.b_odometer * value.odometer + m.make_line + e.model_line
        for r in folded.lines.collect()
        for m in folded.makes.where(f"left_out = {r.left_out}").collect()
        for e in folded.models.where((F.col("left_out") == r.left_out) & (F.col("model") == value.model)).collect()
    ]
    assert len(parts) == 5 and value.v == pytest.approx(np.mean(parts))
    bag = stacking.train_general_bag(df)
    error = bag.attach(df).agg(F.avg(F.abs(F.col("price") - bag.value()))).first()[0]
    assert error < 1800


def test_models_with_folds_and_quantile_lines_are_stored_and_read(spark, tmp_path):
    rng = np.random.default_rng(12)
    df, _ = listings_frame(spark, rng, (120, 30), lambda s, a, k, r: 20000 - 500 * a + r.normal(0, 900))
    df = df.select("*", *(F.lit(0.0).alias(c) for c in ("engine_size", "year", "is_new", "km_per_year")))
    settings = TrainingSettings(model="absolute", features=("age", "odometer"), general_folds=5, quantile_lines=True)
    models = valuation.train_models(df, settings, OutlierSettings(method="none"))
    valuation.save_models(models, str(tmp_path / "m"))
    again = valuation.load_models(spark, str(tmp_path / "m"))
    assert again.training == settings
    for name in ("prediction_label", "ci_80"):
        first, second = (
            {r.listing_id: r[name] for r in valuation.value_specs(df, m).select("listing_id", name).collect()} for m in (models, again)
        )
        assert first == second and all(first.values())


# --- density clusters


def plain_clusters(rows, min_cosine, size, weights):
    ids, x = [r[0] for r in rows], np.array([np.array(r[1]) / np.linalg.norm(r[1]) for r in rows])
    near = np.round(x @ x.T, 9) >= min_cosine
    degree = (near | np.eye(len(x), dtype=bool)) @ np.array(weights)
    core = degree >= size
    label = {i: ids[i] for i in np.flatnonzero(core)}
    while True:
        new = {i: min(label[j] for j in np.flatnonzero(near[i] & core)) for i in label}
        if new == label:
            break
        label = new
    out = {}
    for i, k in enumerate(ids):
        if core[i]:
            out[k] = label[i]
            continue
        options = [(-np.round(x[i] @ x[j], 9), ids[j], j) for j in np.flatnonzero(near[i] & core)]
        out[k] = label[min(options)[2]] if options else labels.NOISE
    return out


@pytest.mark.parametrize("worth", [0, 1e9])
def test_density_clusters_by_blocks_and_by_cells(spark, monkeypatch, worth):
    monkeypatch.setattr(density, "WORTH", worth)
    test_density_clusters_are_those_of_the_definition(spark, 16, True)


def test_blocks_join_components_that_meet_late(spark, monkeypatch):
    """Chains through many blocks, and cores that the first passes do not prove."""
    monkeypatch.setattr(density, "WORTH", 0)
    rng = np.random.default_rng(4)
    angles = np.sort(np.concatenate([np.linspace(0, 2.0, 700), np.linspace(2.6, 4.0, 300), rng.uniform(0, 6.2, 20)]))
    rows = [(int(k), [math.cos(a), math.sin(a)]) for k, a in zip(rng.permutation(len(angles)), angles)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    cosine = math.cos(0.012)
    got = {r.id: r.cluster for r in density.cluster_density(df, "id", cosine, 8, tile=64).collect()}
    assert got == plain_clusters(rows, cosine, 8, [1] * len(rows)) and len(set(got.values())) == 2


def test_low_thresholds_copy_vectors_to_few_places(spark):
    """At a cosine of 0.3 a vector went to every band; blocks send it to its own and block 0 to all, then only what is open."""
    rng = np.random.default_rng(7)
    common = rng.normal(size=64)
    rows = [(i, (common + rng.normal(size=64)).tolist()) for i in range(6000)]
    nodes = spark.createDataFrame(rows, "node long, vector array<double>").withColumn("weight", F.lit(1).cast("long"))
    bands, bits = density.bands_for(6000, 0.3, 1024)
    assert bands > density.WORTH * 2**bits
    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(6)).cast("int"))
    copies = density._with_first(dealt).count()
    print("copies of a vector", copies / 6000, "by bands", bands)
    assert copies < 3 * 6000 < bands * 6000


@pytest.mark.parametrize("tile, weighted", [(2048, False), (16, False), (40, True)])
def test_density_clusters_are_those_of_the_definition(spark, tile, weighted):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(4, 12))
    rows = [(i * 2, (centres[i % 4] + rng.normal(0, 0.4, 12)).tolist()) for i in range(160)]
    rows += [(1001 + i, rng.normal(size=12).tolist()) for i in range(40)]
    rows += [(2001 + i, rows[5][1]) for i in range(30)]  # copies
    weights = [int(rng.integers(1, 4)) if weighted else 1 for _ in rows]
    data = [(*r, w) for r, w in zip(rows, weights)] + [(3001, None, 1), (3003, [0.0] * 12, 1)]
    df = spark.createDataFrame(data, "id long, embedding array<double>, w int").repartition(5)
    got = {r.id: r.cluster for r in density.cluster_density(df, "id", 0.8, 8, "w" if weighted else None, tile).collect()}
    assert got.pop(3001) == got.pop(3003) == labels.NOISE
    assert got == plain_clusters(rows, 0.8, 8, weights)
    assert len(set(got.values())) > 2


@pytest.mark.parametrize("n", [500, 4000])
def test_planted_density_clusters_come_out_pure_at_any_size(spark, n):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 64))
    rows = [(i, i % 12, (centres[i % 12] + rng.normal(0, 0.25, 64) if i % 12 < 10 else rng.normal(size=64)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, truth int, embedding array<double>")
    got = density.cluster_density(df, "id", 0.75, tile=512).join(df.select("id", "truth"), "id").toPandas()
    planted, rest = got[got.truth < 10], got[got.truth >= 10]
    assert (planted.cluster != labels.NOISE).mean() > 0.99 and (rest.cluster == labels.NOISE).mean() > 0.99
    assert planted.groupby("truth")["cluster"].nunique().max() <= 2 and planted[planted.cluster != -1].groupby("cluster")["truth"].nunique().max() == 1


def test_bands_miss_few_pairs_and_stay_bounded():
    for n in (10, 10**4, 10**7, 10**10):
        for t in (0.0, 0.3, 0.8, 0.99, 1.0):
            bands, bits = density.bands_for(n, t)
            agree = 1 - math.acos(t) / math.pi
            assert bands <= density.MOST_BANDS and (1 - agree**bits) ** bands <= density.MISSED * 1.01


# --- local regression


def plain_lowess(x, y, points, span, passes):
    lo, hi = x.min(), x.max()
    grid = lo + np.arange(points) * ((hi - lo) / (points - 1))
    k = math.ceil(span * len(x))
    weight = np.ones(len(x))
    curve = None
    for _ in range(passes + 1):
        new = []
        for g in grid:
            d = x - g
            h = np.sort(np.abs(d))[k - 1]
            w = weight * ((1 - np.minimum(np.abs(d) / h, 1) ** 3) ** 3 if h > 0 else d == 0)
            s0, s1, s2, t0, t1 = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * y).sum(), (w * d * y).sum()
            flat = s0 * s2 - s1 * s1 <= 1e-9 * s0 * s2
            new.append((t0 / s0 if s0 else np.nan) if flat else (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1))
        curve = np.where(np.isnan(new), curve, new) if curve is not None else np.array(new)
        rest = np.abs(y - np.interp(x, grid, curve))
        s = np.median(rest)
        weight = np.ones(len(x)) if s <= 0 else np.where(rest >= 6 * s, 0, (1 - (rest / (6 * s)) ** 2) ** 2)
    return curve


def test_lowess_is_that_of_a_plain_loop(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.integers(0, 40, 120) * 1000.0, rng.exponential(4000, 80)])
    y = 20000 - 0.2 * x + 3000 * np.sin(x / 9000) + rng.normal(0, 400, 200)
    rows = [("M", "a", float(a), float(b)) for a, b in zip(x, y)] + [("M", "b", 5.0, 1.0), ("M", "b", 5.0, 2.0), ("M", "a", None, 1.0), ("M", "a", 1.0, None)]
    df = spark.createDataFrame(rows, "make string, model string, odometer double, price double")
    got = {(r.model, r.point): r.smoothed for r in lowess.lowess(df, "odometer", "price", points=15).collect()}
    want = plain_lowess(x, y, 15, 2 / 3, 3)
    assert Counter(m for m, _ in got) == {"a": 15}
    assert [got["a", i] for i in range(15)] == pytest.approx(list(want), rel=1e-9)


def test_one_outlier_does_not_move_the_curve(spark):
    rng = np.random.default_rng(11)
    x = np.arange(100) * 1000.0
    y = 20000 - 0.1 * x + rng.normal(0, 100, 100)
    spoilt = y.copy()
    spoilt[50] += 1e6
    curves = []
    for values in (y, spoilt):
        df = spark.createDataFrame([("M", "a", float(a), float(b)) for a, b in zip(x, values)], "make string, model string, odometer double, price double")
        curves.append(np.array([r.smoothed for r in lowess.lowess(df, "odometer", "price", points=10).orderBy("point").collect()]))
    assert np.abs(curves[0] - curves[1]).max() < 60


def test_fits_shuffle_the_rows_they_are_dealt_once(spark, monkeypatch):
    """Without adaptive execution, asking for partitions runs no shuffle; rows that are few keep theirs and the setting."""
    from dealwright.operators import ensemble

    asked = []

    class Fit:
        def fit(self, rows):
            asked.append((rows.rdd.getNumPartitions(), spark.conf.get("spark.sql.adaptive.enabled")))
            return len(asked)

    rows = spark.range(0, 1000, 1, 3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert ensemble._fitted(Fit(), rows) == 1
    monkeypatch.setattr(ensemble, "TASK_ROWS", 50)
    assert ensemble._fitted(Fit(), rows) == 2
    assert asked == [(3, before), (20, "false")] and spark.conf.get("spark.sql.adaptive.enabled") == before == "true"
