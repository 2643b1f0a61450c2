import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dealwright.operators import history
from dealwright.session import fresh_path
from dealwright.streaming import scoring, stateful


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


@pytest.fixture
def sightings(spark):
    rows = [("a", 1, at(1), 100.0), ("a", 2, at(1, 5), 90.0), ("a", 3, at(9), 95.0), ("b", 4, at(2), 50.0)]
    return spark.createDataFrame(rows, "listing_id string, event_id long, ts timestamp, price double")


def test_moves_carry_over_hours(sightings):
    got = {r.event_id: (r.previous, r.move) for r in history.price_moves(sightings).collect()}
    assert got == {1: (None, None), 2: (100.0, -10.0), 3: (90.0, 5.0), 4: (None, None)}


def test_latest_and_days(sightings):
    assert {(r.listing_id, r.price) for r in history.latest_snapshot(sightings).collect()} == {("a", 95.0), ("b", 50.0)}
    assert {(r.listing_id, r.days) for r in history.days_on_market(sightings).collect()} == {("a", 8), ("b", 0)}


def test_digest_keeps_the_best_of_each_day(spark):
    rows = [(f"L{i}", at(1 + i % 2), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "listing_id string, ts timestamp, discount_pct double")
    got = history.daily_digest(df, n=3).collect()
    assert {r.listing_id: r.place for r in got} == {"L98": 1, "L96": 2, "L94": 3, "L99": 1, "L97": 2, "L95": 3}


def test_watchlist(spark):
    deals = spark.createDataFrame([("1", "A", "x", 100, "N", 50.0), ("2", "A", "x", 300, "S", 50.0)],
                                  "listing_id string, make string, model string, price int, region string, discount_pct double")
    watch = spark.createDataFrame([(7, "A", "x", 200.0, None), (8, "A", "x", 500.0, "S")],
                                  "watch_id int, make string, model string, budget double, region string")
    assert {(r.watch_id, r.listing_id) for r in history.watchlist_match(deals, watch).collect()} == {(7, "1"), (8, "2")}


def test_watchlist_of_one_hot_segment(spark, monkeypatch):
    """Half of both sides in one segment: every pair that plain comparison finds, and no group beyond a band."""
    monkeypatch.setattr(history, "BAND", 16)
    deals = [(f"L{i}", "A" if i % 2 else f"M{i % 9}", "x", i * 7 % 50 if i % 11 else None, ["N", "S", None][i % 3], 1.0) for i in range(300)]
    watches = [(i, "A" if i % 2 else f"M{i % 9}", "x", float(i * 3 % 40) if i % 13 else None, [None, "N", "S"][i % 3]) for i in range(200)]
    watches += [watches[1], (900, None, "x", 99.0, None)]
    d = spark.createDataFrame(deals, "listing_id string, make string, model string, price int, region string, discount_pct double")
    w = spark.createDataFrame(watches, "watch_id int, make string, model string, budget double, region string")
    expected = sorted(
        (i, listing) for listing, make, model, price, region, _ in deals for i, m, o, budget, wanted in watches
        if price is not None and budget is not None and (make, model) == (m, o) and price <= budget and wanted in (None, region)
    )
    assert sorted((r.watch_id, r.listing_id) for r in history.watchlist_match(d, w).collect()) == expected
    assert history.watchlist_match(d.limit(0), w).count() == history.watchlist_match(d, w.limit(0)).count() == 0
    rows = history._bands(d.where("price IS NOT NULL").withColumn("place", F.lit("")), "price", "listing_id")
    assert rows.groupBy("make", "band").count().agg(F.max("count")).first()[0] <= 16


def test_watchlist_tiles_are_dealt_to_tasks(spark, monkeypatch):
    """The rows of many tiles are few, their pairs are not: tiles stay in several tasks, and no pair is lost."""
    monkeypatch.setattr(history, "BAND", 16)
    d = spark.range(200).selectExpr("string(id) AS listing_id", "'A' AS make", "'x' AS model", "id AS price", "'N' AS region", "1.0D AS discount_pct")
    w = spark.range(160).selectExpr("id AS watch_id", "'A' AS make", "'x' AS model", "double(id) AS budget", "string(NULL) AS region")
    met = history.watchlist_match(d, w)
    assert met.rdd.getNumPartitions() > 8
    assert met.count() == met.distinct().count() == sum(price <= budget for price in range(200) for budget in range(160))


def test_stream_scores_each_arrival_once_across_restarts(spark, tmp_path):
    source, out, progress = str(tmp_path / "in"), fresh_path(spark, "out"), fresh_path(spark, "progress")
    columns = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    models = spark.createDataFrame([("view", 100.0, 1.0)], "model string, intercept double, slope double")

    def deliver(rows):
        spark.createDataFrame(rows, columns).write.mode("append").parquet(source)
        scored = scoring.score_arrivals(scoring.read_arrivals(spark, source), models)
        scoring.append_to(scored, out, progress).awaitTermination()

    first = (1, at(1), 9, "view", 60.0, '{"k": 20}')
    deliver([first, first])
    deliver([first, (2, at(1, 1), 9, "view", 150.0, '{"k": 50}')])
    got = {r.event_id: r.discount_pct for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 2 and got == {1: 50.0, 2: 0.0}


def test_streamed_moves_and_digest_are_those_of_the_batch_with_late_and_repeated_files(spark, tmp_path):
    source, moves, told = str(tmp_path / "in"), fresh_path(spark, "moves"), fresh_path(spark, "told")
    progress = {p: fresh_path(spark, "progress") for p in (moves, told)}
    columns = "event_id long, ts timestamp, listing_id long, price double, discount_pct double"
    files = [
        [(1, at(1, 3), 7, 100.0, 5.0), (2, at(1, 9), 7, 90.0, 9.0), (3, at(1, 9), 8, 50.0, 7.0)],
        [(4, at(1, 6), 7, 95.0, 6.0), (2, at(1, 9), 7, 90.0, 9.0), (5, at(2, 1), 8, None, 1.0)],  # late, and repeated
        [(6, at(2, 20), 8, 40.0, 30.0), (7, at(2, 20), 7, 80.0, 30.0), (8, at(2, 21), 9, 10.0, 2.0)],
        [(1, at(1, 3), 7, 100.0, 5.0), (9, at(4, 23), 1, 1.0, 1.0)],
        [(10, at(9), 1, 1.0, 1.0), (11, at(2, 20), 8, 1.0, 99.0)],  # long after its time: left out
    ]
    with stateful.state_store(spark):
        for rows in files:
            spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(source)
            for path, step in ((moves, stateful.price_moves), (told, lambda s: stateful.best_of_days(s, n=2))):
                stream = spark.readStream.schema(columns).parquet(source)
                scoring.append_to(step(stream), path, progress[path]).awaitTermination()
    all_rows = {r[0]: r for rows in files for r in rows if r[0] < 10}
    batch = spark.createDataFrame(list(all_rows.values()), columns)
    want = {r.event_id: (r.previous, r.move) for r in history.price_moves(batch).collect()}
    got = {r.event_id: (r.previous, r.move) for r in spark.read.parquet(moves).collect()}
    assert got == want and spark.read.parquet(moves).count() == 9
    best = stateful.digest(spark.read.parquet(told), 2).orderBy("day", "place").collect()
    assert [(r.day, r.place, r.listing_id) for r in best] == [
        ("2024-01-01", 1, 7), ("2024-01-01", 2, 8), ("2024-01-02", 1, 7), ("2024-01-02", 2, 8), ("2024-01-04", 1, 1)
    ]


def test_moves_of_a_bucket_take_few_calls_to_the_state():
    """Calls to the state grow with the listings that moved, not with their sightings."""
    calls = []

    class State:
        def __init__(self):
            self.rows, self.values = [], {}

        def __getattribute__(self, name):
            if name not in ("rows", "values"):
                calls.append(name)
            return object.__getattribute__(self, name)

        def appendList(self, rows):
            self.rows += rows

        def put(self, rows):
            self.rows = list(rows)

        def get(self):
            return iter(list(self.rows))

        def clear(self):
            self.rows = []

        def containsKey(self, key):
            return key in self.values

        def getValue(self, key):
            return self.values[key]

        def updateValue(self, key, value):
            self.values[key] = value

        def removeKey(self, key):
            del self.values[key]

    class Handle:
        timers: list = []

        def getMapState(self, *_):
            return State()

        def getListState(self, *_):
            return State()

        def registerTimer(self, ms):
            calls.append("timer")
            self.timers.append(ms)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getExpiryTimeInMs(self):
            return self.ms

        getCurrentWatermarkInMs = getExpiryTimeInMs

    moves, handle = stateful.PriceMoves(), Handle()
    moves.init(handle)
    stamps = pd.date_range("2024-01-01", periods=1000, freq="min")
    rows = pd.DataFrame({"listing_id": [i % 5 for i in range(1000)], "event_id": range(1000), "ts": stamps, "price": [float(i) for i in range(1000)]})
    list(moves.handleInputRows((1,), iter([rows.iloc[::-1], rows.iloc[:10]]), None))
    middle = Clock(stamps[499].value // 1_000_000 + 1)
    first = pd.concat(moves.handleExpiredTimer((1,), middle, middle))
    end = Clock(handle.timers[-1] + 10**9)
    second = pd.concat(moves.handleExpiredTimer((1,), end, end))
    assert len(first) == 500 and len(second) == 500 and handle.timers[-1] == stamps[500].value // 1_000_000 + 1
    both = pd.concat([first, second]).sort_values("event_id")
    assert both["previous"].tolist()[5:] == [float(i) for i in range(995)] and both["previous"].isna().sum() == 5
    print("calls to the state", len(calls))
    assert len(calls) < 100


def test_alerts_come_once_per_search_and_listing(spark, tmp_path):
    source, out, progress = str(tmp_path / "in"), fresh_path(spark, "out"), fresh_path(spark, "progress")
    columns = "listing_id long, make string, model string, region string, ts timestamp, price double, discount_pct double"
    watches = spark.createDataFrame([(1, "A", "x", 100.0, None), (2, "A", "x", 60.0, "N")], "watch_id long, make string, model string, budget double, region string")
    for hour, price in ((1, 90.0), (2, 55.0), (3, 50.0)):
        spark.createDataFrame([(5, "A", "x", "N", at(1, hour), price, 1.0)], columns).write.mode("append").parquet(source)
        found = stateful.alerts(spark.readStream.schema(columns).parquet(source), watches)
        scoring.append_to(found, out, progress).awaitTermination()
    assert sorted((r.watch_id, r.price) for r in spark.read.parquet(out).collect()) == [(1, 90.0), (2, 55.0)]


def test_watchlist_copies_carry_the_number_of_their_tile(spark, monkeypatch):
    """A row travels once for each tile it stands in: without the make, model, place and bands that the number stands for."""
    monkeypatch.setattr(history, "BAND", 8)
    d = spark.range(50).selectExpr("string(id) AS listing_id", "'A' AS make", "'x' AS model", "id AS price", "'N' AS region", "1.0D AS discount_pct")
    w = spark.range(40).selectExpr("id AS watch_id", "'A' AS make", "'x' AS model", "double(id) AS budget", "string(NULL) AS region")
    plan = history.watchlist_match(d, w)._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(tile" in line]
    assert len(moved) == 2 and not any(word in line for line in moved for word in ("make", "place", "band"))
