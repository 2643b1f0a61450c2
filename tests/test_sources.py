import datetime
import json

from pyspark.sql import functions as F

from dealwright.session import fresh_path, materialise, shared_dir
from dealwright.sources import pages, registry, tables


def page_folder(spark, tmp_path):
    folder = tmp_path / "pages" / "make=Toyota" / "model=Rav4"
    folder.mkdir(parents=True)
    page = {"TotalCount": 3, "List": [{"ListingId": "1", "PriceDisplay": "$5,000", "Odometer": 1000, "Extra": [1]},
                                      {"ListingId": "2", "Is4WD": True}]}
    (folder / "1.json").write_text(json.dumps(page, indent=1))
    (folder / "2.json").write_text(json.dumps({"TotalCount": 3, "List": []}))
    return pages.read_pages(spark, str(tmp_path / "pages"))


def test_pages(spark, tmp_path):
    read = page_folder(spark, tmp_path)
    rows = {r.listing_id: r for r in pages.explode_pages(read).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].price_display == "$5,000" and rows["2"].is_4wd and rows["1"].make == "Toyota"
    check = pages.completeness(read).first()
    assert (check.total_count, check.n_received, check.n_pages, check.status) == (3, 2, 1, "incomplete")


def test_pages_needed(spark):
    df = spark.createDataFrame([(1000,), (999,), (0,)], "n int")
    assert [r[0] for r in df.select(pages.pages_needed(F.col("n"))).collect()] == [3, 2, 1]


def test_stored_segments_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", "x", 5), ("2", "A", "y", 6), ("3", "B", "x", 7)],
                               "listing_id string, make string, model string, price int")
    path = str(tmp_path / "listings")
    tables.sink_segments(df, path)
    one = tables.scan_segment(tables.scan_all_segments(spark, path), "A", "y")
    assert [r.listing_id for r in one.collect()] == ["2"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(make" in plan
    some = tables.scan_segments(tables.scan_all_segments(spark, path), [("A", "x"), ("B", "x")])
    assert {r.listing_id for r in some.collect()} == {"1", "3"}


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.registry_read(spark, path).count() == 0
    sizes = spark.createDataFrame([("A", "x", 120), ("B", "y", 30)], "make string, model string, n int")
    for day in (1, 5):
        at = F.lit(datetime.datetime(2026, 1, day))
        registry.registry_write(registry.segment_entries(sizes.withColumn("n", F.col("n") + day), "specific", at, "m"), path)
    registry.registry_write(registry.general_entries(sizes, F.current_timestamp(), "m/general"), path)
    newest = registry.latest(registry.registry_read(spark, path))
    rows = {(r.kind, r.make): r for r in newest.collect()}
    assert rows["specific", "A"].n_training_samples == 125 and rows["specific", "B"].path == "m/B_y"
    assert rows["general", None].n_training_samples == 150 and rows["general", None].car_types == 2
    assert {k[1]: r.n_training_samples for k, r in rows.items() if k[0] == "general_part"} == {"A": 120, "B": 30}
    assert registry.has_general_model(newest)
    data = spark.createDataFrame([("A", "x"), ("C", "z")], "make string, model string")
    assert [tuple(r) for r in registry.catalog_available(data, newest).collect()] == [("A", ["x"])]
    wanted = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z"), ("D", "q")], "make string, model string")
    missing = {(r.make, r.needs_fetch, r.needs_training) for r in registry.missing_segments(wanted, data, newest).collect()}
    assert missing == {("B", True, False), ("C", False, True), ("D", True, True)}


def test_lookup_ignores_case(spark):
    asked = spark.createDataFrame([("toyota", "RAV4"), ("x", "y")], "make string, model string")
    known = spark.createDataFrame([("Toyota", "Rav4")], "make string, model string")
    got = {r.make: (r.known_make, r.known_model, r.specific_model_exists) for r in registry.segment_lookup_ci(asked, known).collect()}
    assert got == {"toyota": ("Toyota", "Rav4", True), "x": (None, None, False)}


def test_materialise_cuts_the_lineage(spark):
    kept = materialise(spark.range(100).withColumn("x", F.col("id") * 2))
    assert kept.count() == 100 and "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert fresh_path(spark, "a") != fresh_path(spark, "a") and fresh_path(spark, "a").startswith(shared_dir(spark))
