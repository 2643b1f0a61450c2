import pytest
from pyspark.sql import Row

from dealwright.config import FilterRule, filter_rules, settings_from_mappings
from dealwright.operators import clean, filters
from dealwright.schemas import LISTINGS_RAW


def test_derive_age_km(spark):
    df = spark.createDataFrame([(2016, 100000.0), (2026, 500.0), (2027, 500.0), (None, 500.0)], "year int, odometer double")
    got = [(r.age, r.km_per_year) for r in clean.derive_age_km(df).collect()]
    assert got == [(10, 10000.0), (0, 500.0), (-1, 500.0), (None, None)]


def listing(**changes):
    base = dict(
        listing_id="1", make="A", model="B", title=None, price_display="$10,000", region=None, engine_size=1500.0,
        odometer=90000.0, year=2016, transmission="Manual", fuel="Petrol", cylinders=4.0, exterior_colour=None,
        stereo_description=None, is_4wd=True, is_new=None, is_dealer=None, bid_count=None,
    )
    return {**base, **changes}


def raw(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in LISTINGS_RAW.fields) for r in rows], LISTINGS_RAW)


def test_feature_engineering_keeps_the_segment_when_a_price_is_bad(spark):
    df = raw(spark, listing(), listing(listing_id="2", price_display="POA"))
    out = clean.feature_engineering(df).collect()
    assert [r.listing_id for r in out] == ["1"]
    r = out[0]
    assert (r.price, r.cylinders, r.region, r.is_new, r.is_dealer, r.colour_label) == (10000, "4", "nan", 0, None, "Unknown")
    bad = clean.unpriced(clean.parse_prices(df)).collect()
    assert [(b.listing_id, b.payload) for b in bad] == [("2", "POA")]


def test_build_data_points_spells_cylinders_as_training_does(spark):
    specs = spark.createDataFrame([Row(region="X", engine_size=1500.0, odometer=100000.0, year=2016, transmission="M",
                                       fuel="P", cylinders=4, is_4wd=1)])
    r = clean.build_data_points(specs).first()
    assert (r.cylinders, r.is_new, r.is_dealer, r.age, r.km_per_year) == ("4", 0, 0, 10, 10000.0)


def test_not_equal_keeps_null(spark):
    df = spark.createDataFrame([("x",), (None,), ("y",)], "c string")
    kept = [r.c for r in filters.apply_filters(df, [FilterRule("c", "!=", "x")]).collect()]
    assert kept == [None, "y"]


def test_unusable_rules_are_skipped(spark):
    df = spark.createDataFrame([(1,), (2,)], "c int")
    rules = [FilterRule("nope", "==", 1), FilterRule("c", "==", None), FilterRule(None, "==", 1), None]
    assert filters.apply_filters(df, rules).count() == 2


def test_unknown_comparison_is_rejected(spark):
    with pytest.raises(ValueError):
        filters.apply_filters(spark.range(1), [FilterRule("id", "or 1==", 1)])


def test_non_auction_is_a_no_op_without_bids(spark):
    assert filters.filter_non_auction(spark.range(3)).count() == 3


def test_select_listing(spark):
    df = spark.createDataFrame([("a",), ("b",)], "listing_id string")
    one, rest = filters.select_listing(df, "a")
    assert (one.count(), rest.count()) == (1, 1)
    none, everything = filters.select_listing(df, None)
    assert (none.count(), everything.count()) == (0, 2)


def test_whole_ranges_keep_the_top_row(spark):
    df = spark.createDataFrame([(1.5,), (9.9,)], "p double")
    assert filters.range_filters(df, filters.whole_ranges(df, ["p"])).count() == 2


def test_info_join_fans_out_on_duplicates(spark):
    df = spark.createDataFrame([("a", 1)], "listing_id string, price int")
    info = spark.createDataFrame([("a", "t1"), ("a", "t2")], "listing_id string, title string")
    assert filters.attach_listing_info(df, info).count() == 2


def test_display_projection(spark):
    df = spark.createDataFrame(
        [("A", "B", 12000, 20000.4, 40.04, "N", 19000.0, -5.0, "1")],
        "make string, model string, price int, prediction_label double, discount_pct double, region string,"
        "comparison_value double, regional_diff_pct double, listing_id string",
    )
    r = filters.display_projection(df, "Otago").first().asDict()
    assert r == {"Make": "A", "Model": "B", "price": "$12,000", "Est. Value": "$20,000", "Discount": "40.0%",
                 "Region": "N", "Otago Value": "$19,000", "Region Diff": "-5.0%", "ListingId": "1"}


def test_settings():
    s = settings_from_mappings(
        {"cars": [{"make": "A", "model": "B"}], "filters": [{"column": "c", "operator": "==", "value": 1}, None],
         "comparison_region": "Otago"},
        {"general_model": {"enabled": True, "blend_threshold_min": 40}, "outlier_filtering": {"method": "none"}},
    )
    assert s.search.segments == (("A", "B"),) and s.search.filters == (FilterRule("c", "==", 1),)
    assert s.blend.full_general_below == 40 and s.outliers.method == "none" and filter_rules(None) == ()
