"""The shape of the plans: what must not appear in a job meant for large tables."""

from contextlib import ExitStack
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dealwright.operators import market, sampling, train
from dealwright.plans import all_queries, deal_search
from dealwright.plans.base import features
from dealwright.plans.model_queries import MODEL_INPUT
from dealwright.session import materialise, setting
from dealwright.sources.listings import listings

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["market_summary", "price_histogram", "oos_split", "train_specific", "predict_blended", "deal_search",
     "permutation_importance", "extract_listing", "fuzzy_segment", "classify_by_centroid", "watchlist_match", "value_specs"],
)
def test_no_pairing_of_whole_tables(spark, name):
    plan = plan_of(all_queries.QUERIES[name](spark, SF))
    assert not [f for f in FORBIDDEN if f in plan]


def test_scan_reads_only_the_needed_columns(spark):
    plan = plan_of(market.price_quantiles(features(spark, SF, "make", "model", "price")))
    schema = plan[plan.index("ReadSchema: ") :].split("\n")[0]
    assert "l_shipdate" not in schema and "l_comment" not in schema and "l_quantity" not in schema
    assert "orders.parquet" not in plan and "supplier.parquet" not in plan


def test_training_never_shuffles_rows(spark):
    """Only sums per segment cross the network: every exchange sits above a partial aggregate."""
    plan = plan_of(train.fit_lines(materialise(features(spark, SF, *MODEL_INPUT))))
    exchanges = [i for i, line in enumerate(plan.split("\n")) if "Exchange hashpartitioning" in line]
    lines = plan.split("\n")
    assert exchanges and all("partial_" in lines[i + 1] for i in exchanges)


def test_splitting_moves_no_rows(spark):
    """The cut of each segment comes from counts; the rows themselves are flagged where they are."""
    rows = materialise(features(spark, SF, "make", "model", "listing_id"))
    plan = plan_of(sampling.oos_split(rows))
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_scoring_adds_no_second_pass_for_the_regional_what_if(spark):
    rows = features(spark, SF, *MODEL_INPUT)
    models = deal_search.train_segments(rows)
    plain = plan_of(deal_search.score(rows, models)).count("FileScan")
    compared = plan_of(deal_search.score(rows, models, "ASIA")).count("FileScan")
    assert plain == compared


def test_kept_rows_leave_no_shuffle_on_disk(spark):
    """Rows that are stored need what was shuffled for them no longer."""
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    shuffled = lambda: {p.name for p in folder.rglob("shuffle_*.data")}
    before = shuffled()
    kept = materialise(spark.range(20_000).repartition(4).groupBy((F.col("id") % 7000).alias("k")).count(), "zstd")
    assert not shuffled() - before
    assert kept.count() == 7000 and kept.agg(F.sum("count")).first()[0] == 20_000
    assert all(".zstd" in name for name in kept.inputFiles())
    assert "true" != spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)


def test_line_items_move_as_numbers_and_no_more_often_than_joins_ask(spark):
    """Texts of parts are not carried from join to join, places are copied, and many tasks need no dealing out."""
    fine = {"spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "0"}
    joins = {"spark.sql.autoBroadcastJoinThreshold": "2500", "spark.sql.adaptive.enabled": "false"}
    with ExitStack() as stack:
        for key, value in (fine | joins).items():
            stack.enter_context(setting(spark, key, value))
        plan = plan_of(listings(spark, SF))
        moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert len(moved) == 4 and plan.count("BroadcastHashJoin") == 3
        below = plan[plan.index("Exchange hashpartitioning(l_partkey") :]
        assert "p_name" not in below[: below.index("Exchange hashpartitioning(p_partkey")]
    cores = spark.sparkContext.defaultParallelism
    assert "RoundRobin" in plan_of(features(spark, SF, *MODEL_INPUT))
    with ExitStack() as stack:
        for key, value in fine.items():
            stack.enter_context(setting(spark, key, value))
        few = features(spark, SF, *MODEL_INPUT)
        assert "RoundRobin" not in plan_of(few) and few.rdd.getNumPartitions() > cores
    assert few.count() == features(spark, SF, *MODEL_INPUT).count()
