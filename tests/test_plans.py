"""What the physical plans of the feature jobs must and must not contain."""

import re

import pytest

import __spark_entry__ as spark_entry
from creditloom.catalog import bindings as b
from creditloom.operators import credit, timegrid, transactions

FOLDER = "/root/testdata/sf0.001"
FEATURE_JOBS = ("credit_features", "transaction_features", "engineered_features")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as for tables that are too big to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", FEATURE_JOBS)
def test_feature_jobs_stay_in_the_engine(spark, name, no_broadcast):
    text = plan(spark_entry.queries()[name](spark, FOLDER))
    for bad in ("Python", "Arrow", "CartesianProduct", "NestedLoop"):
        assert bad not in text, bad
    # the only broadcast is the bounded list of heavy customers; the only single rows are its total and the date bounds
    heavy = 2 if name == "engineered_features" else 0
    assert text.count("BroadcastHashJoin") == heavy
    assert ("SinglePartition" in text) == (name != "credit_features")


def test_days_after_the_last_anchor_are_left_at_the_scan(spark):
    """The bound is a scalar subquery on the date, before anything is grouped."""
    text = plan(spark_entry.queries()["transaction_features"](spark, FOLDER))
    assert text.count("<= Subquery") >= 2 and ">= date_sub(add_months(" in text


def test_filters_and_columns_reach_the_scan(spark):
    txns = spark.read.parquet(f"{FOLDER}/orders.parquet").selectExpr(
        "o_custkey as customer_id", "cast(o_orderdate as date) as transaction_date", "o_orderstatus as category",
        "o_orderpriority as description",
    )
    anchors = spark.sql("select 1L as customer_id, date'1999-01-01' as anchor_date")
    text = plan(transactions.income_sources(txns, anchors))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,Income\)", text)
    assert "o_totalprice" not in text


def test_history_is_shuffled_once_per_side(spark, no_broadcast):
    """The window and the grouping reuse the join's partitioning."""
    txns = spark.sql(
        "select id % 3 as customer_id, date_add(date'2024-01-01', cast(id as int)) as transaction_date, 1D as amount, 'credit' as type, "
        "'x' as description, 'Income' as category from range(10)"
    )
    anchors = spark.sql("select id as customer_id, date'2024-02-01' as anchor_date from range(5)")
    history = timegrid.point_in_time(anchors, transactions.daily_rollup(txns))
    text = plan(timegrid.min_balance(history))
    # transactions by (customer, day), days by customer, anchors by customer
    assert text.count("Exchange hashpartitioning") == 3


def test_account_totals_combine_before_each_shuffle(spark):
    text = plan(credit.account_totals(b.credit_accounts(spark, FOLDER)))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("HashAggregate") == 4
    assert "SortAggregate" not in text and "Expand" not in text


def test_daily_rollup_uses_hash_aggregation(spark):
    text = plan(transactions.daily_rollup(b.transactions(spark, FOLDER)))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2
