"""Hand-made edge rows with known results."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from creditloom.functions import dates, labels, lending, numbers
from creditloom.modelling import metrics
from creditloom.operators import assemble, credit, encoding, profiling, timegrid, transactions
from creditloom.plans import training


def date(text):
    return dt.date.fromisoformat(text)


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


APPS = "customer_id string, loan_id string, application_date date, has_credit_history int"
TXNS = "customer_id string, transaction_date date, amount double, type string, description string, category string"
ACCS = (
    "customer_id string, credit_score int, account_id string, account_open_date date, account_type string, "
    "sanctioned_limit double, current_balance double, max_dpd_past_24m int, num_30_dpd_last_6m int, "
    "num_90_dpd_last_12m int, num_defaults_total int, num_settled_total int, account_status string"
)


def features(spark, app_date, rows, rules=transactions.TransactionRules()):
    apps = spark.createDataFrame([("c", "l", date(app_date), 1)], APPS)
    txns = spark.createDataFrame([("c", date(d), *rest) for d, *rest in rows], TXNS)
    return transactions.transaction_features(apps, txns, rules).first()


def credit_of(d, amount, description="Salary", category="Income"):
    return (d, amount, "credit", description, category)


@pytest.mark.parametrize(
    "anchor, months, start",
    [
        ("2024-08-31", 6, "2024-02-29"),
        ("2023-03-30", 1, "2023-02-28"),
        ("2024-02-29", 12, "2023-02-28"),
        ("2024-04-30", 6, "2023-10-30"),
    ],
)
def test_month_end_is_clamped(spark, anchor, months, start):
    a = F.lit(date(anchor))
    assert one(spark, F.add_months(a, -months)) == date(start)
    assert one(spark, dates.in_window(F.lit(date(start)), a, months))
    assert one(spark, dates.in_window(a, a, months))
    assert not one(spark, dates.in_window(F.date_sub(F.lit(date(start)), 1), a, months))
    assert not one(spark, dates.in_window(F.date_add(a, 1), a, months))


def test_grid_drops_the_partial_oldest_month(spark):
    row = features(
        spark,
        "2024-08-15",
        [credit_of("2024-02-20", 100.0), credit_of("2024-03-05", 50.0), credit_of("2024-08-10", 70.0)],
    )
    assert row.avg_monthly_net_income_6m == 20
    assert row.std_dev_monthly_net_income_6m == pytest.approx(31.622776601683793, rel=1e-12)
    assert row.num_distinct_income_sources_6m == 1
    assert row.longest_income_gap_days_12m == 158


def test_no_transactions_give_zeros(spark):
    row = features(spark, "2024-08-15", []).asDict()
    assert {v for k, v in row.items() if k != "customer_id"} == {0}
    assert len(row) == 17


def test_rows_after_the_application_change_nothing(spark):
    past = [credit_of("2024-05-01", 10.0), ("2024-06-01", 4.0, "debit", "Rent Payment", "Essential")]
    future = [credit_of("2024-08-16", 999.0, "Bonus"), ("2024-09-01", 7.0, "debit", "Overdraft Fee", "Fee")]
    assert features(spark, "2024-08-15", past) == features(spark, "2024-08-15", past + future)


def test_window_ends_are_included(spark):
    rows = [(d, 5.0, "debit", "Rent Payment", "Essential") for d in ("2024-02-15", "2024-08-15", "2024-02-14")]
    assert features(spark, "2024-08-15", rows).num_recurring_bill_payments_detected == 2


def test_large_withdrawals_need_more_than_the_limit(spark):
    def count(amount, **rules):
        row = ("2024-08-01", amount, "debit", "ATM Withdrawal", "Transfers")
        return features(spark, "2024-08-15", [row], transactions.TransactionRules(**rules)).large_cash_withdrawal_frequency_6m

    assert [count(10000.0), count(10000.01), count(-20000.0), count(-20000.0, magnitudes=True)] == [0, 1, 0, 1]


def test_minimum_balance_carries_over_a_gap(spark):
    days = spark.createDataFrame(
        [("c", date("2024-01-10"), 10.0), ("c", date("2024-03-02"), 2.0), ("c", date("2024-05-20"), 1.0)],
        "customer_id string, day date, signed_amount double",
    )
    anchors = spark.createDataFrame([("c", date("2024-08-15"))], "customer_id string, anchor_date date")
    history = timegrid.point_in_time(anchors, days)
    lows = timegrid.running_balance(history).withColumns(timegrid.month_span(6)).groupBy("customer_id").agg(
        *[c.alias(f"low_{i}") for i, c in enumerate(timegrid.month_minima(6))]
    )
    assert list(lows.first())[1:] == [None, None, None, 12, 12, 10, 10]
    assert timegrid.min_balance(history).first().avg_monthly_balance_min_6m == 11


def test_one_income_row_has_no_gap(spark):
    assert features(spark, "2024-08-15", [credit_of("2024-08-01", 1.0)]).longest_income_gap_days_12m == 0


def test_recurring_salary_needs_four_months(spark):
    months = ["2024-05-01", "2024-06-01", "2024-07-01", "2024-08-01"]
    four = [credit_of(d, 1.0) for d in months]
    assert features(spark, "2024-08-15", four).has_recurring_salary_flag == 1
    assert features(spark, "2024-08-15", four[1:]).has_recurring_salary_flag == 0
    assert features(spark, "2024-08-15", [credit_of(d, 1.0, "Bonus") for d in months]).has_recurring_salary_flag == 0


def test_monthly_instalments_are_an_option(spark):
    rows = [("2024-01-01", 120.0, "debit", "Loan EMI Deduction", "Essential")]
    assert features(spark, "2024-08-15", rows).detected_other_emis_sum == 120
    monthly = transactions.TransactionRules(emi_monthly=True)
    assert features(spark, "2024-08-15", rows, monthly).detected_other_emis_sum == 10


def test_earliest_application_is_the_anchor(spark):
    apps = spark.createDataFrame(
        [("c", "l2", date("2024-03-01"), 1), ("c", "l1", date("2024-01-01"), 1)], APPS
    )
    assert timegrid.anchor_dates(apps).collect() == [("c", date("2024-01-01"))]


def account(customer="c", score=500, number="a", opened="2020-01-01", kind="Auto Loan", limit=10.0, balance=1.0,
            status="Active", defaults=0):
    opened = date(opened) if opened else None
    return (customer, score, number, opened, kind, limit, balance, 0, 1, 1, defaults, 0, status)


def credits(spark, rows, history=1):
    apps = spark.createDataFrame([("c", "l", date("2024-08-15"), history)], APPS)
    return credit.credit_features(apps, spark.createDataFrame(rows, ACCS))


def test_account_opened_after_the_reference_date(spark):
    row = credits(spark, [account(opened="2025-01-10")]).first()
    assert (row.oldest_account_age_months, row.newest_account_age_months) == (-1, -1)
    assert row.avg_account_age_months == -1


def test_all_null_group(spark):
    row = credits(spark, [account(score=None, opened=None, limit=None, balance=None, number=None)]).first()
    assert (row.total_sanctioned_limit, row.total_outstanding_balance, row.num_credit_accounts_total) == (0, 0, 0)
    assert (row.credit_score, row.oldest_account_age_months) == (None, None)
    assert row.overall_credit_utilization_ratio == 0


def test_first_score_skips_null(spark):
    rows = [account(score=None, opened="2019-01-01"), account(score=5, number="b"), account(score=9, number="d", opened="2021-01-01")]
    assert credits(spark, rows).first().credit_score == 5
    assert credit.first_score(spark.createDataFrame(rows, ACCS)).first().credit_score == 5


def test_first_score_without_any_date(spark):
    rows = [account(score=7, opened=None), account(score=-3, number="b", opened=None)]
    assert credits(spark, rows).first().credit_score == -3
    rows.append(account(score=800, number="d"))
    assert credits(spark, rows).first().credit_score == 800


def test_zero_limit_means_zero_utilisation(spark):
    assert credits(spark, [account(limit=0.0, balance=10.0)]).first().overall_credit_utilization_ratio == 0


def test_accounts_repeat_and_cards_count_once(spark):
    card = account(kind="Credit Card", number="x")
    row = credits(spark, [card, card, account(number="y", kind="Credit Card", status="Closed")]).first()
    assert (row.num_credit_accounts_total, row.num_credit_accounts_active, row.num_revolving_accounts_active) == (2, 2, 1)


def test_no_history_gives_an_empty_table_that_still_joins(spark):
    empty = credits(spark, [account()], history=0)
    assert empty.count() == 0
    assert empty.columns == ["customer_id", *credit.CREDIT_FEATURES]
    apps = spark.createDataFrame(
        [("c", "l", date("2024-08-15"), 0, 0.0, 10.0, 0.0)],
        APPS + ", monthly_gross_income double, emi_requested double, other_emi_declared double",
    )
    txns = transactions.transaction_features(apps, spark.createDataFrame([], TXNS))
    row = assemble.assemble(apps, empty, txns).first()
    assert row.credit_score == 0
    assert row.debt_to_income_ratio_computed == 999
    assert row.residual_income_after_emi == -10
    assert "application_date" not in row.asDict()


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(v,) for v in (10, 2, 10, 2, 3)], "v int")
    assert profiling.mode(df, ["v"]).collect() == [("v", "2")]


def test_summary(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 100.0, None)], "v double")
    row = profiling.describe(df).first()
    assert tuple(row) == ("v", 4, 26.5, pytest.approx(49.00680224893955, rel=1e-12), 1, 1.75, 2.5, 27.25, 100)


def test_dummies_without_the_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "k int, c string")
    step = encoding.fit_one_hot(df, ["c"], drop_first=True, as_boolean=True, null_category=False)
    table = step.transform(df)
    assert table.columns == ["k", "c_b", "c_c"]
    assert sorted(tuple(r) for r in table.collect()) == [
        (1, True, False), (2, False, False), (3, False, False), (4, False, True),
    ]


def test_full_encoding_of_nulls_and_unseen(spark):
    df = spark.createDataFrame([(1, "it's"), (2, None)], "k int, c string")
    step = encoding.fit_one_hot(df, ["c"], new_first=True)
    assert step.transform(df).columns == ["c_it's", "c_nan", "k"]
    unseen = spark.createDataFrame([(3, "new")], "k int, c string")
    assert step.transform(unseen).collect() == [(0, 0, 3)]


def test_too_many_categories_is_an_error(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 5"):
        encoding.fit_one_hot(df, ["c"], most=5)


def test_dates_in_the_wrong_format(spark):
    df = spark.createDataFrame([("2024-05-17",), (None,), ("17-05-2024",)], "d string")
    lenient = df.select(dates.parse_date(F.col("d"), "dd-MM-yyyy", strict=False).alias("d"))
    assert [r.d for r in lenient.collect()] == [None, None, date("2024-05-17")]
    with pytest.raises(PySparkException, match="not a date"):
        df.select(dates.parse_date(F.col("d"), "dd-MM-yyyy")).collect()
    fine = df.where("d is null or d like '17%'").select(dates.parse_date(F.col("d"), "dd-MM-yyyy").alias("d"))
    assert {r.d for r in fine.collect()} == {None, date("2024-05-17")}


def test_sentinel_becomes_flag_and_median(spark):
    df = spark.createDataFrame([(1, 999.0), (2, 1.0), (3, 2.0), (4, 6.0)], "k int, r double")
    table = encoding.sentinel_to_null("r").transform(df)
    filled = encoding.fit_median(table, ["r"]).transform(table)
    assert sorted(tuple(r) for r in filled.collect()) == [(1, 2.0, 1), (2, 1.0, 0), (3, 2.0, 0), (4, 6.0, 0)]


def test_threshold_is_included(spark):
    df = spark.createDataFrame([(0.30,), (0.29,)], "score double")
    assert [r.prediction for r in metrics.classify_at(df, 0.30).collect()] == [1, 0]


def test_report_without_predicted_positives(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1, rows["1"].support) == (0, 0, 0, 1)
    assert rows["accuracy"].f1 == 0.5
    assert [r.n for r in metrics.confusion(df).orderBy("label", "prediction").collect()] == [1, 0, 1, 0]


@pytest.mark.parametrize("num, den, expected", [(1.0, 0.0, 7.0), (float("nan"), 1.0, 7.0), (None, 1.0, 7.0),
                                                (float("inf"), 1.0, 7.0), (1.0, 4.0, 0.25)])
def test_safe_ratio(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "n double, d double")
    assert df.select(numbers.safe_ratio(F.col("n"), F.col("d"), 7)).first()[0] == expected


def test_instalment(spark):
    assert one(spark, lending.emi(F.lit(1200), F.lit(0.0), F.lit(12))) == 100
    assert one(spark, lending.emi(F.lit(100000), F.lit(12.0), F.lit(12))) == pytest.approx(8884.878868, abs=1e-6)


def test_labels(spark):
    assert one(spark, labels.normalize_label(F.lit("essential_expenses"))) == "Essential"
    assert one(spark, labels.normalize_label(F.lit("loan_disbursement"))) == "Loan_disbursement"
    assert one(spark, labels.padded_id("CUST", F.lit(7))) == "CUST00007"
    assert one(spark, labels.padded_id("CUST", F.lit(1234567))) == "CUST1234567"
    assert one(spark, labels.contains_safe(F.lit(None).cast("string"), "x")) is False
    assert one(spark, labels.postcode_flag(F.lit("400001"))) == 1


def test_whole_units_keep_cents(spark):
    df = spark.sql("select cast(12.34 as decimal(18,2)) as a, 1.5D as b")
    col, unit = numbers.whole_units(df, "a")
    assert df.select(col).first()[0] == 1234 and unit == 100
    assert numbers.whole_units(df, "b")[1] == 1
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert numbers.whole_units(df, "a")[1] == 1
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_overflowing_money_raises(spark):
    df = spark.sql(
        "select 'c' as customer_id, date'2024-01-01' as transaction_date, "
        "cast(9e15 as decimal(18,2)) as amount, 'credit' as type, 'x' as description, 'Income' as category from range(20)"
    )
    with pytest.raises(PySparkException, match="overflow|OVERFLOW"):
        transactions.daily_rollup(df).collect()


def test_training_view_has_seventy_columns():
    names = [*training.RAW_COLUMNS, *training.RAW_PREFIXED, *training.CUSTOMER_COLUMNS, *training.FEATURE_COLUMNS]
    assert len(names) == 70
