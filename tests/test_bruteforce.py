"""Feature jobs against a plain day-by-day computation, on awkward random data with one very heavy customer."""

import datetime as dt
import math
import random
import statistics
from collections import defaultdict

import pytest

from creditloom.operators import timegrid, transactions

LABELS = ["Salary", "Bonus", "Rent Payment", "Loan EMI Deduction", "Overdraft Fee", "Cheque Bounce Charge",
          "ATM Withdrawal", "Transfer to Savings", "Investment", None]
GROUPS = ["Income", "Essential", "Discretionary", "Transfers", None]


def months_before(day, n):
    """Same day n months earlier, or that month's last day."""
    index = day.year * 12 + day.month - 1 - n
    year, month = divmod(index, 12)
    last = (dt.date(year + (month == 11), (month + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def month_of(day):
    return day.year * 12 + day.month


def expected(anchor, rows):
    past = sorted((r for r in rows if r[0] <= anchor), key=lambda r: r[0])
    if not past:
        return dict.fromkeys(transactions.TRANSACTION_FEATURES, 0)
    half = [r for r in past if r[0] >= months_before(anchor, 6)]
    year = [r for r in past if r[0] >= months_before(anchor, 12)]

    def grid(test):
        sums = [0.0] * 6
        for r in half:
            back = month_of(anchor) - month_of(r[0])
            if test(r) and back < 6:
                sums[back] += r[1]
        return sums

    credits = grid(lambda r: r[2] == "credit")
    essential = sum(grid(lambda r: r[4] == "Essential")) / 6
    discretionary = sum(grid(lambda r: r[4] == "Discretionary")) / 6
    incomes = [r for r in year if r[4] == "Income"]
    gaps = [(b[0] - a[0]).days for a, b in zip(incomes, incomes[1:])]

    net = defaultdict(float)
    for r in past:
        net[r[0]] += r[1] if r[2] == "credit" else -r[1]
    lows, balance, day = {}, 0.0, past[0][0]
    while day <= past[-1][0]:
        balance += net.get(day, 0.0)
        if day >= months_before(anchor, 6):
            lows[month_of(day)] = min(lows.get(month_of(day), math.inf), balance)
        day += dt.timedelta(days=1)

    salaried = any(r[3] in ("Salary", "Freelance Income") for r in incomes) and sum(c > 0 for c in credits) >= 4
    return {
        "avg_monthly_net_income_6m": sum(credits) / 6,
        "std_dev_monthly_net_income_6m": statistics.stdev(credits),
        "longest_income_gap_days_12m": max(gaps, default=0),
        "num_distinct_income_sources_6m": len({r[3] for r in half if r[4] == "Income"} - {None}),
        "has_recurring_salary_flag": int(salaried),
        "avg_monthly_essential_expenses_6m": essential,
        "avg_monthly_discretionary_expenses_6m": discretionary,
        "essential_to_discretionary_spend_ratio": essential / (discretionary + 1e-6),
        "num_recurring_bill_payments_detected": sum(r[3] in ("Rent Payment", "Loan EMI Deduction") for r in half),
        "num_overdrafts_6m": sum("Overdraft" in (r[3] or "") for r in half),
        "num_bounced_transactions_6m": sum("Bounce" in (r[3] or "") for r in half),
        "large_cash_withdrawal_frequency_6m": sum(r[3] == "ATM Withdrawal" and r[1] > 10000 for r in half),
        "avg_monthly_balance_min_6m": sum(lows.values()) / len(lows) if lows else 0,
        "avg_monthly_savings_transfers_6m": sum(r[1] for r in half if r[3] == "Transfer to Savings") / 6,
        "has_investment_transactions_flag": int(any(r[3] == "Investment" for r in half)),
        "detected_other_emis_sum": sum(r[1] for r in year if r[3] == "Loan EMI Deduction"),
    }


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    anchors = {f"c{i}": dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(366)) for i in range(60)}
    anchors |= {"c0": dt.date(2024, 8, 31), "c1": dt.date(2024, 2, 29), "c2": dt.date(2024, 3, 1)}
    rows = []
    for i, (customer, anchor) in enumerate(anchors.items()):
        # the first customer holds about a third of all rows; the last has none
        count = 900 if i == 0 else 0 if i == 59 else rng.choice([1, 2, 5, 40, 60])
        for _ in range(count):
            day = anchor + dt.timedelta(days=rng.randrange(-500, 40))
            if rng.random() < 0.15:
                day = months_before(anchor, rng.choice([0, 6, 12]))
            amount = float(rng.choice([1, 50, 10000, 10001, 400]))
            rows.append((customer, day, amount, rng.choice(["credit", "debit", None]), rng.choice(LABELS), rng.choice(GROUPS)))
    return anchors, rows


def test_transaction_features(spark, data):
    anchors, rows = data
    apps = spark.createDataFrame(
        [(c, c, a) for c, a in anchors.items()], "customer_id string, loan_id string, application_date date"
    )
    txns = spark.createDataFrame(
        rows, "customer_id string, transaction_date date, amount double, type string, description string, category string"
    ).repartition(5)
    found = {r.customer_id: r for r in transactions.transaction_features(apps, txns).collect()}
    assert set(found) == set(anchors)
    by_customer = defaultdict(list)
    for customer, *rest in rows:
        by_customer[customer].append(tuple(rest))
    for customer, anchor in anchors.items():
        for name, value in expected(anchor, by_customer[customer]).items():
            assert found[customer][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (customer, anchor, name)


def test_income_sources_of_one_customer_with_many_descriptions(spark):
    """One customer holds a third of the rows, each with its own text."""
    anchor = dt.date(2024, 8, 15)
    many = [("hot", anchor - dt.timedelta(days=i % 300), f"text {i}", "Income") for i in range(3000)]
    rest = [(f"c{i}", anchor - dt.timedelta(days=i % 250), f"text {i % 3}", "Income") for i in range(6000)]
    txns = spark.createDataFrame(
        many + rest, "customer_id string, transaction_date date, description string, category string"
    )
    anchors = spark.createDataFrame(
        [(c, anchor) for c in {r[0] for r in many + rest}], "customer_id string, anchor_date date"
    )
    counts = {r.customer_id: r[1] for r in transactions.income_sources(txns, anchors).collect()}
    start = months_before(anchor, 6)
    assert counts["hot"] == len({r[2] for r in many if r[1] >= start})
    assert sum(counts.values()) == len({(r[0], r[2]) for r in many + rest if r[1] >= start})


def test_daily_and_forward_balances(spark):
    days = spark.createDataFrame(
        [("c", dt.date(2024, 1, 1), 5.0), ("c", dt.date(2024, 1, 4), -2.0)],
        "customer_id string, day date, signed_amount double",
    )
    balances = timegrid.running_balance(days)
    daily = [(r.day.day, r.balance) for r in timegrid.daily_balance(balances).orderBy("day").collect()]
    assert daily == [(1, 5.0), (2, 5.0), (3, 5.0), (4, 3.0)]
    moments = spark.createDataFrame(
        [("c", dt.date(2023, 12, 31)), ("c", dt.date(2024, 1, 4)), ("c", dt.date(2024, 6, 1)), ("d", dt.date(2024, 1, 1))],
        "customer_id string, at date",
    )
    known = timegrid.carry_forward(balances, moments, "at").orderBy("customer_id", "at").collect()
    assert [r.balance for r in known] == [None, 3.0, 3.0, None]
