"""Feature queries: credit accounts, transactions, time grids, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.catalog import bindings as b
from creditloom.catalog.kit import Catalog, comparable
from creditloom.functions.dates import in_window, months_back
from creditloom.functions.labels import contains_safe
from creditloom.functions.lending import signed_amount
from creditloom.functions.numbers import whole_units
from creditloom.operators import assemble as asm
from creditloom.operators import credit as cr
from creditloom.operators import timegrid as tg
from creditloom.operators import transactions as tx

catalog = Catalog()

# ---------------------------------------------------------------- checking SQL, written apart from the Spark design

ANCHORS = "anchors as (select customer_id, min(application_date) as anchor_date from applications group by customer_id)"

# every transaction up to the anchor, with the flags of the trailing windows
DATED = f"""{ANCHORS}, dated as (
 select t.*, a.anchor_date,
  t.transaction_date >= cast(a.anchor_date - interval 6 month as date) as in6,
  t.transaction_date >= cast(a.anchor_date - interval 12 month as date) as in12,
  (year(a.anchor_date) - year(t.transaction_date)) * 12 + month(a.anchor_date) - month(t.transaction_date) as back
 from transactions t join anchors a on t.customer_id = a.customer_id and t.transaction_date <= a.anchor_date)"""

# dense grid by generating the months and joining the sums to them
GRID = """grid as (select a.customer_id, m.back from anchors a, (select unnest(range(6)) as back) m),
 grid_sums as (
 select g.customer_id, g.back,
  coalesce(sum(case when d.type = 'credit' then d.amount end), 0) as credit,
  coalesce(sum(case when d.category = 'Essential' then d.amount end), 0) as essential,
  coalesce(sum(case when d.category = 'Discretionary' then d.amount end), 0) as discretionary
 from grid g left join dated d on g.customer_id = d.customer_id and g.back = d.back and d.in6
 group by g.customer_id, g.back),
 grid_stats as (
 select customer_id, cast(sum(credit) as double) / 6 as income_mean, stddev_samp(cast(credit as double)) as income_std,
  count(case when credit > 0 then 1 end) as income_months,
  cast(sum(essential) as double) / 6 as essential_mean, cast(sum(discretionary) as double) / 6 as discretionary_mean
 from grid_sums group by customer_id)"""

# balance per calendar day by generating every day of the series
DAILY = """nets as (
 select customer_id, transaction_date as day, sum(case when type = 'credit' then amount else -amount end) as net
 from dated group by customer_id, transaction_date),
 ends as (
 select customer_id, day, sum(net) over (partition by customer_id order by day) as balance,
  lead(day) over (partition by customer_id order by day) as following from nets),
 days as (
 select customer_id, cast(unnest(generate_series(day, coalesce(following - 1, day), interval 1 day)) as date) as day,
  balance from ends),
 lows as (
 select d.customer_id, date_trunc('month', d.day) as month, min(d.balance) as low
 from days d join anchors a on d.customer_id = a.customer_id
 where d.day >= cast(a.anchor_date - interval 6 month as date)
 group by d.customer_id, date_trunc('month', d.day)),
 low_means as (select customer_id, cast(sum(low) as double) / count(*) as low_mean from lows group by customer_id)"""

GAPS = """gaps as (
 select customer_id, max(date_diff('day', earlier, transaction_date)) as gap from (
  select customer_id, transaction_date,
   lag(transaction_date) over (partition by customer_id order by transaction_date) as earlier
  from dated where category = 'Income' and in12) e group by customer_id)"""

COUNTS = """counts as (
 select customer_id,
  count(distinct case when in6 and category = 'Income' then description end) as sources,
  count(case when in12 and category = 'Income' and description in ('Salary', 'Freelance Income') then 1 end) as salaries,
  count(case when in6 and description in ('Rent Payment', 'Loan EMI Deduction') then 1 end) as bills,
  count(case when in6 and description like '%Overdraft%' then 1 end) as overdrafts,
  count(case when in6 and description like '%Bounce%' then 1 end) as bounces,
  count(case when in6 and description = 'ATM Withdrawal' and amount > 10000 then 1 end) as large_cash,
  cast(coalesce(sum(case when in6 and description = 'Transfer to Savings' then amount end), 0) as double) as savings,
  count(case when in6 and description = 'Investment' then 1 end) as investments,
  cast(coalesce(sum(case when in12 and description = 'Loan EMI Deduction' then amount end), 0) as double) as emis
 from dated group by customer_id)"""

TXN_FEATURES = f"""{DATED}, {GRID}, {DAILY}, {GAPS}, {COUNTS}, txn_features as (
 select a.customer_id, g.income_mean as avg_monthly_net_income_6m, g.income_std as std_dev_monthly_net_income_6m,
  cast(coalesce(p.gap, 0) as integer) as longest_income_gap_days_12m,
  coalesce(c.sources, 0) as num_distinct_income_sources_6m,
  cast(case when c.salaries > 0 and g.income_months >= 4 then 1 else 0 end as integer) as has_recurring_salary_flag,
  g.essential_mean as avg_monthly_essential_expenses_6m,
  g.discretionary_mean as avg_monthly_discretionary_expenses_6m,
  g.essential_mean / (g.discretionary_mean + 1e-6) as essential_to_discretionary_spend_ratio,
  coalesce(c.bills, 0) as num_recurring_bill_payments_detected, coalesce(c.overdrafts, 0) as num_overdrafts_6m,
  coalesce(c.bounces, 0) as num_bounced_transactions_6m,
  coalesce(c.large_cash, 0) as large_cash_withdrawal_frequency_6m,
  coalesce(l.low_mean, 0) as avg_monthly_balance_min_6m, coalesce(c.savings, 0) / 6 as avg_monthly_savings_transfers_6m,
  cast(case when c.investments > 0 then 1 else 0 end as integer) as has_investment_transactions_flag,
  coalesce(c.emis, 0) as detected_other_emis_sum
 from anchors a join grid_stats g on a.customer_id = g.customer_id
  left join low_means l on a.customer_id = l.customer_id left join gaps p on a.customer_id = p.customer_id
  left join counts c on a.customer_id = c.customer_id)"""

CREDIT_FEATURES = """kept as (
 select * from credit_accounts where customer_id in (select customer_id from applications where has_credit_history = 1)),
 ranked as (
 select customer_id, credit_score, row_number() over (partition by customer_id order by account_open_date, credit_score)
  as place from kept where credit_score is not null),
 credit_features as (
 select k.customer_id, max(r.credit_score) as credit_score,
  count(distinct account_id) as num_credit_accounts_total,
  count(case when account_status = 'Active' then 1 end) as num_credit_accounts_active,
  cast(floor(date_diff('day', min(account_open_date), date '2024-12-31') / 30.0) as bigint)
   as oldest_account_age_months,
  cast(floor(date_diff('day', max(account_open_date), date '2024-12-31') / 30.0) as bigint)
   as newest_account_age_months,
  cast(sum(sanctioned_limit) as double) as total_sanctioned_limit,
  cast(sum(current_balance) as double) as total_outstanding_balance,
  cast(sum(num_defaults_total) as bigint) as num_defaults_reported_total,
  cast(sum(num_settled_total) as bigint) as num_settled_accounts_total,
  max(max_dpd_past_24m) as max_dpd_past_24m,
  count(distinct case when account_type = 'Credit Card' and account_status = 'Active' then account_id end)
   as num_revolving_accounts_active,
  case when sum(sanctioned_limit) = 0 then 0
   else cast(sum(current_balance) as double) / cast(sum(sanctioned_limit) as double) end
   as overall_credit_utilization_ratio,
  (floor(date_diff('day', min(account_open_date), date '2024-12-31') / 30.0)
   + floor(date_diff('day', max(account_open_date), date '2024-12-31') / 30.0)) / 2 as avg_account_age_months,
  cast(case when sum(num_defaults_total) > 0 then 1 else 0 end as integer) as ever_defaulted_flag,
  cast(sum(num_30_dpd_last_6m) as bigint) as num_30_dpd_last_6m,
  cast(sum(num_90_dpd_last_12m) as bigint) as num_90_dpd_last_12m
 from kept k join ranked r on k.customer_id = r.customer_id and r.place = 1 group by k.customer_id)"""

_ROUNDED = {
    "total_sanctioned_limit", "total_outstanding_balance", "overall_credit_utilization_ratio",
    "avg_account_age_months", "avg_monthly_net_income_6m", "std_dev_monthly_net_income_6m",
    "avg_monthly_essential_expenses_6m", "avg_monthly_discretionary_expenses_6m",
    "essential_to_discretionary_spend_ratio", "avg_monthly_balance_min_6m", "avg_monthly_savings_transfers_6m",
    "detected_other_emis_sum", *asm.COMPOSITES,
}


def shown(names, digits: int = 4, prefix: str = "") -> str:
    """Select list in which the real-valued features are rounded."""
    return ", ".join(
        f"round({prefix}{n}, {digits}) as {n}" if n in _ROUNDED else f"{prefix}{n} as {n}" for n in names
    )


APPLICATION_MONEY = (
    "monthly_gross_income", "declared_monthly_expenses", "loan_amount_requested", "emi_requested", "collateral_value",
    "other_emi_declared",
)
APPLICATION_RATIOS = ("loan_to_value_ratio", "debt_service_ratio_declared")
APPLICATION_PLAIN = (
    "customer_id", "loan_id", "age", "gender", "marital_status", "education_level", "num_dependents",
    "residential_status", "time_at_current_address_months", "pincode", "is_urban_residence", "employment_type",
    "time_at_current_job_months", "loan_term_months", "loan_purpose", "collateral_flag", "has_credit_history",
    "is_default",
)

COMPOSED = f"""joined as (
 select p.*, {", ".join(f"c.{n}" for n in cr.CREDIT_FEATURES)}, {", ".join(f"x.{n}" for n in tx.TRANSACTION_FEATURES)}
 from applications p left join credit_features c on p.customer_id = c.customer_id
  left join txn_features x on p.customer_id = x.customer_id),
 obliged as (
 select *, case when avg_monthly_net_income_6m > 0 then avg_monthly_net_income_6m
   else cast(monthly_gross_income as double) end as effective_monthly_income,
  cast(emi_requested as double) + cast(other_emi_declared as double) + detected_other_emis_sum
   as total_monthly_emi_obligations from joined),
 engineered as (
 select {", ".join((*APPLICATION_PLAIN, *APPLICATION_RATIOS))},
  {", ".join(f"cast({n} as double) as {n}" for n in APPLICATION_MONEY)},
  {", ".join(f"coalesce({n}, 0) as {n}" for n in (*cr.CREDIT_FEATURES, *tx.TRANSACTION_FEATURES))},
  effective_monthly_income, total_monthly_emi_obligations,
  case when effective_monthly_income = 0 then 999 else total_monthly_emi_obligations / effective_monthly_income end
   as debt_to_income_ratio_computed,
  effective_monthly_income - avg_monthly_essential_expenses_6m - total_monthly_emi_obligations
   as residual_income_after_emi
 from obliged)"""

ENGINEERED_SQL = f"""{b.common_tables("applications", "credit_accounts", "transactions")},
 {CREDIT_FEATURES}, {TXN_FEATURES}, {COMPOSED}"""


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with all 36 features."""
    apps = b.applications(spark, sf_dir)
    return asm.assemble(
        apps,
        cr.credit_features(apps, b.credit_accounts(spark, sf_dir)),
        tx.transaction_features(apps, b.transactions(spark, sf_dir)),
    )


# ---------------------------------------------------------------- whole feature jobs


@catalog.add(
    "credit_features",
    f"""{b.common_tables("applications", "credit_accounts")}, {CREDIT_FEATURES}
    select customer_id, {shown(cr.CREDIT_FEATURES)} from credit_features""",
)
def _(spark, d):
    return comparable(cr.credit_features(b.applications(spark, d), b.credit_accounts(spark, d)))


@catalog.add(
    "transaction_features",
    f"""{b.common_tables("applications", "transactions")}, {TXN_FEATURES}
    select customer_id, {shown(tx.TRANSACTION_FEATURES)} from txn_features""",
)
def _(spark, d):
    return comparable(tx.transaction_features(b.applications(spark, d), b.transactions(spark, d)))


@catalog.add(
    "engineered_features",
    f"""{ENGINEERED_SQL} select {", ".join(APPLICATION_PLAIN)},
    {", ".join(f"round({n}, 4) as {n}" for n in (*APPLICATION_MONEY, *APPLICATION_RATIOS))},
    {shown(asm.ENGINEERED)} from engineered""",
)
def _(spark, d):
    return comparable(engineered(spark, d))


# ---------------------------------------------------------------- single operators on accounts

_KEPT = f"{b.common_tables('applications', 'credit_accounts')}, {CREDIT_FEATURES}"


def _credit_part(name: str, columns: list[str]):
    @catalog.add(name, f"{_KEPT} select customer_id, {shown(columns)} from credit_features")
    def _(spark, d):
        features = cr.credit_features(b.applications(spark, d), b.credit_accounts(spark, d))
        return comparable(features.select("customer_id", *columns))


_credit_part("distinct_accounts", ["num_credit_accounts_total"])
_credit_part("active_accounts", ["num_credit_accounts_active"])
_credit_part("account_age", ["oldest_account_age_months", "newest_account_age_months"])
_credit_part("exposure_sums", ["total_sanctioned_limit", "total_outstanding_balance", "num_defaults_reported_total",
                               "num_settled_accounts_total"])
_credit_part("max_dpd", ["max_dpd_past_24m"])
_credit_part("revolving_active", ["num_revolving_accounts_active"])
_credit_part("delinquency_sums", ["num_30_dpd_last_6m", "num_90_dpd_last_12m"])
_credit_part("account_midpoint", ["avg_account_age_months", "ever_defaulted_flag"])
_credit_part("safe_ratio", ["overall_credit_utilization_ratio"])


@catalog.add(
    "first_score",
    f"""{b.common_tables("credit_accounts")} select customer_id, credit_score from (
     select customer_id, credit_score, row_number() over (partition by customer_id
      order by account_open_date, credit_score) as place from credit_accounts) r where place = 1""",
)
def _(spark, d):
    return cr.first_score(b.credit_accounts(spark, d))


@catalog.add(
    "with_history",
    f"""{b.common_tables("applications", "credit_accounts")} select customer_id, account_id, account_status
    from credit_accounts
    where customer_id in (select customer_id from applications where has_credit_history = 1)""",
)
def _(spark, d):
    kept = cr.with_history(b.credit_accounts(spark, d), b.applications(spark, d))
    return kept.select("customer_id", "account_id", "account_status")


# ---------------------------------------------------------------- single operators on transactions

_BOUND = b.common_tables("applications", "transactions")
_TXN = f"{_BOUND}, {TXN_FEATURES}"


def _txn_part(name: str, columns: list[str]):
    @catalog.add(name, f"{_TXN} select customer_id, {shown(columns)} from txn_features")
    def _(spark, d):
        features = tx.transaction_features(b.applications(spark, d), b.transactions(spark, d))
        return comparable(features.select("customer_id", *columns))


_txn_part("flagged_counts", ["num_recurring_bill_payments_detected", "num_overdrafts_6m",
                             "num_bounced_transactions_6m", "large_cash_withdrawal_frequency_6m"])
_txn_part("investment_flag", ["has_investment_transactions_flag"])
_txn_part("savings_and_emi", ["avg_monthly_savings_transfers_6m", "detected_other_emis_sum"])
_txn_part("month_mean_std", ["avg_monthly_net_income_6m", "std_dev_monthly_net_income_6m"])
_txn_part("recurring_salary", ["has_recurring_salary_flag"])
_txn_part("eps_ratio", ["essential_to_discretionary_spend_ratio"])


def _unit(spark: SparkSession, d: str) -> int:
    """What the amounts of the daily table count."""
    return whole_units(b.transactions(spark, d), "amount")[1]


def _history(spark: SparkSession, d: str, how: str = "left") -> DataFrame:
    anchors = tg.anchor_dates(b.applications(spark, d))
    return tg.point_in_time(anchors, tx.daily_rollup(b.transactions(spark, d)), how)


@catalog.add(
    "income_sources",
    f"""{_BOUND}, {DATED} select customer_id, count(distinct description) as num_distinct_income_sources_6m
    from dated where in6 and category = 'Income' group by customer_id""",
)
def _(spark, d):
    return tx.income_sources(b.transactions(spark, d), tg.anchor_dates(b.applications(spark, d)))


@catalog.add(
    "point_in_time",
    f"""{_BOUND}, {DATED} select customer_id, strftime(anchor_date, '%Y-%m-%d') as anchor_date,
    strftime(transaction_date, '%Y-%m-%d') as day, cast(count(*) as bigint) as n,
    cast(sum(amount) as double) as amount from dated group by customer_id, anchor_date, transaction_date""",
)
def _(spark, d):
    """Transactions seen at the application date, by day: nothing from after it."""
    days = b.transactions(spark, d).groupBy("customer_id", F.col("transaction_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )
    return comparable(tg.point_in_time(tg.anchor_dates(b.applications(spark, d)), days, "inner"))


@catalog.add(
    "point_in_time_range",
    f"""{_BOUND}, {DATED} select customer_id, count(case when in6 then 1 end) as rows_6m,
    count(case when in12 then 1 end) as rows_12m, count(*) as rows_before from dated group by customer_id""",
)
def _(spark, d):
    days = b.transactions(spark, d).groupBy("customer_id", F.col("transaction_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    history = tg.point_in_time(tg.anchor_dates(b.applications(spark, d)), days, "inner")

    def rows(months: int):
        inside = in_window(F.col("day"), F.col("anchor_date"), months)
        return F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias(f"rows_{months}m")

    return history.groupBy("customer_id").agg(rows(6), rows(12), F.sum("n").alias("rows_before"))


@catalog.add(
    "zero_fill_left",
    f"""{_BOUND}, {DATED} select a.customer_id, count(d.customer_id) as n_transactions,
    cast(coalesce(sum(d.amount), 0) as double) as amount
    from anchors a left join dated d on a.customer_id = d.customer_id group by a.customer_id""",
)
def _(spark, d):
    days = b.transactions(spark, d).groupBy("customer_id", F.col("transaction_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )
    history = tg.point_in_time(tg.anchor_dates(b.applications(spark, d)), days)
    return comparable(
        history.groupBy("customer_id").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_transactions"),
            F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"),
        )
    )


@catalog.add(
    "attach_features",
    f"""{ENGINEERED_SQL} select loan_id, customer_id, {shown(("credit_score", *tx.TRANSACTION_FEATURES))} from joined""",
)
def _(spark, d):
    """Applications with features, before any fill: customers without a history keep nulls."""
    apps = b.applications(spark, d)
    joined = asm.attach_features(
        apps,
        cr.credit_features(apps, b.credit_accounts(spark, d)),
        tx.transaction_features(apps, b.transactions(spark, d)),
    )
    return comparable(joined.select("loan_id", "customer_id", "credit_score", *tx.TRANSACTION_FEATURES))


def _window_and_month():
    day, anchor = F.col("day"), F.col("anchor_date")
    return in_window(day, anchor, 6), months_back(day, anchor)


@catalog.add(
    "month_sums",
    f"""{_BOUND}, {DATED}, {GRID} select customer_id, cast(back as integer) as months_back,
    round(cast(credit as double), 2) as credit, round(cast(essential as double), 2) as essential,
    round(cast(discretionary as double), 2) as discretionary from grid_sums""",
)
def _(spark, d):
    """Dense grid: six rows per customer and one column per kind of amount."""
    inside, back = _window_and_month()
    kinds = ("credit", "essential", "discretionary")
    sums = [
        F.struct(F.lit(i).alias("months_back"), *[grid[i].cast("double").alias(k) for k, grid in grids])
        for grids in [[(k, tg.month_grid(F.col(k), inside, back, 6)) for k in kinds]]
        for i in range(6)
    ]
    wide = _history(spark, d).groupBy("customer_id").agg(F.array(*sums).alias("grid"))
    rows = wide.select("customer_id", F.inline("grid"))
    return comparable(rows.withColumns({k: F.col(k).cast("double") / _unit(spark, d) for k in kinds}), 2)


@catalog.add(
    "month_grid",
    f"""{_BOUND}, {DATED}, {GRID} select customer_id,
    {", ".join(f"round(cast(sum(case when back = {i} then credit end) as double), 2) as credit_{i}" for i in range(6))}
    from grid_sums group by customer_id""",
)
def _(spark, d):
    unit = _unit(spark, d)
    grid = [c.cast("double") / unit for c in tg.month_grid(F.col("credit"), *_window_and_month(), 6)]
    return comparable(
        _history(spark, d).groupBy("customer_id").agg(*[c.alias(f"credit_{i}") for i, c in enumerate(grid)]), 2
    )


@catalog.add(
    "longest_gap",
    f"""{_BOUND}, {DATED}, {GAPS} select a.customer_id, cast(coalesce(p.gap, 0) as integer)
    as longest_income_gap_days_12m from anchors a left join gaps p on a.customer_id = p.customer_id""",
)
def _(spark, d):
    return tg.longest_gap(_history(spark, d), F.col("incomes") > 0, 12)


@catalog.add(
    "running_balance",
    f"""{_BOUND} select customer_id, strftime(transaction_date, '%Y-%m-%d') as day, round(cast(sum(net) over
    (partition by customer_id order by transaction_date) as double), 2) as balance from (
     select customer_id, transaction_date, sum(case when type = 'credit' then amount else -amount end) as net
     from transactions group by customer_id, transaction_date) n""",
)
def _(spark, d):
    days = tg.daily_net(b.transactions(spark, d), signed_amount(F.col("amount"), F.col("type")))
    return comparable(tg.running_balance(days).select("customer_id", "day", "balance"), 2)


def _seen_balances(spark: SparkSession, d: str) -> DataFrame:
    days = tg.daily_net(b.transactions(spark, d), signed_amount(F.col("amount"), F.col("type")))
    return tg.running_balance(tg.point_in_time(tg.anchor_dates(b.applications(spark, d)), days, "inner"))


@catalog.add(
    "daily_balance",
    f"""{_BOUND}, {DATED}, {DAILY} select customer_id, cast(count(*) as bigint) as n_days,
    round(cast(min(balance) as double), 2) as lowest, round(cast(max(balance) as double), 2) as highest,
    round(cast(sum(balance) as double), 2) as balance_days from days group by customer_id""",
)
def _(spark, d):
    """Every calendar day of every series, summed up per customer."""
    daily = tg.daily_balance(_seen_balances(spark, d))
    return comparable(
        daily.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("n_days"),
            F.min("balance").alias("lowest"),
            F.max("balance").alias("highest"),
            F.sum("balance").alias("balance_days"),
        ),
        2,
    )


@catalog.add(
    "trailing_balance",
    f"""{_BOUND}, {DATED}, {DAILY} select d.customer_id, cast(count(*) as bigint) as n_days,
    strftime(min(d.day), '%Y-%m-%d') as first_day, round(cast(min(d.balance) as double), 2) as lowest
    from days d join anchors a on d.customer_id = a.customer_id
    where d.day >= cast(a.anchor_date - interval 6 month as date) group by d.customer_id""",
)
def _(spark, d):
    cut = tg.trailing_balance(_seen_balances(spark, d), 6)
    return comparable(
        cut.groupBy("customer_id").agg(
            F.sum(F.datediff("valid_to", "valid_from") + 1).alias("n_days"),
            F.min("valid_from").alias("first_day"),
            F.min("balance").alias("lowest"),
        ),
        2,
    )


@catalog.add(
    "min_balance",
    f"""{_BOUND}, {DATED}, {DAILY} select a.customer_id, round(coalesce(l.low_mean, 0), 4)
    as avg_monthly_balance_min_6m from anchors a left join low_means l on a.customer_id = l.customer_id""",
)
def _(spark, d):
    days = tg.daily_net(b.transactions(spark, d), signed_amount(F.col("amount"), F.col("type")))
    return comparable(tg.min_balance(tg.point_in_time(tg.anchor_dates(b.applications(spark, d)), days)))


@catalog.add(
    "carry_forward",
    f"""{_BOUND}, {ANCHORS}, moments as (select customer_id, last_day(cast(anchor_date - interval (m) month as date))
     as month_end from anchors, (select unnest(range(1, 7)) as m) r),
    nets as (select customer_id, transaction_date as day,
     sum(case when type = 'credit' then amount else -amount end) as net from transactions group by all),
    ends as (select customer_id, day, sum(net) over (partition by customer_id order by day) as balance from nets)
    select m.customer_id, strftime(m.month_end, '%Y-%m-%d') as month_end,
    round(cast(e.balance as double), 2) as balance
    from moments m asof left join ends e on m.customer_id = e.customer_id and m.month_end >= e.day""",
)
def _(spark, d):
    """Balance at the last six month ends before each application."""
    days = tg.daily_net(b.transactions(spark, d), signed_amount(F.col("amount"), F.col("type")))
    anchors = tg.anchor_dates(b.applications(spark, d))
    moments = anchors.select("customer_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("m"), "anchor_date").select(
        "customer_id", F.last_day(F.add_months("anchor_date", -F.col("m"))).alias("month_end")
    )
    return comparable(tg.carry_forward(tg.running_balance(days), moments, "month_end"), 2)


@catalog.add(
    "anchor_dates",
    f"""{b.common_tables("applications")}, {ANCHORS}
    select customer_id, strftime(anchor_date, '%Y-%m-%d') as anchor_date from anchors""",
)
def _(spark, d):
    return comparable(tg.anchor_dates(b.applications(spark, d)))


@catalog.add(
    "trailing_windows",
    f"""{b.common_tables("applications")} select loan_id,
    strftime(cast(application_date - interval 6 month as date), '%Y-%m-%d') as start_6m,
    strftime(cast(application_date - interval 12 month as date), '%Y-%m-%d') as start_12m from applications""",
)
def _(spark, d):
    date = F.col("application_date")
    return comparable(
        b.applications(spark, d).select(
            "loan_id", F.add_months(date, -6).alias("start_6m"), F.add_months(date, -12).alias("start_12m")
        )
    )


# ---------------------------------------------------------------- predicates


@catalog.add(
    "conjunction_filter",
    f"""{b.common_tables("credit_accounts")} select account_id, customer_id, account_type, account_status
    from credit_accounts where account_type = 'Credit Card' and account_status = 'Active'""",
)
def _(spark, d):
    return (
        b.credit_accounts(spark, d)
        .where((F.col("account_type") == cr.REVOLVING) & (F.col("account_status") == cr.ACTIVE))
        .select("account_id", "customer_id", "account_type", "account_status")
    )


@catalog.add(
    "membership_filter",
    f"""{b.common_tables("transactions")} select customer_id, description, count(*) as n from transactions
    where description in ('Rent Payment', 'Loan EMI Deduction') group by customer_id, description""",
)
def _(spark, d):
    bills = b.transactions(spark, d).where(F.col("description").isin(*tx.TransactionRules().recurring_bills))
    return bills.groupBy("customer_id", "description").agg(F.count(F.lit(1)).alias("n"))


@catalog.add(
    "contains_safe",
    f"""{b.common_tables("transactions")} select description, coalesce(description like '%Overdraft%', false)
    as is_overdraft, coalesce(description like '%Bounce%', false) as is_bounce, count(*) as n
    from transactions group by all""",
)
def _(spark, d):
    rules, text = tx.TransactionRules(), F.col("description")
    marked = b.transactions(spark, d).select(
        "description",
        contains_safe(text, rules.overdraft).alias("is_overdraft"),
        contains_safe(text, rules.bounce).alias("is_bounce"),
    )
    return marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("n"))


@catalog.add(
    "large_withdrawals",
    f"""{b.common_tables("transactions")} select customer_id, count(*) as n,
    round(cast(sum(amount) as double), 2) as amount from transactions
    where description = 'ATM Withdrawal' and amount > 10000 group by customer_id""",
)
def _(spark, d):
    rules = tx.TransactionRules()
    large = (F.col("description") == rules.cash) & (F.col("amount") > rules.large_cash)
    found = b.transactions(spark, d).where(large).groupBy("customer_id")
    return comparable(found.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")), 2)
