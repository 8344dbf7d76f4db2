"""Scalar and row-rule queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creditloom.catalog import bindings as b
from creditloom.catalog.features import (
    APPLICATION_PLAIN,
    ENGINEERED_SQL,
    engineered,
    shown,
)
from creditloom.catalog.kit import Catalog, comparable
from creditloom.functions import dates, labels, lending
from creditloom.operators import assemble as asm
from creditloom.operators import credit as cr
from creditloom.operators import encoding as en
from creditloom.operators import selection as sel
from creditloom.operators.profiling import ranges
from creditloom.operators.skew import spread_join
from creditloom.plans.jobs import application_metrics
from creditloom.session import scratch_dir, stored
from creditloom.sources.files import read_table, write_csv, write_parquet

catalog = Catalog()

APPS = b.common_tables("applications")
ACCOUNTS = b.common_tables("credit_accounts")
TXNS = b.common_tables("transactions")

# ---------------------------------------------------------------- sources and sinks

_CSV_ACCOUNTS = (
    "customer_id long, credit_score int, account_id long, account_open_date date, account_type string, "
    "sanctioned_limit double, current_balance double, max_dpd_past_24m int, num_30_dpd_last_6m int, "
    "num_90_dpd_last_12m int, num_defaults_total int, num_settled_total int, account_status string"
)
_ACCOUNT_ROWS = f"""{ACCOUNTS} select customer_id, credit_score, account_id,
 strftime(account_open_date, '%Y-%m-%d') as account_open_date, account_type,
 round(cast(sanctioned_limit as double), 2) as sanctioned_limit,
 round(cast(current_balance as double), 2) as current_balance, max_dpd_past_24m, num_30_dpd_last_6m,
 num_90_dpd_last_12m, num_defaults_total, num_settled_total, account_status from credit_accounts"""


@catalog.add("csv_round_trip", _ACCOUNT_ROWS)
def _(spark, d):
    """Accounts written as CSV with a header and scanned back with a stated schema."""
    path = scratch_dir(spark, "accounts-csv")
    write_csv(b.credit_accounts(spark, d), path)
    return comparable(read_table(spark, path, _CSV_ACCOUNTS), 2)


@catalog.add(
    "csv_scan",
    f"""{APPS} select loan_purpose, count(*) as n, count(distinct customer_id) as n_customers,
    round(cast(sum(monthly_gross_income) as double), 2) as income from applications group by loan_purpose""",
)
def _(spark, d):
    """A wide CSV scan that reads only the columns it needs."""
    path = scratch_dir(spark, "applications-csv")
    apps = b.applications(spark, d)
    write_csv(apps, path)
    scanned = read_table(spark, path, apps.schema)
    return comparable(
        scanned.groupBy("loan_purpose").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("customer_id").alias("n_customers"),
            F.sum("monthly_gross_income").alias("income"),
        ),
        2,
    )


@catalog.add("parquet_round_trip", _ACCOUNT_ROWS)
def _(spark, d):
    path = scratch_dir(spark, "accounts-parquet")
    write_parquet(b.credit_accounts(spark, d), path)
    return comparable(read_table(spark, path, fmt="parquet"), 2)


@catalog.add(
    "strict_date_parse",
    "select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as order_date from orders",
)
def _(spark, d):
    """Day-first text read back as dates; a bad value would stop the job."""
    written = b.table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("written")
    )
    return comparable(
        written.select("o_orderkey", dates.parse_date(F.col("written"), "dd-MM-yyyy").alias("order_date"))
    )


@catalog.add(
    "lenient_date_parse",
    """select o_orderkey, case when o_orderkey % 5 = 0 then null
    else strftime(cast(o_orderdate as date), '%Y-%m-%d') end as order_date from orders""",
)
def _(spark, d):
    """A fifth of the values is written in another format and becomes null."""
    date = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(date, "yyyy/MM")).otherwise(
        F.date_format(date, "dd-MM-yyyy")
    )
    return comparable(
        b.table(spark, d, "orders").select(
            "o_orderkey", dates.parse_date(written, "dd-MM-yyyy", strict=False).alias("order_date")
        )
    )


# ---------------------------------------------------------------- projections


@catalog.add(
    "drop_columns",
    f"""{APPS} select {", ".join(c for c in APPLICATION_PLAIN if c not in ("customer_id", "pincode"))}
    from applications""",
)
def _(spark, d):
    apps = b.applications(spark, d).select(*APPLICATION_PLAIN)
    return apps.drop("customer_id", "pincode")


@catalog.add(
    "order_columns",
    f"""{APPS} select customer_id, loan_id, age, gender, loan_purpose, is_default from applications""",
)
def _(spark, d):
    mixed = ("pincode", "is_default", "age", "gender", "loan_purpose", "loan_id", "customer_id")
    apps = b.applications(spark, d).select(*mixed)
    return sel.order_columns(apps, first=("customer_id", "loan_id"), last=("is_default",), drop=("pincode",))


@catalog.add(
    "cols_of_type",
    f"""{APPS} select sum(num_dependents)::bigint as num_dependents, sum(loan_term_months)::bigint as loan_term_months,
    sum(age)::bigint as age from applications""",
)
def _(spark, d):
    """Sums over the columns that are numbers in a mixed selection."""
    mixed = ("age", "gender", "application_date", "num_dependents", "pincode", "loan_term_months")
    apps = b.applications(spark, d).select(*mixed)
    return apps.agg(*[F.sum(c).alias(c) for c in sel.cols_of_type(apps, "number")])


@catalog.add(
    "split_features_label",
    f"""{APPS} select loan_id, round(cast(monthly_gross_income as double), 2) as monthly_gross_income, loan_purpose, is_default
    from applications""",
)
def _(spark, d):
    """Features and label taken apart, out of one scan: both parts of every row next to each other."""
    parts = sel.features_and_label(b.applications(spark, d), "is_default", "loan_id")
    income = F.round(F.col("features.monthly_gross_income").cast("double"), 2).alias("monthly_gross_income")
    return parts.select("loan_id", income, F.col("features.loan_purpose"), "is_default")


@catalog.add(
    "conditional_value",
    f"""{APPS} select loan_id, case when employment_type = 'Unemployed' then 'none' when monthly_gross_income > 5000
    then 'high' else 'low' end as income_band from applications""",
)
def _(spark, d):
    band = (
        F.when(F.col("employment_type") == lending.UNEMPLOYED, "none")
        .when(F.col("monthly_gross_income") > 5000, "high")
        .otherwise("low")
    )
    return b.applications(spark, d).select("loan_id", band.alias("income_band"))


_TO_SCALE = ("age", "loan_amount_requested", "monthly_gross_income")
_SCALED = ", ".join(
    f"round((cast({c} as double) - avg(cast({c} as double)) over ()) / stddev_pop(cast({c} as double)) over (), 4) as {c}"
    for c in _TO_SCALE
)


@catalog.add("columnwise_concat", f"{APPS} select loan_id, gender, is_default, {_SCALED} from applications")
def _(spark, d):
    """Scaled columns next to the untouched ones, on the same rows."""
    apps = b.applications(spark, d).select("loan_id", "gender", "is_default", *_TO_SCALE)
    return comparable(en.fit_standardize(apps, list(_TO_SCALE)).transform(apps))


@catalog.add("standard_scale", f"{APPS} select loan_id, {_SCALED} from applications")
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", *_TO_SCALE)
    return comparable(en.fit_standardize(apps, list(_TO_SCALE)).transform(apps))


_CANDIDATES = ["age", "num_dependents", "is_urban_residence", "loan_term_months", "collateral_flag", "is_default",
               "has_credit_history", "loan_amount_requested"]


@catalog.add(
    "scalable_columns",
    f"""{APPS}, found as ({" union all ".join(
        f"select '{c}' as column_name, min({c}) as low, max({c}) as high, count(distinct {c}) as n from applications"
        for c in _CANDIDATES if c != "num_dependents")})
    select column_name, round(cast(low as double), 4) as min, round(cast(high as double), 4) as max
    from found where n > 2""",
)
def _(spark, d):
    """Numeric columns worth scaling, with their ranges; one listed flag is left out by name."""
    apps = b.applications(spark, d).select(*_CANDIDATES)
    return comparable(ranges(apps, sel.scalable_columns(apps, exclude=("num_dependents",))))


@catalog.add(
    "transform_columns",
    f"""{APPS} select loan_id, age,
    {", ".join(f"cast(gender = '{v}' as integer) as gender_{v}" for v in ("Female", "Male", "Other"))}
    from applications""",
)
def _(spark, d):
    """Encoded columns first, the rest passed through in order."""
    apps = b.applications(spark, d).select("loan_id", "gender", "age")
    return en.fit_one_hot(apps, ["gender"], new_first=True).transform(apps)


# ---------------------------------------------------------------- sorting and sets


@catalog.add(
    "multi_key_sort",
    "select o_custkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as o_orderdate, o_orderkey from orders",
)
def _(spark, d):
    orders = b.table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date"), "o_orderkey")
    return comparable(orders.orderBy("o_custkey", "o_orderdate", "o_orderkey"))


@catalog.add(
    "entity_order",
    f"""{ACCOUNTS} select customer_id, strftime(account_open_date, '%Y-%m-%d') as opened, n, cast(date_diff('day',
    lag(account_open_date) over (partition by customer_id order by account_open_date), account_open_date) as integer)
    as days_since_previous from (
     select customer_id, account_open_date, count(*) as n from credit_accounts group by all) g""",
)
def _(spark, d):
    """Opening days in order within each customer; accounts are first counted per day, so a series stays short."""
    days = b.credit_accounts(spark, d).groupBy("customer_id", F.col("account_open_date").alias("opened")).agg(
        F.count(F.lit(1)).alias("n")
    )
    previous = F.lag("opened").over(Window.partitionBy("customer_id").orderBy("opened"))
    return comparable(days.withColumn("days_since_previous", F.datediff("opened", previous)))


@catalog.add("head_preview", f"{APPS} select loan_id, customer_id, age from applications order by loan_id limit 5")
def _(spark, d):
    return b.applications(spark, d).select("loan_id", "customer_id", "age").orderBy("loan_id").limit(5)


@catalog.add("distinct_keys", f"{TXNS} select distinct customer_id from transactions")
def _(spark, d):
    return b.transactions(spark, d).select("customer_id").distinct()


# ---------------------------------------------------------------- scalar functions

_DATE = "o_orderdate"


@catalog.add(
    "date_parts",
    """select o_orderkey, cast(month(o_orderdate) as integer) as order_month,
    cast(isodow(o_orderdate) - 1 as integer) as order_day_of_week, cast(year(o_orderdate) as integer) as order_year,
    cast(day(o_orderdate) as integer) as order_day_of_month from orders""",
)
def _(spark, d):
    parts = dates.date_parts(F.col(_DATE).cast("date"), "order")
    return b.table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@catalog.add(
    "missing_date_flag",
    """select o_orderkey, cast(case when o_orderkey % 5 = 0 then 1 else 0 end as integer) as is_date_missing
    from orders""",
)
def _(spark, d):
    written = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format(_DATE, "yyyy-MM-dd"))
    read = dates.parse_date(written, strict=False)
    return b.table(spark, d, "orders").select("o_orderkey", read.isNull().cast("int").alias("is_date_missing"))


@catalog.add(
    "month_arithmetic",
    """select o_orderkey, strftime(cast(cast(o_orderdate as date) - interval 6 month as date), '%Y-%m-%d') as six_before,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start,
    strftime(last_day(o_orderdate), '%Y-%m-%d') as month_end from orders""",
)
def _(spark, d):
    date = F.col(_DATE).cast("date")
    return comparable(
        b.table(spark, d, "orders").select(
            "o_orderkey",
            F.add_months(date, -6).alias("six_before"),
            dates.month_start_back(date, 0).alias("month_start"),
            F.last_day(date).alias("month_end"),
        )
    )


@catalog.add(
    "day_difference",
    """select o_orderkey, cast(date_diff('day', cast(o_orderdate as date), date '2000-06-15') as integer) as days,
    cast(floor(date_diff('day', cast(o_orderdate as date), date '2000-06-15') / 30.0) as bigint) as months
    from orders""",
)
def _(spark, d):
    on, date = F.lit("2000-06-15").cast("date"), F.col(_DATE).cast("date")
    return b.table(spark, d, "orders").select(
        "o_orderkey", F.datediff(on, date).alias("days"), dates.whole_months_30(on, date).alias("months")
    )


@catalog.add("iso_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as written from orders")
def _(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", dates.iso_date(F.col(_DATE)).alias("written"))


@catalog.add(
    "signed_amount",
    f"""{TXNS} select customer_id, round(cast(sum(case when type = 'credit' then amount else -amount end) as double), 2)
    as net, round(cast(sum(abs(amount)) as double), 2) as turnover from transactions group by customer_id""",
)
def _(spark, d):
    amount = F.col("amount")
    net = b.transactions(spark, d).groupBy("customer_id").agg(
        F.sum(lending.signed_amount(amount, F.col("type"))).alias("net"), F.sum(F.abs(amount)).alias("turnover")
    )
    return comparable(net, 2)


def _composite(name: str, columns: list[str]):
    @catalog.add(name, f"{ENGINEERED_SQL} select loan_id, {shown(columns)} from engineered")
    def _(spark, d):
        return comparable(engineered(spark, d).select("loan_id", *columns))


_composite("effective_income", ["effective_monthly_income"])
_composite("obligations", ["total_monthly_emi_obligations"])
_composite("debt_to_income", ["debt_to_income_ratio_computed"])
_composite("residual_income", ["residual_income_after_emi"])

_METRICS = f"""{APPS}, scored as (
 select a.*, 12 / 12.0 / 100 as monthly, 300 + (customer_id * 37) % 601 as credit_score from applications a),
 measured as (
 select *, cast(loan_amount_requested as double) * monthly * pow(1 + monthly, loan_term_months)
  / (pow(1 + monthly, loan_term_months) - 1) as instalment,
  0.05 + (case when monthly_gross_income < 30000 then 0.05 else 0 end) + (case when age < 25 then 0.03 else 0 end)
  + (case when employment_type = 'Unemployed' then 0.2 else 0 end)
  + (case when debt_service_ratio_declared > 0.6 then 0.07 else 0 end)
  + (case when has_credit_history = 0 then 0.05 else 0 end)
  + (case when has_credit_history <> 1 then 0 when credit_score < 550 then 0.15 when credit_score < 650 then 0.08
     when credit_score < 750 then 0.02 else -0.02 end) as risk from scored)"""


def _metric(name: str, columns: list[str], sql: str):
    @catalog.add(name, f"{_METRICS} select loan_id, {sql} from measured")
    def _(spark, d):
        apps = b.applications(spark, d).withColumn(
            "credit_score", (300 + (F.col("customer_id") * 37) % 601).cast("int")
        )
        return comparable(application_metrics(apps, F.lit(12.0)).select("loan_id", *columns))


_metric("instalment", ["instalment"], "round(cast(instalment as double), 4) as instalment")
_metric(
    "application_ratios",
    ["loan_to_value", "debt_service_ratio"],
    "round(loan_to_value_ratio, 4) as loan_to_value, round(debt_service_ratio_declared, 4) as debt_service_ratio",
)
_metric(
    "postcode_flag", ["is_urban"], "cast(case when cast(pincode[1] as integer) % 2 = 0 then 1 else 0 end as integer) as is_urban"
)
_metric("rule_score", ["rule_score"], "round(cast(risk as double), 4) as rule_score")
_metric(
    "application_metrics",
    ["instalment", "loan_to_value", "debt_service_ratio", "is_urban", "rule_score", "customer_label", "loan_label"],
    """round(cast(instalment as double), 4) as instalment, round(loan_to_value_ratio, 4) as loan_to_value,
    round(debt_service_ratio_declared, 4) as debt_service_ratio, is_urban_residence as is_urban,
    round(cast(risk as double), 4) as rule_score,
    'CUST' || case when customer_id < 100000 then lpad(cast(customer_id as varchar), 5, '0')
      else cast(customer_id as varchar) end as customer_label,
    'LOAN' || cast(loan_id as varchar) as loan_label""",
)


@catalog.add(
    "age_years",
    f"""{ACCOUNTS} select account_id, cast(floor(date_diff('day', account_open_date, date '2024-12-31') / 365.0) as bigint)
    as age_years from credit_accounts""",
)
def _(spark, d):
    on = F.lit("2024-12-31").cast("date")
    return b.credit_accounts(spark, d).select(
        "account_id", dates.age_years(on, F.col("account_open_date")).alias("age_years")
    )


@catalog.add(
    "normalize_label",
    """select c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as label,
    'CUST' || case when c_custkey < 100000 then lpad(cast(c_custkey as varchar), 5, '0')
      else cast(c_custkey as varchar) end as padded from customer""",
)
def _(spark, d):
    suffixed = F.concat(F.lower("c_mktsegment"), F.lit("_expenses"))
    return b.table(spark, d, "customer").select(
        "c_custkey",
        labels.normalize_label(suffixed).alias("label"),
        labels.padded_id("CUST", F.col("c_custkey")).alias("padded"),
    )


@catalog.add(
    "fill_zero",
    f"""{ENGINEERED_SQL} select loan_id, coalesce(credit_score, 0) as credit_score,
    round(coalesce(avg_account_age_months, 0), 4) as avg_account_age_months, gender from joined""",
)
def _(spark, d):
    apps = b.applications(spark, d)
    credit = cr.credit_features(apps, b.credit_accounts(spark, d))
    chosen = ("loan_id", "credit_score", "avg_account_age_months", "gender")
    joined = spread_join(apps, credit, "customer_id", "loan_id", "left").select(*chosen)
    return comparable(asm.fill_zero(joined))


_DTI = "debt_to_income_ratio_computed"


@catalog.add(
    "sentinel_to_null",
    f"""{ENGINEERED_SQL} select loan_id, round(nullif({_DTI}, 999), 4) as {_DTI},
    cast(case when {_DTI} = 999 then 1 else 0 end as integer) as {_DTI}_is_999 from engineered""",
)
def _(spark, d):
    table = engineered(spark, d).select("loan_id", _DTI)
    return comparable(en.sentinel_to_null(_DTI).transform(table))


@catalog.add(
    "median_impute",
    f"""{ENGINEERED_SQL}, marked as (select loan_id, nullif({_DTI}, 999) as {_DTI} from engineered)
    select loan_id, round(coalesce({_DTI}, (select median({_DTI}) from marked)), 4) as {_DTI} from marked""",
)
def _(spark, d):
    ratios = stored(engineered(spark, d).select("loan_id", _DTI), "ratios")
    table = en.sentinel_to_null(_DTI).transform(ratios).drop(f"{_DTI}_is_999")
    return comparable(en.fit_median(table, [_DTI]).transform(table))


@catalog.add(
    "mode_impute",
    """with parts as (select o_orderkey, case when o_orderkey % 5 = 0 then null else month(o_orderdate) end as m,
     case when o_orderkey % 5 = 0 then null else isodow(o_orderdate) - 1 end as w from orders)
    select o_orderkey, cast(coalesce(m, (select m from parts where m is not null group by m order by count(*) desc, m
     limit 1)) as integer) as order_month,
    cast(coalesce(w, (select w from parts where w is not null group by w order by count(*) desc, w limit 1)) as integer)
     as order_day_of_week from parts""",
)
def _(spark, d):
    written = F.when(F.col("o_orderkey") % 5 == 0, "unknown").otherwise(F.date_format(_DATE, "yyyy-MM-dd"))
    parts = dates.date_parts(dates.parse_date(written, strict=False), "order")
    chosen = ["order_month", "order_day_of_week"]
    table = b.table(spark, d, "orders").select("o_orderkey", *[parts[c].alias(c) for c in chosen])
    return en.fit_mode(table, chosen, cast="int").transform(table)


@catalog.add(
    "rounding",
    "select l_orderkey, sum(round_even(l_extendedprice / 1000, 0)) as thousands from lineitem group by l_orderkey",
)
def _(spark, d):
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey")
    return lines.agg(F.sum(F.bround(F.col("l_extendedprice") / 1000, 0)).alias("thousands"))


# ---------------------------------------------------------------- encoding

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_REGIONS = ("R0", "R1", "R2", "R3", "R4")


@catalog.add(
    "one_hot_full",
    f"""{APPS} select loan_id,
    {", ".join(f"cast(loan_purpose = '{v}' as integer) as loan_purpose_{v}" for v in _SEGMENTS)},
    {", ".join(f"cast(residential_status = '{v}' as integer) as residential_status_{v}" for v in _REGIONS)}
    from applications""",
)
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", "loan_purpose", "residential_status")
    return en.fit_one_hot(apps, ["loan_purpose", "residential_status"], new_first=True).transform(apps)


@catalog.add(
    "one_hot_sparse",
    f"""{APPS}, purposes as (select loan_purpose, row_number() over (order by loan_purpose) - 2 as slot
      from (select distinct loan_purpose from applications) p),
    codes as (select pincode, row_number() over (order by pincode) - 2 as slot from (select distinct pincode from applications) p),
    sizes as (select (select max(slot) + 1 from purposes) as first, (select max(slot) + 1 from codes) as second),
    slots as (select a.loan_id, first + second as places,
      [x for x in [case when p.slot >= 0 then p.slot end, case when c.slot >= 0 then first + c.slot end] if x is not null] as spots
      from applications a join purposes p on p.loan_purpose = a.loan_purpose join codes c on c.pincode = a.pincode, sizes)
    select loan_id, '(' || places || ',[' || array_to_string(spots, ',') || '],[' || array_to_string(['1.0' for x in spots], ',') || '])'
      as categories from slots""",
)
def _(spark, d):
    """Postcodes, of which nearly every application has its own, beside loan purposes in one sparse vector."""
    apps = b.applications(spark, d).select("loan_id", "loan_purpose", "pincode")
    encoder = en.fit_sparse_one_hot(apps, ["loan_purpose", "pincode"], drop_first=True, null_category=False)
    return encoder.transform(apps, "loan_id").select("loan_id", F.col("categories").cast("string").alias("categories"))


@catalog.add(
    "one_hot_drop_first",
    f"""{APPS} select loan_id, {", ".join(f"loan_purpose = '{v}' as loan_purpose_{v}" for v in _SEGMENTS[1:])},
    {", ".join(f"residential_status = '{v}' as residential_status_{v}" for v in _REGIONS[1:])} from applications""",
)
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", "loan_purpose", "residential_status")
    dummies = en.fit_one_hot(
        apps, ["loan_purpose", "residential_status"], drop_first=True, as_boolean=True, null_category=False
    )
    return dummies.transform(apps)


