"""The three raw tables, bound to the test tables by one SQL text that both engines read.

Money stays in exact decimals, so sums do not depend on the order of the rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

APPLICATIONS = """
select customer_id, loan_id, application_date, age, gender, marital_status, education_level, num_dependents,
 residential_status, time_at_current_address_months, pincode,
 cast(case when cast(substring(pincode, 1, 1) as int) % 2 = 0 then 1 else 0 end as int) as is_urban_residence,
 employment_type, time_at_current_job_months, monthly_gross_income, declared_monthly_expenses, loan_amount_requested,
 loan_term_months, loan_purpose, emi_requested,
 cast(case when collateral_value > 0 then 1 else 0 end as int) as collateral_flag, collateral_value,
 case when collateral_value > 0 then cast(loan_amount_requested as double) / cast(collateral_value as double)
   else cast(0 as double) end as loan_to_value_ratio,
 other_emi_declared,
 case when monthly_gross_income > 0
   then (cast(emi_requested as double) + cast(other_emi_declared as double)) / cast(monthly_gross_income as double)
   else cast(999 as double) end as debt_service_ratio_declared,
 has_credit_history, is_default
from (
 select c_custkey as customer_id, c_custkey + 1000000 as loan_id,
  date '2000-12-31' - cast(c_custkey % 730 as int) as application_date,
  cast(22 + c_custkey % 44 as int) as age,
  case c_custkey % 3 when 0 then 'Female' when 1 then 'Male' else 'Other' end as gender,
  case c_custkey % 4 when 0 then 'Single' when 1 then 'Married' when 2 then 'Divorced' else 'Widowed' end
    as marital_status,
  case when c_custkey % 7 < 3 then 'Graduate' when c_custkey % 7 < 5 then 'High School' else 'Doctorate' end
    as education_level,
  cast(c_custkey % 6 as int) as num_dependents,
  concat('R', cast(c_nationkey % 5 as string)) as residential_status,
  cast(6 + c_custkey * 7 % 235 as int) as time_at_current_address_months,
  cast(100000 + c_custkey * 9973 % 800000 as string) as pincode,
  case when c_acctbal <= 0 then 'Unemployed' when c_custkey % 5 = 0 then 'Retired'
    when c_custkey % 2 = 0 then 'Salaried' else 'Self-employed' end as employment_type,
  cast(case when c_acctbal <= 0 then 0 else 12 + c_custkey * 11 % 349 end as int) as time_at_current_job_months,
  cast(greatest(c_acctbal, 0) as decimal(18,2)) as monthly_gross_income,
  cast(greatest(c_acctbal - 500, 0) as decimal(18,2)) as declared_monthly_expenses,
  cast(50000 + c_custkey % 97 * 1000 as decimal(18,2)) as loan_amount_requested,
  cast(12 * (1 + c_custkey % 5) as int) as loan_term_months,
  c_mktsegment as loan_purpose,
  cast(abs(c_acctbal) as decimal(18,2)) as emi_requested,
  cast(case when c_custkey % 3 = 0 then 100000 + c_custkey % 89 * 5000 else 0 end as decimal(18,2))
    as collateral_value,
  cast(c_custkey % 13 * 100 as decimal(18,2)) as other_emi_declared,
  cast(case when c_custkey % 10 < 7 then 1 else 0 end as int) as has_credit_history,
  cast(case when c_acctbal < 0 or c_custkey % 11 = 0 then 1 else 0 end as int) as is_default
 from {customer}
) raw_applications
"""

CREDIT_ACCOUNTS = """
select o_custkey as customer_id, cast(300 + (o_custkey * 37) % 601 as int) as credit_score, o_orderkey as account_id,
 cast(o_orderdate as date) as account_open_date,
 case o_orderpriority when '1-URGENT' then 'Credit Card' when '2-HIGH' then 'Personal Loan'
   when '3-MEDIUM' then 'Home Loan' else 'Auto Loan' end as account_type,
 cast(case when o_orderkey % 50 = 0 then 0 else o_totalprice end as decimal(18,2)) as sanctioned_limit,
 cast(greatest(cast(o_totalprice as decimal(18,2)) - cast(o_orderkey % 91 * 2000 as decimal(18,2)),
   cast(0 as decimal(18,2))) as decimal(18,2)) as current_balance,
 cast(case when o_orderstatus = 'P' then o_orderkey % 181 else 0 end as int) as max_dpd_past_24m,
 cast(o_orderkey % 4 as int) as num_30_dpd_last_6m, cast(o_orderkey % 3 as int) as num_90_dpd_last_12m,
 cast(case when o_orderkey % 20 = 0 then 1 else 0 end as int) as num_defaults_total,
 cast(case when o_orderkey % 50 = 1 then 1 else 0 end as int) as num_settled_total,
 case o_orderstatus when 'O' then 'Active' when 'P' then 'Delinquent' else 'Closed' end as account_status
from {orders}
"""

TRANSACTIONS = """
select o.o_custkey as customer_id, cast(l.l_shipdate as date) as transaction_date,
 cast(l.l_extendedprice as decimal(18,2)) as amount,
 case when l.l_linestatus = 'F' then 'credit' else 'debit' end as type,
 case p.p_type
   when 'ECONOMY' then case when l.l_partkey % 2 = 0 then 'Salary' else 'Freelance Income' end
   when 'LARGE' then case when l.l_partkey % 2 = 0 then 'Rent Payment' else 'Loan EMI Deduction' end
   when 'MEDIUM' then case when l.l_partkey % 2 = 0 then 'Overdraft Fee' else 'Cheque Bounce Charge' end
   when 'PROMO' then 'ATM Withdrawal' when 'SMALL' then 'Transfer to Savings' else 'Investment' end as description,
 case when l.l_linestatus = 'F' then 'Income' when l.l_returnflag = 'N' then 'Essential'
   when l.l_returnflag = 'R' then 'Discretionary' else 'Transfers' end as category
from {lineitem} l join {orders} o on l.l_orderkey = o.o_orderkey join {part} p on l.l_partkey = p.p_partkey
"""

SCORED = """
select d.doc_id as key, l.quality as label, cast(d.n_chars as double) as score
from {documents} d join {labels} l on d.doc_id = l.doc_id
"""

TABLES = ("customer", "orders", "lineitem", "part", "documents", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bind(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    return spark.sql(text, **used)


applications = partial(_bind, APPLICATIONS)
credit_accounts = partial(_bind, CREDIT_ACCOUNTS)
transactions = partial(_bind, TRANSACTIONS)
scored_rows = partial(_bind, SCORED)


def common_tables(*names: str) -> str:
    """``with`` list of the bound tables for the checking engine; ends open, for more entries after a comma."""
    texts = {
        "applications": APPLICATIONS,
        "credit_accounts": CREDIT_ACCOUNTS,
        "transactions": TRANSACTIONS,
        "scored": SCORED,
    }
    plain = {n: n for n in TABLES}
    return "with " + ", ".join(f"{n} as ({texts[n].format(**plain)})" for n in names)
