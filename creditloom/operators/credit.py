"""Features per customer from credit-bureau accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.dates import whole_months_30
from creditloom.functions.numbers import safe_ratio, sum_or_zero, whole_units
from creditloom.operators.skew import spread_join
from creditloom.sources.files import require

KEY = "customer_id"

# The literals that the account predicates test, and the date that account ages are taken at.
ACTIVE, REVOLVING = "Active", "Credit Card"
AS_OF = "2024-12-31"

# Names of the columns, which jobs and files share.
ACCOUNT_COLUMNS = (
    KEY, "account_id", "credit_score", "account_open_date", "account_type", "account_status", "sanctioned_limit",
    "current_balance", "max_dpd_past_24m", "num_30_dpd_last_6m", "num_90_dpd_last_12m", "num_defaults_total",
    "num_settled_total",
)

CREDIT_FEATURES = (
    "credit_score", "num_credit_accounts_total", "num_credit_accounts_active", "oldest_account_age_months",
    "newest_account_age_months", "total_sanctioned_limit", "total_outstanding_balance",
    "num_defaults_reported_total", "num_settled_accounts_total", "max_dpd_past_24m",
    "num_revolving_accounts_active", "overall_credit_utilization_ratio", "avg_account_age_months",
    "ever_defaulted_flag", "num_30_dpd_last_6m", "num_90_dpd_last_12m",
)

_HALF, _MASK = 1 << 31, (1 << 32) - 1


def _dated_score() -> Column:
    """Opening date and score in one long, ordered by date and then score, so that its minimum is the first score and
    the aggregate keeps a fixed-width buffer (a struct would force a sort). A missing date comes last."""
    day = F.coalesce(F.unix_date("account_open_date"), F.lit(_HALF - 1)).cast("long")
    score = F.col("credit_score").cast("long")
    return F.when(score.isNotNull(), F.shiftleft(day, 32) + score + _HALF)


def _unpacked_score(packed: Column) -> Column:
    return (packed.bitwiseAND(F.lit(_MASK)) - _HALF).cast("int")


def first_score(accounts: DataFrame) -> DataFrame:
    """First non-null score per customer: of the account opened earliest, the lowest one on a tie."""
    return accounts.groupBy(KEY).agg(_unpacked_score(F.min(_dated_score())).alias("credit_score"))


def _known_customers(applications: DataFrame) -> DataFrame:
    return applications.where(F.col("has_credit_history") == 1).select(KEY).distinct()


def with_history(accounts: DataFrame, applications: DataFrame) -> DataFrame:
    """Keeps the accounts of customers with an application that states a credit history."""
    return spread_join(accounts, _known_customers(applications), KEY, "account_id").select(*accounts.columns)


def account_totals(accounts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """All account aggregates in two grouping steps, first per account and then per customer.

    The first step makes the distinct counts plain counts, and spreads a customer with very many accounts.
    """
    limit, limit_unit = whole_units(accounts, "sanctioned_limit")
    balance, balance_unit = whole_units(accounts, "current_balance")
    active = F.col("account_status") == ACTIVE
    revolving = active & (F.col("account_type") == REVOLVING)
    per_account = require(accounts, ACCOUNT_COLUMNS, "credit accounts").groupBy(KEY, "account_id").agg(
        F.min(_dated_score()).alias("dated_score"),
        F.count_if(active).alias("active"),
        F.max(F.when(revolving, F.lit(1))).alias("revolving"),
        F.min("account_open_date").alias("first_open"),
        F.max("account_open_date").alias("last_open"),
        F.max("max_dpd_past_24m").alias("max_dpd_past_24m"),
        F.sum(limit).alias("limit"),
        F.sum(balance).alias("balance"),
        *[
            F.sum(c).alias(c)
            for c in ("num_defaults_total", "num_settled_total", "num_30_dpd_last_6m", "num_90_dpd_last_12m")
        ],
    )
    on = F.lit(as_of).cast("date")
    known_account = F.col("account_id").isNotNull()
    return per_account.groupBy(KEY).agg(
        _unpacked_score(F.min("dated_score")).alias("credit_score"),
        F.count("account_id").alias("num_credit_accounts_total"),
        sum_or_zero(F.col("active")).alias("num_credit_accounts_active"),
        whole_months_30(on, F.min("first_open")).alias("oldest_account_age_months"),
        whole_months_30(on, F.max("last_open")).alias("newest_account_age_months"),
        (sum_or_zero(F.col("limit")).cast("double") / limit_unit).alias("total_sanctioned_limit"),
        (sum_or_zero(F.col("balance")).cast("double") / balance_unit).alias("total_outstanding_balance"),
        sum_or_zero(F.col("num_defaults_total")).alias("num_defaults_reported_total"),
        sum_or_zero(F.col("num_settled_total")).alias("num_settled_accounts_total"),
        F.max("max_dpd_past_24m").alias("max_dpd_past_24m"),
        sum_or_zero(F.when(known_account, F.col("revolving"))).alias("num_revolving_accounts_active"),
        sum_or_zero(F.col("num_30_dpd_last_6m")).alias("num_30_dpd_last_6m"),
        sum_or_zero(F.col("num_90_dpd_last_12m")).alias("num_90_dpd_last_12m"),
    )


def credit_features(applications: DataFrame, accounts: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The sixteen credit columns per customer with a history.

    The semi-join comes after the grouping: it then meets one row per customer, and no customer is too big for a task.
    """
    totals = account_totals(accounts, as_of).join(_known_customers(applications), KEY, "left_semi")
    oldest, newest = F.col("oldest_account_age_months"), F.col("newest_account_age_months")
    balance, limit = F.col("total_outstanding_balance"), F.col("total_sanctioned_limit")
    return totals.withColumns(
        {
            "overall_credit_utilization_ratio": safe_ratio(balance, limit, 0),
            "avg_account_age_months": (oldest + newest) / 2,
            "ever_defaulted_flag": (F.col("num_defaults_reported_total") > 0).cast("int"),
        }
    ).select(KEY, *CREDIT_FEATURES)
