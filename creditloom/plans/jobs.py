"""Feature jobs: raw tables in, feature tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions import labels, lending
from creditloom.operators import encoding as en
from creditloom.operators.assemble import assemble
from creditloom.operators.credit import AS_OF, credit_features
from creditloom.operators.selection import cols_of_type, order_columns
from creditloom.operators.transactions import TransactionRules, transaction_features
from creditloom.sources.files import write_parquet

# Columns that are never encoded, and columns that are never scaled.
NOT_ENCODED = ("customer_id", "loan_id", "pincode", "current_delinquency_status")
NOT_SCALED = (
    "customer_id", "loan_id", "is_default", "has_credit_history", "collateral_flag", "is_urban_residence",
    "ever_defaulted_flag", "has_recurring_salary_flag", "has_investment_transactions_flag", "num_dependents",
    "num_credit_accounts_total", "num_credit_accounts_active", "num_revolving_accounts_active",
    "num_defaults_reported_total", "num_settled_accounts_total", "num_30_dpd_last_6m", "num_90_dpd_last_12m",
    "max_dpd_past_24m", "num_recurring_bill_payments_detected", "num_overdrafts_6m", "num_bounced_transactions_6m",
    "large_cash_withdrawal_frequency_6m", "num_distinct_income_sources_6m",
)


def engineer(
    applications: DataFrame,
    accounts: DataFrame,
    transactions: DataFrame,
    rules: TransactionRules = TransactionRules(),
    as_of: str = AS_OF,
) -> DataFrame:
    """One row per application with all 36 features."""
    return assemble(
        applications,
        credit_features(applications, accounts, as_of),
        transaction_features(applications, transactions, rules),
    )


def encode_and_scale(engineered: DataFrame, scale: bool = True) -> tuple[DataFrame, list[en.Step]]:
    """Categories as 0/1 columns, numbers standardised; ids first, the label last, the postcode left out.

    Also returns the fitted steps. ``engineered`` is read once per fit, so hand in a stored table.
    """
    categories = [c for c in cols_of_type(engineered, "string") if c not in NOT_ENCODED]
    encoder = en.fit_one_hot(engineered, categories, new_first=True)
    steps: list[en.Step] = [encoder]
    table = encoder.transform(engineered)
    if scale:
        numeric = [c for c in cols_of_type(table, "number") if c not in NOT_SCALED]
        scaler = en.fit_standardize(table, numeric)
        steps.append(scaler)
        table = order_columns(scaler.transform(table), first=tuple(numeric))
    return (
        order_columns(table, first=("customer_id", "loan_id"), last=("is_default",), drop=("pincode",)),
        steps,
    )


def encode_scale_write(engineered: DataFrame, path: str, scale: bool = True) -> list[en.Step]:
    """The table ready for modelling, as Parquet; returns the fitted steps."""
    table, steps = encode_and_scale(engineered, scale)
    write_parquet(table, path)
    return steps


def application_metrics(applications: DataFrame, annual_rate: Column) -> DataFrame:
    """Instalment, ratios, urban flag, rule score and readable ids per application.

    ``annual_rate`` is in percent. A ``credit_score`` column is used by the rules where the table has one.
    """
    col = F.col
    score = col("credit_score") if "credit_score" in applications.columns else F.lit(None).cast("int")
    burden = lending.debt_service_ratio(col("emi_requested"), col("other_emi_declared"), col("monthly_gross_income"))
    return applications.select(
        "loan_id",
        "customer_id",
        lending.emi(col("loan_amount_requested"), annual_rate, col("loan_term_months")).alias("instalment"),
        lending.loan_to_value(col("loan_amount_requested"), col("collateral_value")).alias("loan_to_value"),
        burden.alias("debt_service_ratio"),
        labels.postcode_flag(col("pincode")).alias("is_urban"),
        lending.rule_score(
            col("monthly_gross_income"), col("age"), col("employment_type"), burden, col("has_credit_history"), score
        ).alias("rule_score"),
        labels.padded_id("CUST", col("customer_id")).alias("customer_label"),
        labels.padded_id("LOAN", col("loan_id")).alias("loan_label"),
    )
