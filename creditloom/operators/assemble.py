"""Applications with all features next to them: joins, composites, null policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.lending import NO_INCOME_RATIO, effective_income
from creditloom.functions.numbers import finite, safe_ratio
from creditloom.operators.credit import CREDIT_FEATURES, KEY
from creditloom.operators.skew import spread_join
from creditloom.operators.transactions import TRANSACTION_FEATURES

# Names of the columns, which jobs and files share.
COMPOSITES = (
    "effective_monthly_income", "total_monthly_emi_obligations", "debt_to_income_ratio_computed",
    "residual_income_after_emi",
)

ENGINEERED = CREDIT_FEATURES + TRANSACTION_FEATURES + COMPOSITES


def attach_features(applications: DataFrame, credit: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every application with the features of its customer.

    The two feature tables have one row per customer and meet first. The applications then join once, spread where a
    customer has very many of them.
    """
    per_customer = transactions.join(credit, KEY, "left")
    return spread_join(applications, per_customer, KEY, "loan_id", "left").select(
        *applications.columns, *CREDIT_FEATURES, *TRANSACTION_FEATURES
    )


def composites(df: DataFrame) -> DataFrame:
    """Income, obligations, debt-to-income and residual income from observed and declared figures."""
    owed = (
        F.col("emi_requested").cast("double")
        + F.col("other_emi_declared").cast("double")
        + F.col("detected_other_emis_sum").cast("double")
    )
    income, obligations = F.col("effective_monthly_income"), F.col("total_monthly_emi_obligations")
    return df.withColumns(
        {
            "effective_monthly_income": effective_income(
                F.col("avg_monthly_net_income_6m"), F.col("monthly_gross_income")
            ),
            "total_monthly_emi_obligations": owed,
        }
    ).withColumns(
        {
            "debt_to_income_ratio_computed": safe_ratio(obligations, income, NO_INCOME_RATIO),
            "residual_income_after_emi": F.coalesce(
                income - F.col("avg_monthly_essential_expenses_6m") - obligations, F.lit(0.0)
            ),
        }
    )


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null and not-a-number become zero in the named columns, or in every numeric column."""
    numeric = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    chosen = [c for c in (numeric if columns is None else columns) if c in numeric]

    def value(name: str):
        real = isinstance(numeric[name], (T.DoubleType, T.FloatType))
        return F.nanvl(F.col(name), F.lit(0.0)) if real else F.col(name)

    return df.withColumns({c: F.coalesce(value(c), F.lit(0)).cast(numeric[c]) for c in chosen}) if chosen else df


def assemble(applications: DataFrame, credit: DataFrame, transactions: DataFrame) -> DataFrame:
    """The engineered table: applications without their date, the features, the composites, and no numeric nulls."""
    table = composites(attach_features(applications, credit, transactions).drop("application_date"))
    ratio = "loan_to_value_ratio"
    if ratio in table.columns:
        table = table.withColumn(ratio, F.coalesce(finite(F.col(ratio)), F.lit(0.0)))
    return fill_zero(table)
