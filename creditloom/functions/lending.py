"""Loan arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.numbers import safe_ratio

# Stand-ins for an undefined ratio.
NO_COLLATERAL_RATIO = 0.0
NO_INCOME_RATIO = 999.0

# The additive risk rules.
BASE_RISK = 0.05
LOW_INCOME, LOW_INCOME_RISK = 30000, 0.05
YOUNG_AGE, YOUNG_RISK = 25, 0.03
UNEMPLOYED, UNEMPLOYED_RISK = "Unemployed", 0.2
HIGH_BURDEN, HIGH_BURDEN_RISK = 0.6, 0.07
NEW_TO_CREDIT_RISK = 0.05
SCORE_BANDS = ((550, 0.15), (650, 0.08), (750, 0.02))
GOOD_SCORE_RISK = -0.02


def emi(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Level monthly instalment of a reducing-balance loan; a zero rate spreads the principal evenly."""
    amount, rate = principal.cast("double"), annual_rate.cast("double") / 12 / 100
    growth = F.pow(rate + 1, months)
    return F.when(rate == 0, F.try_divide(amount, months)).otherwise(
        F.try_divide(amount * rate * growth, growth - 1)
    )


def signed_amount(amount: Column, kind: Column, magnitudes: bool = False) -> Column:
    """Credits count up, everything else down. ``magnitudes`` drops a sign already stored in the amount."""
    value = F.abs(amount) if magnitudes else amount
    return F.when(kind == "credit", value).otherwise(-value)


def loan_to_value(loan: Column, collateral: Column) -> Column:
    return F.when(collateral > 0, safe_ratio(loan, collateral, NO_COLLATERAL_RATIO)).otherwise(NO_COLLATERAL_RATIO)


def debt_service_ratio(instalment: Column, other: Column, income: Column) -> Column:
    owed = instalment.cast("double") + other.cast("double")
    return F.when(income > 0, safe_ratio(owed, income, NO_INCOME_RATIO)).otherwise(NO_INCOME_RATIO)


def effective_income(observed: Column, declared: Column) -> Column:
    """Observed mean income where positive, else the declared one."""
    return F.when(observed > 0, observed).otherwise(declared.cast("double"))


def rule_score(
    income: Column, age: Column, employment: Column, burden: Column, has_history: Column, score: Column
) -> Column:
    """Sum of the deterministic risk rules; the score bands count only for customers with a history."""

    def add(condition: Column, risk: float) -> Column:
        return F.when(condition, F.lit(risk)).otherwise(F.lit(0.0))

    band = F.lit(GOOD_SCORE_RISK)
    for below, risk in reversed(SCORE_BANDS):
        band = F.when(score < below, F.lit(risk)).otherwise(band)
    return (
        F.lit(BASE_RISK)
        + add(income < LOW_INCOME, LOW_INCOME_RISK)
        + add(age < YOUNG_AGE, YOUNG_RISK)
        + add(employment == UNEMPLOYED, UNEMPLOYED_RISK)
        + add(burden > HIGH_BURDEN, HIGH_BURDEN_RISK)
        + add(has_history == 0, NEW_TO_CREDIT_RISK)
        + F.when(has_history == 1, band).otherwise(F.lit(0.0))
    )
