"""Features per customer from bank transactions before the application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.dates import in_window, months_back
from creditloom.functions.labels import contains_safe
from creditloom.functions.lending import signed_amount
from creditloom.functions.numbers import eps_ratio, mean_of_present, sample_std_of, sum_or_zero, whole_units
from creditloom.operators import timegrid as tg
from creditloom.sources.files import require

KEY, DAY, ANCHOR = tg.KEY, tg.DAY, tg.ANCHOR

# Names of the columns, which jobs and files share.
TRANSACTION_COLUMNS = (KEY, "transaction_date", "amount", "type", "description", "category")

TRANSACTION_FEATURES = (
    "avg_monthly_net_income_6m", "std_dev_monthly_net_income_6m", "longest_income_gap_days_12m",
    "num_distinct_income_sources_6m", "has_recurring_salary_flag", "avg_monthly_essential_expenses_6m",
    "avg_monthly_discretionary_expenses_6m", "essential_to_discretionary_spend_ratio",
    "num_recurring_bill_payments_detected", "num_overdrafts_6m", "num_bounced_transactions_6m",
    "large_cash_withdrawal_frequency_6m", "avg_monthly_balance_min_6m", "avg_monthly_savings_transfers_6m",
    "has_investment_transactions_flag", "detected_other_emis_sum",
)


@dataclass(frozen=True)
class TransactionRules:
    """Fixed values that the predicates test, and two switches that are off by default.

    ``magnitudes`` ignores a sign stored in the amount. ``emi_monthly`` turns the twelve-month instalment sum into a
    monthly figure.
    """

    income: str = "Income"
    essential: str = "Essential"
    discretionary: str = "Discretionary"
    salaries: tuple[str, ...] = ("Salary", "Freelance Income")
    recurring_bills: tuple[str, ...] = ("Rent Payment", "Loan EMI Deduction")
    overdraft: str = "Overdraft"
    bounce: str = "Bounce"
    cash: str = "ATM Withdrawal"
    large_cash: float = 10000
    savings: str = "Transfer to Savings"
    investment: str = "Investment"
    emi: str = "Loan EMI Deduction"
    salary_months: int = 4
    magnitudes: bool = False
    emi_monthly: bool = False


def daily_rollup(transactions: DataFrame, rules: TransactionRules = TransactionRules()) -> DataFrame:
    """One row per customer and day with every sum, count and flag the features need.

    All parts combine before the shuffle, and afterwards the hot customers are as short as the calendar. Decimal
    amounts are summed in their smallest unit, see ``whole_units``.
    """
    amount, category, description = whole_units(transactions, "amount")[0], F.col("category"), F.col("description")
    value = F.abs(amount) if rules.magnitudes else amount
    paid = F.abs("amount") if rules.magnitudes else F.col("amount")
    income = category == rules.income

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, value))

    return (
        require(transactions, TRANSACTION_COLUMNS, "transactions")
        .groupBy(KEY, F.col("transaction_date").alias(DAY))
        .agg(
            F.sum(signed_amount(amount, F.col("type"), rules.magnitudes)).alias("signed_amount"),
            total(F.col("type") == "credit").alias("credit"),
            total(category == rules.essential).alias("essential"),
            total(category == rules.discretionary).alias("discretionary"),
            total(description == rules.savings).alias("savings"),
            total(description == rules.emi).alias("emi"),
            F.count_if(income).alias("incomes"),
            F.bool_or(income & description.isin(*rules.salaries)).alias("salary"),
            F.count_if(description.isin(*rules.recurring_bills)).alias("bills"),
            F.count_if(contains_safe(description, rules.overdraft)).alias("overdrafts"),
            F.count_if(contains_safe(description, rules.bounce)).alias("bounces"),
            F.count_if((description == rules.cash) & (paid > rules.large_cash)).alias("large_cash"),
            F.bool_or(description == rules.investment).alias("investment"),
        )
    )


def _upto_anchors(transactions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Without the days after the last anchor, which can never count."""
    return transactions.where(F.col("transaction_date") <= anchors.agg(F.max(ANCHOR)).scalar())


def income_sources(
    transactions: DataFrame, anchors: DataFrame, rules: TransactionRules = TransactionRules(), months: int = 6
) -> DataFrame:
    """Number of distinct income descriptions per customer in the trailing window.

    A description counts once: on its last day up to the anchor, if the window holds that day. So it is enough to know
    how many descriptions pass from one day to the next on which they occur again. That table has no description left
    and is bounded by the calendar, whereas one customer's free-text descriptions could be too many for one task.
    """
    income = (F.col("category") == rules.income) & F.col("description").isNotNull()
    # no window begins earlier; a bound that a scan of dated files can skip by
    first = F.date_sub(F.add_months(anchors.agg(F.min(ANCHOR)).scalar(), -months), 1)
    seen = _upto_anchors(transactions, anchors).where(income & (F.col("transaction_date") >= first)).select(KEY, "description", F.col("transaction_date").alias(DAY)).distinct()
    again = F.lead(DAY).over(Window.partitionBy(KEY, "description").orderBy(DAY))
    steps = (
        seen.select(F.col(KEY).alias("_key"), DAY, again.alias("again"))
        .groupBy("_key", DAY, "again")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    last_before = F.col("again").isNull() | (F.col("again") > F.col(ANCHOR))
    return (
        anchors.join(
            steps, (F.col(KEY) == F.col("_key")) & in_window(F.col(DAY), F.col(ANCHOR), months) & last_before, "inner"
        )
        .groupBy(KEY)
        .agg(F.sum("n").alias("num_distinct_income_sources_6m"))
    )


def transaction_features(
    applications: DataFrame, transactions: DataFrame, rules: TransactionRules = TransactionRules()
) -> DataFrame:
    """The sixteen transaction columns, one row per customer of ``applications``; zeros without transactions.

    One join by customer puts each day next to the anchor date. The window and the grouping reuse its partitioning.
    """
    anchors = tg.anchor_dates(applications)
    day, anchor = F.col(DAY), F.col(ANCHOR)
    earns = (F.col("incomes") > 0) & in_window(day, anchor, 12)
    unit = whole_units(transactions, "amount")[1]

    # all windows in one step, then what several aggregates share
    history = (
        tg.point_in_time(anchors, daily_rollup(_upto_anchors(transactions, anchors), rules))
        .withColumns({**tg.balance_columns(), "income_gap": F.when(earns, F.datediff(day, tg.previous_day(earns)))})
        .withColumns(
            {
                "last_6": in_window(day, anchor, 6),
                "last_12": in_window(day, anchor, 12),
                "back": months_back(day, anchor),
                **tg.month_span(6),
            }
        )
    )
    last_6, last_12, back = F.col("last_6"), F.col("last_12"), F.col("back")
    grid = last_6 & (back < 6)

    def money(col: Column) -> Column:
        return col.cast("double") / unit

    def count_6(name: str) -> Column:
        return sum_or_zero(F.when(last_6, F.col(name)))

    credits = [f"credit_{i}" for i in range(6)]
    lows = [f"low_{i}" for i in range(7)]
    totals = history.groupBy(KEY).agg(
        *[money(c).alias(n) for c, n in zip(tg.month_grid(F.col("credit"), last_6, back, 6), credits)],
        money(sum_or_zero(F.when(grid, F.col("credit")))).alias("credit_total"),
        money(sum_or_zero(F.when(grid, F.col("essential")))).alias("essential_total"),
        money(sum_or_zero(F.when(grid, F.col("discretionary")))).alias("discretionary_total"),
        *[c.alias(n) for c, n in zip(tg.month_minima(6), lows)],
        F.coalesce(F.max("income_gap"), F.lit(0)).alias("longest_income_gap_days_12m"),
        F.coalesce(F.bool_or(F.col("salary") & last_12), F.lit(False)).alias("has_salary"),
        count_6("bills").alias("num_recurring_bill_payments_detected"),
        count_6("overdrafts").alias("num_overdrafts_6m"),
        count_6("bounces").alias("num_bounced_transactions_6m"),
        count_6("large_cash").alias("large_cash_withdrawal_frequency_6m"),
        money(count_6("savings")).alias("savings_total"),
        F.coalesce(F.bool_or(F.col("investment") & last_6), F.lit(False)).cast("int").alias(
            "has_investment_transactions_flag"
        ),
        money(sum_or_zero(F.when(last_12, F.col("emi")))).alias("emi_total"),
    )

    months = [F.col(c) for c in credits]
    earning_months = sum(((c > 0).cast("int") for c in months[1:]), (months[0] > 0).cast("int"))
    essential, discretionary = F.col("essential_total") / 6, F.col("discretionary_total") / 6
    counts = income_sources(transactions, anchors, rules)
    return (
        totals.join(counts, KEY, "left")
        .withColumns(
            {
                "avg_monthly_net_income_6m": F.col("credit_total") / 6,
                "std_dev_monthly_net_income_6m": sample_std_of(months),
                "num_distinct_income_sources_6m": F.coalesce("num_distinct_income_sources_6m", F.lit(0)),
                "has_recurring_salary_flag": (F.col("has_salary") & (earning_months >= rules.salary_months)).cast("int"),
                "avg_monthly_essential_expenses_6m": essential,
                "avg_monthly_discretionary_expenses_6m": discretionary,
                "essential_to_discretionary_spend_ratio": F.coalesce(eps_ratio(essential, discretionary), F.lit(0.0)),
                "avg_monthly_balance_min_6m": F.coalesce(mean_of_present([F.col(c) for c in lows]) / unit, F.lit(0.0)),
                "avg_monthly_savings_transfers_6m": F.col("savings_total") / 6,
                "detected_other_emis_sum": F.col("emi_total") / (12 if rules.emi_monthly else 1),
            }
        )
        .select(KEY, *TRANSACTION_FEATURES)
    )
