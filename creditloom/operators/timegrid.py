"""Per-customer time series before an application date: balances, month grids, gaps.

Everything starts from one row per customer and day, so a customer's series is never longer than the calendar,
however many transactions the customer has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from creditloom.functions.dates import in_window, months_back
from creditloom.functions.numbers import mean_of_present, sum_or_zero

KEY, DAY, ANCHOR = "customer_id", "day", "anchor_date"


def _by_day() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(DAY)


def anchor_dates(applications: DataFrame) -> DataFrame:
    """One date per customer: the earliest application's."""
    return applications.groupBy(KEY).agg(F.min("application_date").alias(ANCHOR))


def point_in_time(anchors: DataFrame, days: DataFrame, how: str = "left") -> DataFrame:
    """Each anchor with the customer's days up to and including it; a customer without any keeps one empty row."""
    dated = days.withColumnRenamed(KEY, "_key")
    return anchors.join(dated, (F.col(KEY) == F.col("_key")) & (F.col(DAY) <= F.col(ANCHOR)), how).drop("_key")


def daily_net(transactions: DataFrame, signed: Column) -> DataFrame:
    return transactions.groupBy(KEY, F.col("transaction_date").alias(DAY)).agg(F.sum(signed).alias("signed_amount"))


def balance_columns() -> dict[str, Column]:
    """Balance at the end of each day, and the last day on which it still holds.

    The last day of a series holds for itself only: nothing is known after it.
    """
    following = F.lead(DAY).over(_by_day())
    return {
        "balance": F.sum("signed_amount").over(_by_day().rowsBetween(Window.unboundedPreceding, 0)),
        "valid_to": F.coalesce(F.date_sub(following, 1), F.col(DAY)),
    }


def running_balance(days: DataFrame) -> DataFrame:
    """Daily net amounts with ``balance`` and ``valid_to``."""
    return days.withColumns(balance_columns())


def daily_balance(balances: DataFrame) -> DataFrame:
    """One row per calendar day from the first to the last transaction day, carrying the balance forward."""
    return balances.select(KEY, F.explode(F.sequence(DAY, "valid_to")).alias(DAY), "balance")


def carry_forward(balances: DataFrame, moments: DataFrame, moment: str) -> DataFrame:
    """Balance known at each moment: that of the interval which holds it, or of the last one before it.

    Both sides are keyed by customer; a moment before the first transaction gets null.
    """
    unknown = F.lit(None).cast("double").alias("balance")
    marks = moments.select(KEY, F.col(moment).alias(DAY), unknown, F.lit(1).alias("_m"))
    known = balances.select(KEY, DAY, F.col("balance").cast("double"), F.lit(0).alias("_m"))
    order = Window.partitionBy(KEY).orderBy(DAY, "_m").rowsBetween(Window.unboundedPreceding, 0)
    seen = known.unionByName(marks).withColumn("balance", F.last("balance", ignorenulls=True).over(order))
    return seen.where(F.col("_m") == 1).select(KEY, F.col(DAY).alias(moment), "balance")


def valid_from(months: int) -> Column:
    """Start of a balance interval, cut at the start of the trailing window."""
    return F.greatest(F.col(DAY), F.add_months(F.col(ANCHOR), -months))


def trailing_balance(balances: DataFrame, months: int = 6) -> DataFrame:
    """Balance intervals cut to the trailing window; those that ended before it are dropped."""
    return balances.withColumn("valid_from", valid_from(months)).where(F.col("valid_from") <= F.col("valid_to"))


def month_span(months: int = 6) -> dict[str, Column]:
    """First and last calendar month that a balance interval touches inside the trailing window, counted back from the
    anchor's month; null for an interval that ended before the window."""
    start, end, anchor = valid_from(months), F.col("valid_to"), F.col(ANCHOR)
    alive = start <= end
    return {
        "from_back": F.when(alive, months_back(start, anchor)),
        "to_back": F.when(alive, months_back(end, anchor)),
    }


def month_minima(months: int = 6) -> list[Column]:
    """Lowest balance in each calendar month that the trailing window touches, newest first, as aggregates over rows
    with ``month_span``. A window of n months touches n + 1 calendar months unless it starts on the first of one.
    """
    first, last = F.col("from_back"), F.col("to_back")
    return [F.min(F.when((last <= back) & (first >= back), F.col("balance"))) for back in range(months + 1)]


def min_balance(history: DataFrame, months: int = 6) -> DataFrame:
    """Mean over the months of the window of each month's lowest daily balance; zero where no day is known."""
    names = [f"low_{i}" for i in range(months + 1)]
    spans = running_balance(history).withColumns(month_span(months))
    lows = spans.groupBy(KEY).agg(*[c.alias(n) for c, n in zip(month_minima(months), names)])
    mean = F.coalesce(mean_of_present([F.col(n) for n in names]), F.lit(0.0))
    return lows.select(KEY, mean.alias("avg_monthly_balance_min_6m"))


def month_grid(amount: Column, inside: Column, back: Column, months: int = 6) -> list[Column]:
    """Sums per calendar month as aggregates, newest first; the grid ends with the anchor's month.

    ``inside`` says whether a row lies in the trailing window and ``back`` how many months before the anchor's. Only
    rows that are in both the window and the grid count, so the oldest partial month is left out, and a month without
    rows is zero.
    """
    return [sum_or_zero(F.when(inside & (back == i), amount)) for i in range(months)]


def previous_day(condition: Column) -> Column:
    """Last earlier day of the same customer on which the condition holds."""
    earlier = _by_day().rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(condition, F.col(DAY)), ignorenulls=True).over(earlier)


def longest_gap(history: DataFrame, condition: Column, months: int = 12) -> DataFrame:
    """Longest stretch in days between two days that meet the condition in the trailing window; zero below two."""
    counts = condition & in_window(F.col(DAY), F.col(ANCHOR), months)
    gaps = history.withColumn("gap", F.when(counts, F.datediff(F.col(DAY), previous_day(counts))))
    return gaps.groupBy(KEY).agg(F.coalesce(F.max("gap"), F.lit(0)).alias("longest_income_gap_days_12m"))
