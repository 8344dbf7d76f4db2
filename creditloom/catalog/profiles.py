"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.catalog import bindings as b
from creditloom.catalog.features import ENGINEERED_SQL, engineered
from creditloom.catalog.kit import Catalog, comparable
from creditloom.operators import assemble as asm
from creditloom.operators import credit as cr
from creditloom.operators import profiling as pf
from creditloom.operators import sketches as sk
from creditloom.operators import transactions as tx
from creditloom.operators.selection import n_unique
from creditloom.session import stored

catalog = Catalog()

APPS = b.common_tables("applications")


def _stacked(rows: dict[str, list[str]], source: str, names: list[str]) -> str:
    """``union all`` of one select per column."""
    return " union all ".join(
        "select '{}' as column_name, {} from {}".format(
            c, ", ".join(f"{e} as {n}" for n, e in zip(names, exprs)), source
        )
        for c, exprs in rows.items()
    )


@catalog.add(
    "value_counts",
    "select c_mktsegment, count(*) as n from customer where c_mktsegment is not null group by c_mktsegment",
)
def _(spark, d):
    return pf.value_counts(b.table(spark, d, "customer"), "c_mktsegment")


@catalog.add(
    "value_shares",
    """select l_returnflag, round(count(*) * 100.0 / (select count(*) from lineitem), 4) as percent
    from lineitem group by l_returnflag""",
)
def _(spark, d):
    return comparable(pf.value_counts(b.table(spark, d, "lineitem"), "l_returnflag", normalize=True))


@catalog.add(
    "top_k",
    "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 10",
)
def _(spark, d):
    return pf.top_k(b.table(spark, d, "orders"), "o_custkey", 10)


_MODES = {c: "part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}


@catalog.add(
    "mode",
    " union all ".join(
        f"select column_name, value from (select '{c}' as column_name, cast({c} as varchar) as value, count(*) as n "
        f"from {t} where {c} is not null group by {c} order by n desc, {c} limit 1) m"
        for c, t in _MODES.items()
    ),
)
def _(spark, d):
    return pf.mode(b.table(spark, d, "part"), list(_MODES))


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@catalog.add(
    "exact_median",
    _stacked({c: [f"round(median(cast({c} as double)), 4)"] for c in _LINE}, "lineitem", ["value"]),
)
def _(spark, d):
    return comparable(
        pf.exact_quantiles(b.table(spark, d, "lineitem"), _LINE, [0.5]).select("column_name", "value")
    )


def _described(columns: list[str], source: str) -> str:
    def measures(c: str) -> list[str]:
        quantiles = [f"quantile_cont(cast({c} as double), {p})" for p in pf.QUARTILES]
        doubles = [f"avg({c})", f"stddev_samp({c})", f"min({c})", *quantiles, f"max({c})"]
        return [f"count({c})", *[f"round(cast({e} as double), 4)" for e in doubles]]

    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return _stacked({c: measures(c) for c in columns}, source, [f'"{n}"' for n in names])


_PART_COLUMNS = ["p_partkey", "p_size", "p_retailprice"]


@catalog.add("describe", _described(_LINE, "lineitem"))
def _(spark, d):
    return comparable(pf.describe(b.table(spark, d, "lineitem")))


@catalog.add("describe_parts", _described(_PART_COLUMNS, "part"))
def _(spark, d):
    return comparable(pf.describe(b.table(spark, d, "part")))


_SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]


@catalog.add(
    "merged_sketches",
    _stacked({c: [f"count({c})", "true", "true", "true", "true"] for c in _SKETCHED}, "lineitem",
             ["n", "p25_holds", "p50_holds", "p75_holds", "distinct_holds"]),
)
def _(spark, d):
    """Sketches per ship date, stored and merged: whether each quartile's rank and each distinct count is within the
    stated error, beside the exact number of values that the merged sketch counts."""
    lines = b.table(spark, d, "lineitem")
    daily = stored(sk.sketch_table(lines, _SKETCHED, by=["l_shipdate"]), "sketches")
    found = stored(sk.estimates(sk.merged(daily)), "estimates")
    got = {r.column_name: r for r in found.collect()}  # a row per column
    exact = lines.agg(
        *[F.count_distinct(c).alias(f"distinct_{c}") for c in _SKETCHED],
        *[F.count_if(F.col(c) < getattr(got[c], p)).alias(f"{p}_less_{c}") for c in _SKETCHED for p in ("p25", "p50", "p75")],
        *[F.count_if(F.col(c) <= getattr(got[c], p)).alias(f"{p}_upto_{c}") for c in _SKETCHED for p in ("p25", "p50", "p75")],
    )

    def holds(c, p):
        slack = sk.RANK_ERROR * got[c].n
        share = int(p[1:]) / 100 * got[c].n
        return (F.col(f"{p}_less_{c}") <= share + slack) & (F.col(f"{p}_upto_{c}") >= share - slack)

    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(got[c].n).cast("long").alias("n"), *[holds(c, p).alias(f"{p}_holds") for p in ("p25", "p50", "p75")],
            (F.abs(F.lit(got[c].distinct) / F.col(f"distinct_{c}") - 1) <= 3 * sk.DISTINCT_ERROR).alias("distinct_holds"),
        )
        for c in _SKETCHED
    ]
    return exact.select(F.inline(F.array(*rows)))


_FEATURES = ["credit_score", "avg_account_age_months", "max_dpd_past_24m", "is_default"]


@catalog.add(
    "null_counts",
    f"{ENGINEERED_SQL} "
    + _stacked({c: [f"count(*) - count({c})"] for c in _FEATURES}, "joined", ["n_null"]),
)
def _(spark, d):
    """Missing values in the joined table: customers without a history."""
    apps = b.applications(spark, d)
    joined = asm.attach_features(
        apps,
        cr.credit_features(apps, b.credit_accounts(spark, d)),
        tx.transaction_features(apps, b.transactions(spark, d)),
    )
    return pf.null_counts(joined, _FEATURES)


_DISTINCT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@catalog.add("n_unique", _stacked({c: [f"count(distinct {c})"] for c in _DISTINCT}, "orders", ["n_unique"]))
def _(spark, d):
    return n_unique(b.table(spark, d, "orders"))


@catalog.add(
    "ranges",
    _stacked({c: [f"round(cast(min({c}) as double), 4)", f"round(cast(max({c}) as double), 4)"] for c in _LINE},
             "lineitem", ["min", "max"]),
)
def _(spark, d):
    return comparable(pf.ranges(b.table(spark, d, "lineitem")))


_RATIOS = ["debt_to_income_ratio_computed", "essential_to_discretionary_spend_ratio"]


@catalog.add(
    "sentinel_report",
    f"{ENGINEERED_SQL} "
    + _stacked({c: [f"count(case when {c} = 999 then 1 end)", f"round(max({c}), 4)"] for c in _RATIOS}, "engineered",
               ["n_sentinel", "max"]),
)
def _(spark, d):
    return comparable(pf.sentinel_report(engineered(spark, d), _RATIOS))


@catalog.add(
    "class_ratio",
    f"""{APPS} select count(case when is_default = 0 then 1 end) as negatives,
    count(case when is_default = 1 then 1 end) as positives, round(count(case when is_default = 0 then 1 end) * 1.0
    / count(case when is_default = 1 then 1 end), 4) as ratio from applications""",
)
def _(spark, d):
    return comparable(pf.class_ratio(b.applications(spark, d), "is_default"))


@catalog.add("shape", f"{APPS} select count(*) as n_rows, 27 as n_columns from applications")
def _(spark, d):
    return pf.shape(b.applications(spark, d))


_PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
         ("p_size", "int"), ("p_retailprice", "double")]


@catalog.add(
    "info",
    _stacked({c: [str(i), f"'{t}'", f"count({c})"] for i, (c, t) in enumerate(_PART)}, "part",
             ['"position"', '"type"', "n_known"]),
)
def _(spark, d):
    return pf.info(b.table(spark, d, "part"))


_TEXTS = ["gender", "marital_status", "education_level", "residential_status", "employment_type", "loan_purpose"]


@catalog.add(
    "profile",
    f"{APPS} "
    + " union all ".join(
        f"select '{c}' as column_name, {c} as value, count(*) as n from applications where {c} is not null group by {c}"
        for c in _TEXTS
    ),
)
def _(spark, d):
    """Every value of every category column with its count, out of the profile tables."""
    apps = b.applications(spark, d).select(*_TEXTS, "is_default")
    return pf.profile(apps, "is_default")["counts"]()


@catalog.add(
    "profile_top",
    f"""{APPS}, counted as ({" union all ".join(
        f"select '{c}' as column_name, {c} as value, count(*) as n from applications group by {c}" for c in _TEXTS)}),
    placed as (select *, row_number() over (partition by column_name order by n desc, value) as place from counted)
    select column_name, value, n from placed where place <= 10""",
)
def _(spark, d):
    """The ten most frequent values of every category column, taken from the profile tables."""
    tables = pf.profile(b.applications(spark, d), "is_default")
    tops = [
        tables[f"top_{c}"]().select(F.lit(c).alias("column_name"), F.col(c).alias("value"), "n") for c in _TEXTS
    ]
    joined = tops[0]
    for top in tops[1:]:
        joined = joined.unionByName(top)
    return joined
