"""Queries on preparation, splitting, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.catalog import bindings as b
from creditloom.catalog.features import (
    APPLICATION_MONEY,
    APPLICATION_PLAIN,
    APPLICATION_RATIOS,
    ENGINEERED_SQL,
    engineered,
)
from creditloom.catalog.kit import Catalog, comparable
from creditloom.modelling import metrics, models, oversampling, split
from creditloom.operators.assemble import ENGINEERED
from creditloom.operators.profiling import value_counts
from creditloom.plans import jobs, training
from creditloom.session import scratch_dir, stored

catalog = Catalog()

# ---------------------------------------------------------------- the wide view


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return b.applications(spark, d).select("customer_id", *training.CUSTOMER_COLUMNS)


def _view(spark: SparkSession, d: str) -> DataFrame:
    return training.training_view(b.applications(spark, d), _customers(spark, d), engineered(spark, d))


_VIEW = f"""{ENGINEERED_SQL}, view as (
 select a.loan_id, a.customer_id, a.application_date, cast(a.loan_amount_requested as double) as loan_amount_requested,
  a.loan_term_months, a.loan_purpose, a.is_default, a.age as rla_age,
  cast(a.emi_requested as double) as rla_emi_requested, a.collateral_flag as rla_collateral_flag,
  cast(a.collateral_value as double) as rla_collateral_value, a.loan_to_value_ratio as rla_loan_to_value_ratio,
  cast(a.other_emi_declared as double) as rla_other_emi_declared,
  a.debt_service_ratio_declared as rla_debt_service_ratio_declared, a.has_credit_history as rla_has_credit_history,
  {", ".join(f"c.{n}" for n in training.CUSTOMER_COLUMNS)}, {", ".join(f"f.{n}" for n in training.FEATURE_COLUMNS)}
 from applications a join applications c on a.customer_id = c.customer_id
  join engineered f on a.loan_id = f.loan_id)"""

_VIEW_REAL = {
    "loan_amount_requested", "rla_emi_requested", "rla_collateral_value", "rla_loan_to_value_ratio",
    "rla_other_emi_declared", "rla_debt_service_ratio_declared", *APPLICATION_MONEY, *APPLICATION_RATIOS,
    "total_sanctioned_limit", "total_outstanding_balance", "overall_credit_utilization_ratio",
    "avg_account_age_months", "avg_monthly_net_income_6m", "std_dev_monthly_net_income_6m",
    "avg_monthly_essential_expenses_6m", "avg_monthly_discretionary_expenses_6m",
    "essential_to_discretionary_spend_ratio", "avg_monthly_balance_min_6m", "avg_monthly_savings_transfers_6m",
    "detected_other_emis_sum", *ENGINEERED[-4:],
}

_VIEW_NAMES = (
    *training.RAW_COLUMNS,
    *[f"rla_{n}" for n in training.RAW_PREFIXED],
    *training.CUSTOMER_COLUMNS,
    *training.FEATURE_COLUMNS,
)


def _view_item(n: str) -> str:
    if n == "application_date":
        return f"strftime({n}, '%Y-%m-%d') as {n}"
    return f"round({n}, 4) as {n}" if n in _VIEW_REAL else n


@catalog.add("training_view", f"{_VIEW} select {', '.join(_view_item(n) for n in _VIEW_NAMES)} from view")
def _(spark, d):
    return comparable(_view(spark, d))


_PREPARED = [n for n in _VIEW_NAMES if n not in ("customer_id", "pincode", "application_date", *training.DUMMIES)]
_PARTS = {
    "application_month": "month(application_date)",
    "application_day_of_week": "isodow(application_date) - 1",
    "application_year": "year(application_date)",
    "application_day_of_month": "day(application_date)",
}
_UNSCALED = {*training.FLAGS, training.KEY, training.LABEL}
_CATEGORIES = {
    "loan_purpose": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "gender": ("Female", "Male", "Other"),
    "marital_status": ("Divorced", "Married", "Single", "Widowed"),
    "education_level": ("Doctorate", "Graduate", "High School"),
    "residential_status": ("R0", "R1", "R2", "R3", "R4"),
}
_DTI = training.DTI


def _scaled(n: str) -> str:
    """Standardised where more than two values occur, as it is otherwise."""
    if n in _UNSCALED:
        return n
    x = f"cast({n} as double)"
    return f"round(({x} - m_{n}) / d_{n}, 4) as {n}"


_NUMERIC = [n for n in (*_PREPARED, *_PARTS) if n not in _UNSCALED]
_PREPARE = f"""{_VIEW}, marked as (
 select * exclude ({_DTI}), nullif({_DTI}, 999) as {_DTI},
  cast(case when {_DTI} = 999 then 1 else 0 end as integer) as {_DTI}_is_999,
  0 as is_application_date_missing, {", ".join(f"cast({e} as integer) as {n}" for n, e in _PARTS.items())} from view),
 filled as (
 select * exclude ({_DTI}), coalesce({_DTI}, (select median({_DTI}) from marked)) as {_DTI} from marked),
 moments as (
 select {", ".join(f"case when count(distinct {n}) > 2 then avg(cast({n} as double)) else 0 end as m_{n}, "
                   f"case when count(distinct {n}) > 2 then stddev_pop(cast({n} as double)) else 1 end as d_{n}"
                   for n in _NUMERIC)} from filled)"""

_DUMMY_ITEMS = [f"{c} = '{v}' as \"{c}_{v}\"" for c, values in _CATEGORIES.items() for v in values[1:]]


@catalog.add(
    "prepare_training",
    f"""{_PREPARE} select {", ".join(_scaled(n) for n in (*_PREPARED, *_PARTS))}, is_application_date_missing,
    {_DTI}_is_999, {", ".join(_DUMMY_ITEMS)} from filled, moments""",
)
def _(spark, d):
    """The prepared table with every step fitted on all rows. Columns left unscaled are compared as doubles too."""
    view = stored(_view(spark, d), "training-view")
    prepared = training.fit_preparation(view).transform(view)
    return comparable(prepared.withColumns({n: F.col(n).cast("double") for n in _NUMERIC}))


_ENCODED_TEXTS = ("gender", "marital_status", "education_level", "residential_status", "employment_type", "loan_purpose")
_ENCODED_VALUES = {
    **{c: _CATEGORIES[c] for c in _CATEGORIES},
    "employment_type": ("Retired", "Salaried", "Self-employed", "Unemployed"),
}
_DUMMY_NAMES = [(f"{c}_{v}", c, v) for c in _ENCODED_TEXTS for v in _ENCODED_VALUES[c]]
_NUMBERS = [
    n
    for n in (*APPLICATION_PLAIN, *APPLICATION_MONEY, *APPLICATION_RATIOS, *ENGINEERED)
    if n not in (*_ENCODED_TEXTS, "pincode")
]
_WRITTEN_SCALED = [n for n in (*[x for x, _, _ in _DUMMY_NAMES], *_NUMBERS) if n not in jobs.NOT_SCALED]


@catalog.add(
    "encode_scale_write",
    f"""{ENGINEERED_SQL}, encoded as (select {", ".join(_NUMBERS)},
     {", ".join(f"cast({c} = '{v}' as integer) as \"{n}\"" for n, c, v in _DUMMY_NAMES)} from engineered)
    select {", ".join(n for n in _NUMBERS if n in jobs.NOT_SCALED)},
    {", ".join(f'round((cast("{n}" as double) - avg(cast("{n}" as double)) over ()) / '
               f'(case when stddev_pop(cast("{n}" as double)) over () = 0 then 1 '
               f'else stddev_pop(cast("{n}" as double)) over () end), 4) as "{n}"' for n in _WRITTEN_SCALED)}
    from encoded""",
)
def _(spark, d):
    """Encoded, scaled and written as Parquet, then read back."""
    path = scratch_dir(spark, "modelling-table")
    jobs.encode_scale_write(stored(engineered(spark, d), "engineered"), path)
    return comparable(spark.read.parquet(path))


# ---------------------------------------------------------------- splitting

_APPS = b.common_tables("applications")
_SPLIT = f"""{_APPS}, placed as (
 select loan_id, is_default, row_number() over (partition by is_default
   order by md5('42:' || cast(loan_id as varchar)), loan_id) as place,
  count(*) over (partition by is_default) as total from applications),
 split as (select *, place <= round(total * 0.2) as is_test from placed)"""


@catalog.add("stratified_split", f"{_SPLIT} select loan_id, is_default, is_test from split")
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", "is_default")
    return split.mark_test(apps, "is_default", "loan_id", seed=42, percent=20)


@catalog.add(
    "stratified_folds",
    f"""{_SPLIT} select loan_id, is_default, cast((select count(*) from range(1, 5) r(i)
    where place > floor(total * i / 5.0)) as integer) as fold from split""",
)
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", "is_default")
    return split.stratified_folds(apps, "is_default", "loan_id", folds=5, seed=42)


@catalog.add(
    "split_shares",
    f"""{_SPLIT}, parts as (select 'all' as part, is_default from split union all
     select case when is_test then 'test' else 'train' end, is_default from split)
    select part, is_default, round(count(*) * 100.0 / sum(count(*)) over (partition by part), 4) as percent
    from parts group by part, is_default""",
)
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", "is_default")
    train, test = split.stratified_split(apps, "is_default", "loan_id")
    shares = [
        value_counts(part, "is_default", normalize=True).withColumn("part", F.lit(name))
        for name, part in (("all", apps), ("train", train), ("test", test))
    ]
    return comparable(shares[0].unionByName(shares[1]).unionByName(shares[2]))


@catalog.add(
    "class_weights",
    f"""{_APPS}, counted as (select count(*) as n, sum(is_default) as pos from applications)
    select loan_id, round(case when is_default = 1 then n / (2.0 * pos) else n / (2.0 * (n - pos)) end, 4) as balanced,
    round(case when is_default = 1 then (n - pos) * 1.0 / pos else 1 end, 4) as positive_ratio
    from applications, counted""",
)
def _(spark, d):
    apps = b.applications(spark, d).select("loan_id", "is_default")
    balanced = metrics.with_class_weight(apps, "is_default", "balanced", "balanced")
    return comparable(
        metrics.with_class_weight(balanced, "is_default", "positive_ratio", "positive_ratio").drop("is_default")
    )


# ---------------------------------------------------------------- over-sampling

_SAMPLED = ["age", "monthly_gross_income", "loan_amount_requested"]
_REAL = [f"cast({c} as double)" for c in _SAMPLED]
_NEAR = f"""{_APPS}, bases as (
 select loan_id as key, {", ".join(f"{r} as {c}" for c, r in zip(_SAMPLED, _REAL))} from applications where is_default = 1
  and {" and ".join(f"{c} is not null" for c in _SAMPLED)}),
 spread as (select {", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in _SAMPLED)} from bases),
 points as (select min(key) as point, {", ".join(_SAMPLED)} from bases group by {", ".join(_SAMPLED)}),
 pairs as (
 select a.point, b.point as other,
  round(sqrt({" + ".join(f"(a.{c} / s_{c} - b.{c} / s_{c}) * (a.{c} / s_{c} - b.{c} / s_{c})" for c in _SAMPLED)}), 6) as distance
 from points a join points b on a.point <> b.point, spread),
 near as (
 select * from (select *, row_number() over (partition by point order by distance, other) as place from pairs) p where place <= 5)"""


def _hex(start: int) -> str:
    """Eight hexadecimal digits as a number."""
    return " + ".join(
        f"(strpos('0123456789abcdef', substr(h, {start + i}, 1)) - 1) * {16 ** (7 - i)}::bigint" for i in range(8)
    )


@catalog.add(
    "minority_neighbours", f"{_NEAR} select point as loan_id, cast(place as integer) as place, other, round(distance, 4) as distance from near"
)
def _(spark, d):
    """The five nearest other defaulters of each, exact."""
    apps = b.applications(spark, d)
    return comparable(oversampling.minority_neighbours(apps, "is_default", "loan_id", _SAMPLED, rounds=None))


@catalog.add(
    "oversample",
    f"""{_NEAR}, sizes as (
     select greatest(0, cast(floor(0.8 * count(case when is_default <> 1 then 1 end)) as bigint)
      - count(case when is_default = 1 then 1 end)) as lacking, (select count(*) from bases) as n from applications),
     ordered as (select *, row_number() over (order by md5('42:' || cast(key as varchar)), key) - 1 as r from bases),
     shares as (select o.*, lacking // n + cast(r < lacking % n as integer) as copies from ordered o, sizes),
     draws as (select *, md5('42:' || cast(key as varchar) || ':' || cast(draw as varchar)) as h
      from (select *, unnest(range(1, copies + 1)) as draw from shares) x),
     numbers as (select *, {_hex(1)} as pick, ({_hex(9)}) / 4294967296.0::double as share from draws),
     located as (select n.*, p.point from numbers n join points p on {" and ".join(f"n.{c} = p.{c}" for c in _SAMPLED)}),
     chosen as (select l.*, e.other from located l join (select point, count(*) as held from near group by point) c
      on c.point = l.point join near e on e.point = l.point and e.place = l.pick % c.held + 1)
    select c.key as base, cast(draw as integer) as draw, c.other, round(share, 6) as share,
    {", ".join(f"round(c.{x} + share * (e.{x} - c.{x}), 6) as {x}" for x in _SAMPLED)}
    from chosen c join points e on e.point = c.other""",
)
def _(spark, d):
    """New defaulters until there are 0.8 for each other application."""
    apps = b.applications(spark, d)
    return comparable(oversampling.synthetic_rows(apps, "is_default", "loan_id", _SAMPLED, ratio=0.8, rounds=None), 6)


# ---------------------------------------------------------------- metrics on given scores

_SCORED = b.common_tables("scored")
_THRESHOLD = 1500.0
_CLASSED = f"{_SCORED}, classed as (select *, cast(score >= 1500 as integer) as prediction from scored)"


@catalog.add("classify_at", f"{_CLASSED} select key, prediction from classed")
def _(spark, d):
    return metrics.classify_at(b.scored_rows(spark, d), _THRESHOLD).select("key", "prediction")


@catalog.add(
    "confusion",
    f"""{_CLASSED}, cells as (select l.v as label, p.v as prediction from (select unnest([0, 1]) as v) l,
     (select unnest([0, 1]) as v) p)
    select e.label, e.prediction, count(c.key) as n from cells e left join classed c
    on e.label = c.label and e.prediction = c.prediction group by e.label, e.prediction""",
)
def _(spark, d):
    return metrics.confusion(metrics.classify_at(b.scored_rows(spark, d), _THRESHOLD))


@catalog.add(
    "classification_report",
    f"""{_CLASSED}, per_class as (
     select v as k, count(case when label = v then 1 end) as support,
      coalesce(count(case when label = v and prediction = v then 1 end) * 1.0
       / nullif(count(case when prediction = v then 1 end), 0), 0) as p,
      coalesce(count(case when label = v and prediction = v then 1 end) * 1.0
       / nullif(count(case when label = v then 1 end), 0), 0) as r
     from classed, (select unnest([0, 1]) as v) u group by v),
    scored_class as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from per_class)
    select cast(k as varchar) as class, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1, support
    from scored_class
    union all select 'accuracy', null, null, round(avg(cast(label = prediction as integer)), 4), count(*) from classed
    union all select 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), cast(sum(support) as bigint)
    from scored_class
    union all select 'weighted avg', round(sum(p * support) / sum(support), 4),
    round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), cast(sum(support) as bigint)
    from scored_class""",
)
def _(spark, d):
    return comparable(metrics.classification_report(metrics.classify_at(b.scored_rows(spark, d), _THRESHOLD)))


@catalog.add(
    "roc_auc",
    f"""{_SCORED} select round(sum(case when p.score > n.score then 1.0 when p.score = n.score then 0.5 else 0 end)
    / count(*), 10) as roc_auc from (select score from scored where label = 1) p,
    (select score from scored where label = 0) n""",
)
def _(spark, d):
    return comparable(metrics.roc_auc(b.scored_rows(spark, d)), 10)


@catalog.add(
    "pr_curve",
    f"""{_SCORED}, thresholds as (select distinct score as threshold from scored),
    points as (select threshold, count(case when label = 1 then 1 end) * 1.0 / count(*) as precision,
      count(case when label = 1 then 1 end) * 1.0 / (select count(*) from scored where label = 1) as recall
     from thresholds join scored on score >= threshold group by threshold)
    select threshold, round(precision, 6) as precision, round(recall, 6) as recall from points
    union all select null, 1, 0""",
)
def _(spark, d):
    return comparable(metrics.pr_curve(b.scored_rows(spark, d)), 6)


# ---------------------------------------------------------------- models, at the library's own settings


def _fitted(spark: SparkSession, d: str, kind: str):
    preparation, train, _, test = training.prepared_split(_view(spark, d))
    if kind == "logistic":
        model = models.fit_logistic(train, training.LABEL)
    elif kind == "forest":
        model = models.fit_forest(metrics.with_class_weight(train, training.LABEL, "balanced"), training.LABEL)
    else:
        model = models.fit_boosted(metrics.with_class_weight(train, training.LABEL, "positive_ratio"), training.LABEL)
    pipeline = models.PipelineModel([*preparation.stages(), model])
    return pipeline, model, preparation, test


def _model_query(name: str, kind: str):
    @catalog.add(name)
    def _(spark, d):
        pipeline, _, _, test = _fitted(spark, d, kind)
        return models.score(pipeline, test, training.KEY, training.LABEL)


_model_query("logistic_scores", "logistic")
_model_query("forest_scores", "forest")
_model_query("boosted_scores", "boosted")


@catalog.add("feature_importances")
def _(spark, d):
    _, model, preparation, _ = _fitted(spark, d, "forest")
    return models.importances(spark, model, preparation.inputs)


@catalog.add("model_round_trip", f"{_SPLIT} select loan_id, true as same_score from split where is_test")
def _(spark, d):
    """Whether every test row has the same score before saving and after loading."""
    pipeline, _, _, test = _fitted(spark, d, "logistic")
    path = scratch_dir(spark, "model")
    models.save_model(pipeline, path)
    before = models.score(pipeline, test, training.KEY).select(training.KEY, F.col("score").alias("before"))
    after = models.score(models.load_model(path), test, training.KEY).select(training.KEY, F.col("score").alias("after"))
    return before.join(after, training.KEY).select(training.KEY, (F.col("before") == F.col("after")).alias("same_score"))


@catalog.add(
    "score_batch",
    f"{_APPS} select loan_id, true as has_probability, true as has_class from applications",
)
def _(spark, d):
    """A saved pipeline, loaded and applied to the whole view at a threshold of 0.30: what every row must have."""
    pipeline, _, _, _ = _fitted(spark, d, "forest")
    path = scratch_dir(spark, "model")
    models.save_model(pipeline, path)
    del pipeline  # else the driver holds the forest twice
    scored = training.score_batch(path, _view(spark, d), threshold=0.30)
    return scored.select(
        training.KEY, F.col("score").between(0, 1).alias("has_probability"),
        (F.col("prediction") == (F.col("score") >= 0.30).cast("int")).alias("has_class"),
    )


@catalog.add("train_evaluate_save")
def _(spark, d):
    """One row per classifier: confusion on the test rows, area under the curve, and whether it was saved."""
    trained = training.train_evaluate_save(_view(spark, d), scratch_dir(spark, "model"), save="boosted")

    def cell(label: int, prediction: int):
        return F.max(F.when((F.col("label") == label) & (F.col("prediction") == prediction), F.col("n")))

    rows = [
        trained.confusion(kind).agg(*[cell(l, p).alias(f"n{l}{p}") for l in (0, 1) for p in (0, 1)]).select(
            F.lit(kind).alias("classifier"), "*", F.lit(trained.auc(kind)).alias("roc_auc"), F.lit(kind == "boosted").alias("saved")
        )
        for kind in trained.scored
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
