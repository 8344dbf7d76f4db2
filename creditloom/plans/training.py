"""Training jobs: one wide view, its preparation, models, evaluation, saving and batch scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.dates import parse_date
from creditloom.modelling import metrics, models
from creditloom.modelling.search import Search, SearchSpace, random_search
from creditloom.modelling.split import stratified_split
from creditloom.operators import encoding as en
from creditloom.operators.assemble import ENGINEERED
from creditloom.operators.selection import cols_of_type, scalable_columns
from creditloom.session import stored

KEY, LABEL = "loan_id", "is_default"

# Which columns of the view come from which table, and under which prefix.
RAW_COLUMNS = ("loan_id", "customer_id", "application_date", "loan_amount_requested", "loan_term_months",
               "loan_purpose", "is_default")
RAW_PREFIXED = ("age", "emi_requested", "collateral_flag", "collateral_value", "loan_to_value_ratio",
                "other_emi_declared", "debt_service_ratio_declared", "has_credit_history")
CUSTOMER_COLUMNS = ("gender", "marital_status", "education_level", "residential_status", "is_urban_residence",
                    "pincode")
FEATURE_COLUMNS = ("age", "num_dependents", "time_at_current_address_months", "time_at_current_job_months",
                   "monthly_gross_income", "declared_monthly_expenses", "emi_requested", "collateral_flag",
                   "collateral_value", "loan_to_value_ratio", "other_emi_declared", "debt_service_ratio_declared",
                   "has_credit_history", *ENGINEERED)

# Columns turned into dummies, and flags that are not scaled.
DUMMIES = ("loan_purpose", "gender", "marital_status", "education_level", "residential_status")
FLAGS = ("rla_collateral_flag", "rla_has_credit_history", "is_urban_residence", "has_credit_history",
         "collateral_flag", "ever_defaulted_flag", "has_recurring_salary_flag", "has_investment_transactions_flag",
         "is_application_date_missing", "debt_to_income_ratio_computed_is_999")
DTI = "debt_to_income_ratio_computed"


def training_view(applications: DataFrame, customers: DataFrame, features: DataFrame) -> DataFrame:
    """Raw applications, customer demographics and engineered features side by side: 70 columns."""
    a, c, f = applications.alias("a"), customers.alias("c"), features.alias("f")
    return (
        a.join(f, F.col("a.loan_id") == F.col("f.loan_id"))
        .join(c, F.col("a.customer_id") == F.col("c.customer_id"))
        .select(
            *[F.col(f"a.{n}") for n in RAW_COLUMNS],
            *[F.col(f"a.{n}").alias(f"rla_{n}") for n in RAW_PREFIXED],
            *[F.col(f"c.{n}") for n in CUSTOMER_COLUMNS],
            *[F.col(f"f.{n}") for n in FEATURE_COLUMNS],
        )
    )


@dataclass
class Preparation:
    """Fitted steps from the training view to a numeric table with key and label."""

    columns: list[str]
    steps: list[en.Step] = field(default_factory=list)

    def transform(self, view: DataFrame) -> DataFrame:
        return en.apply_steps(view.select(*self.columns), self.steps)

    @property
    def outputs(self) -> list[str]:
        names = self.columns
        for step in self.steps:
            names = step.columns(names)
        return names

    @property
    def inputs(self) -> list[str]:
        """Model inputs: everything but key and label."""
        return [c for c in self.outputs if c not in (KEY, LABEL)]

    def stages(self) -> list:
        return [*models.sql_stages(self.steps, self.columns), models.assembler(self.inputs)]


def with_parsed_date(view: DataFrame, fmt: str | None = None) -> DataFrame:
    """Application date as a date; text that is none becomes null."""
    if dict(view.dtypes)["application_date"] != "string":
        return view
    return view.withColumn("application_date", parse_date(F.col("application_date"), fmt, strict=False))


def fit_preparation(view: DataFrame) -> Preparation:
    """Learns categories, fill values and scales from the given rows. Hand in the training rows only, or all rows to
    repeat a preparation that is fitted before the split."""
    columns = [c for c in view.columns if c not in ("customer_id", "pincode")]
    table = view.select(*columns)
    done = Preparation(columns)

    def add(step: en.Step) -> None:
        nonlocal table
        done.steps.append(step)
        table = step.transform(table)

    add(en.fit_one_hot(table, list(DUMMIES), drop_first=True, as_boolean=True, null_category=False))
    date = "`application_date`"
    parts = {
        "application_month": f"month({date})",
        "application_day_of_week": f"weekday({date})",
        "application_year": f"year({date})",
        "application_day_of_month": f"dayofmonth({date})",
        "is_application_date_missing": f"cast({date} is null as int)",
    }
    add(en.Expressions(drops=("application_date",), made=parts))
    add(en.fit_mode(table, list(parts)[:4], cast="int"))
    add(en.sentinel_to_null(DTI))
    add(en.fit_median(table, [DTI]))
    add(en.fit_standardize(table, scalable_columns(table, exclude=(*FLAGS, KEY, LABEL))))
    # what is still missing: 0 is the mean of a standardised column and the absence of a flag
    types = dict(table.dtypes)
    add(en.Impute(values={c: f"cast(0 as {types[c]})" for c in cols_of_type(table, "number") if c not in (KEY, LABEL)}))
    return done


@dataclass
class Trained:
    """What a training run leaves: the saved-ready pipelines, scored test rows and the preparation."""

    pipelines: dict[str, PipelineModel]
    scored: dict[str, DataFrame]
    preparation: Preparation
    areas: dict[str, float] = field(default_factory=dict)

    def auc(self, name: str) -> float:
        if name not in self.areas:
            self.areas[name] = metrics.roc_auc(self.scored[name], LABEL).first()[0]
        return self.areas[name]

    def report(self, name: str, threshold: float | None = None) -> DataFrame:
        rows = self.scored[name]
        if threshold is not None:
            rows = metrics.classify_at(rows, threshold)
        return metrics.classification_report(rows, LABEL)

    def confusion(self, name: str, threshold: float | None = None) -> DataFrame:
        rows = self.scored[name]
        return metrics.confusion(rows if threshold is None else metrics.classify_at(rows, threshold), LABEL)

    def curve(self, name: str) -> DataFrame:
        return metrics.pr_curve(self.scored[name], LABEL)


def prepared_split(
    view: DataFrame, seed: int = 42, fit_on: str = "train"
) -> tuple[Preparation, DataFrame, DataFrame, DataFrame]:
    """(preparation, training rows with vector, raw training rows, raw test rows), read from a stored view."""
    kept = stored(with_parsed_date(view), "training-view")
    train, test = stratified_split(kept, LABEL, KEY, seed)
    preparation = fit_preparation(train if fit_on == "train" else kept)
    vectors = models.assembler(preparation.inputs).transform(preparation.transform(train))
    return preparation, stored(vectors.select(KEY, LABEL, models.FEATURES), "training-rows"), train, test


def train_evaluate(
    view: DataFrame, seed: int = 42, fit_on: str = "train", kinds: tuple[str, ...] = ("logistic", "forest", "boosted"),
    params: dict[str, dict] | None = None,
) -> Trained:
    """Fits the named classifiers on 80 % of every class and scores the other 20 %."""
    params = params or {}
    preparation, train, _, test = prepared_split(view, seed, fit_on)
    fitted = {}
    # the forest is the largest to hold, so the others come first
    for kind in sorted(kinds, key=lambda kind: kind == "forest"):
        extra = params.get(kind, {})
        if kind == "logistic":
            fitted[kind] = models.fit_logistic(train, LABEL, **extra)
        elif kind == "forest":
            weighted = metrics.with_class_weight(train, LABEL, "balanced")
            fitted[kind] = models.fit_forest(weighted, LABEL, seed=seed, **extra)
        elif kind == "boosted":
            weighted = metrics.with_class_weight(train, LABEL, "positive_ratio")
            fitted[kind] = models.fit_boosted(weighted, LABEL, seed=seed, **extra)
        else:
            raise ValueError(f"unknown classifier {kind}")
    pipelines = {k: PipelineModel([*preparation.stages(), fitted[k]]) for k in kinds}
    # stored, as every metric reads the scores several times
    scored = {k: stored(models.score(p, test, KEY, LABEL), f"scored-{k}") for k, p in pipelines.items()}
    return Trained(pipelines, scored, preparation)


def train_evaluate_save(view: DataFrame, path: str, save: str = "boosted", **settings) -> Trained:
    """As ``train_evaluate``, and keeps the named pipeline. The test rows have no say in which one that is."""
    trained = train_evaluate(view, **settings)
    models.save_model(trained.pipelines[save], path)
    return trained


def tune_evaluate_save(
    view: DataFrame, path: str, space: SearchSpace = SearchSpace(), draws: int = 100, folds: int = 5, seed: int = 42,
    fit_on: str = "train", ledger: str | None = None,
) -> tuple[Trained, Search]:
    """Searches boosted trees on the training rows, scores the test rows with the best draw, and saves it together with
    its preparation as one pipeline (``Trained`` holds it under "tuned"). With a ``ledger`` a lost search goes on where
    it stopped."""
    preparation, train, _, test = prepared_split(view, seed, fit_on)
    weighted = metrics.with_class_weight(train, LABEL, "positive_ratio")
    found = random_search(weighted, LABEL, KEY, space, draws, folds, seed, ledger=ledger)
    pipeline = PipelineModel([*preparation.stages(), found.bestModel])
    models.save_model(pipeline, path)
    scored = stored(models.score(pipeline, test, KEY, LABEL), "scored-tuned")
    return Trained({"tuned": pipeline}, {"tuned": scored}, preparation), found


def score_batch(model: PipelineModel | str, view: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Key, probability and class for new rows of the view. The saved pipeline brings its own preparation."""
    pipeline = models.load_model(model) if isinstance(model, str) else model
    rows = with_parsed_date(view)
    if LABEL not in rows.columns:
        rows = rows.withColumn(LABEL, F.lit(None).cast("int"))
    scored = models.score(pipeline, rows, KEY).drop("prediction")
    return metrics.classify_at(scored, threshold)
