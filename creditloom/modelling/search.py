"""Random search with stratified cross-validation over boosted trees."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import md5

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.modelling.metrics import roc_auc
from creditloom.modelling.models import boosted, score
from creditloom.modelling.split import stratified_folds
from creditloom.session import discard, exists, scratch_dir, stored


@dataclass(frozen=True)
class SearchSpace:
    """The ranges drawn from; integer ranges leave out their end.

    ``column_share`` is per node, ``min_gain`` and ``min_rows`` are the nearest things Spark's trees have to the
    usual loss-reduction and child-weight limits.
    """

    rounds: tuple[int, int] = (100, 1000)
    rate: tuple[float, float] = (0.01, 0.21)
    depth: tuple[int, int] = (3, 10)
    row_share: tuple[float, float] = (0.6, 1.0)
    column_share: tuple[float, float] = (0.6, 1.0)
    min_gain: tuple[float, float] = (0.0, 0.5)
    min_rows: tuple[int, int] = (1, 10)

    def draw(self, rng: random.Random) -> dict:
        return {
            "maxIter": rng.randrange(*self.rounds),
            "stepSize": rng.uniform(*self.rate),
            "maxDepth": rng.randrange(*self.depth),
            "subsamplingRate": rng.uniform(*self.row_share),
            "featureSubsetStrategy": f"{rng.uniform(*self.column_share):.6f}",
            "minInfoGain": rng.uniform(*self.min_gain),
            "minInstancesPerNode": rng.randrange(*self.min_rows),
        }


@dataclass
class Search:
    """A finished search: every draw with its mean ROC-AUC over the folds, and the best draw fitted on all rows."""

    draws: list[dict]
    avgMetrics: list[float]
    bestModel: Model
    ledger: str


def _search_id(parts: DataFrame, label: str, key: str, *settings) -> str:
    """Names a search by its settings and its rows, so that a ledger never answers for another one."""
    rows = parts.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, label, "fold")).alias("rows")).first()
    return md5(repr((rows.n, rows.rows, label, key, *settings)).encode()).hexdigest()


def fits(spark: SparkSession, ledger: str, search: str | None = None) -> DataFrame:
    """(search, draw, fold, settings, roc_auc): the fits that a ledger holds, of one search or of all."""
    kinds = "settings string, roc_auc double, search string, draw int, fold int"
    if not exists(spark, ledger):
        return spark.createDataFrame([], kinds).select("search", "draw", "fold", "settings", "roc_auc")
    found = spark.read.schema(kinds).parquet(ledger).select("search", "draw", "fold", "settings", "roc_auc")
    return found if search is None else found.where(F.col("search") == search)


def random_search(
    train: DataFrame,
    label: str,
    key: str,
    space: SearchSpace = SearchSpace(),
    draws: int = 100,
    folds: int = 5,
    seed: int = 42,
    weight: str = "weight",
    parallelism: int = 4,
    ledger: str | None = None,
) -> Search:
    """Fits every draw on every fold, compares mean ROC-AUC, and refits the best (the first on a tie) on all rows.

    Folds are made once and stored. Each finished fit is one small file of ``ledger``, a folder that driver and executors
    share (a scratch folder if not given); written whole or not at all. A search that was lost goes on where it stopped
    when it is started again with the same rows, settings and ledger: fits found there are not repeated. A fold
    without rows of both classes has no ROC-AUC, and its draw is never the best.
    """
    spark = train.sparkSession
    rng = random.Random(seed)
    drawn = [space.draw(rng) for _ in range(draws)]
    parts = stored(stratified_folds(train, label, key, folds, seed), "folds")
    ledger = ledger or scratch_dir(spark, "search")
    search = _search_id(parts, label, key, space, draws, folds, seed, weight)
    known = {(r.draw, r.fold): r.roc_auc for r in fits(spark, ledger, search).collect()}  # one row per fit

    def fit(place: tuple[int, int]) -> tuple[tuple[int, int], float]:
        draw, fold = place
        model = boosted(label, weight, seed, **drawn[draw]).fit(parts.where(F.col("fold") != fold))
        area = roc_auc(score(model, parts.where(F.col("fold") == fold), label), label).first()[0]
        area = float("nan") if area is None else area
        row = spark.createDataFrame([(json.dumps(drawn[draw], sort_keys=True), area)], "settings string, roc_auc double")
        row.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/search={search}/draw={draw}/fold={fold}")
        return place, area

    open_ = [(d, f) for d in range(draws) for f in range(folds) if (d, f) not in known]
    with ThreadPoolExecutor(parallelism) as pool:
        known |= dict(pool.map(inheritable_thread_target(spark)(fit), open_))
    means = [sum(known[d, f] for f in range(folds)) / folds for d in range(draws)]
    best = max(range(draws), key=lambda d: (means[d] == means[d], means[d], -d))
    model = boosted(label, weight, seed, **drawn[best]).fit(train)
    discard(parts)
    return Search(drawn, means, model, ledger)


def search_result(spark, search: Search) -> DataFrame:
    """One row per draw with its parameters and mean ROC-AUC, best first."""
    names = sorted(search.draws[0])
    rows = [(i, float(m), *[str(d[n]) for n in names]) for i, (d, m) in enumerate(zip(search.draws, search.avgMetrics))]
    schema = "draw int, mean_roc_auc double, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema).orderBy(F.desc("mean_roc_auc"), "draw")
