"""Training, tuning, saving and scoring on the small tables."""

import pytest
from pyspark.sql import functions as F

from creditloom.catalog import models as registered
from creditloom.modelling import metrics, models
from creditloom.modelling.search import SearchSpace, random_search, search_result
from creditloom.plans import training
from creditloom.session import stored

FOLDER = "/root/testdata/sf0.01"
SMALL = {"forest": {"numTrees": 10, "maxDepth": 5}, "boosted": {"maxIter": 5, "maxDepth": 3}}


@pytest.fixture(scope="module")
def view(spark):
    return stored(registered._view(spark, FOLDER), "view")


@pytest.fixture(scope="module")
def trained(view, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "best")
    return training.train_evaluate_save(view, path, save="forest", params=SMALL), path


def test_models_beat_chance(trained):
    run, _ = trained
    assert set(run.pipelines) == {"logistic", "forest", "boosted"}
    for kind in run.pipelines:
        assert run.auc(kind) > 0.6, kind


def test_label_and_key_are_no_inputs(trained):
    run, _ = trained
    inputs = run.preparation.inputs
    assert not {"is_default", "loan_id", "customer_id", "pincode", "application_date"} & set(inputs)
    assert "debt_to_income_ratio_computed_is_999" in inputs and "loan_purpose_BUILDING" in inputs
    assert "loan_purpose_AUTOMOBILE" not in inputs


def test_reports(trained):
    run, _ = trained
    rows = {r["class"]: r for r in run.report("forest", threshold=0.3).collect()}
    assert rows["accuracy"].support == rows["0"].support + rows["1"].support == run.scored["forest"].count()


def test_saved_pipeline_scores_raw_rows_alike(trained, view):
    run, path = trained
    expected = {r.loan_id: r.score for r in run.scored["forest"].collect()}
    found = {r.loan_id: r.score for r in training.score_batch(path, view.drop("is_default")).collect()}
    assert len(found) == view.count()
    for key, score in expected.items():
        assert found[key] == pytest.approx(score, rel=1e-12)


def test_test_rows_do_not_move_the_preparation(view):
    """Fitted on train only: wild values in the test rows leave every fitted state as it was."""
    from creditloom.modelling.split import mark_test

    marked = mark_test(view, "is_default", "loan_id")
    wild = marked.withColumn("monthly_gross_income", F.when(F.col("is_test"), 1e12).otherwise(F.col("monthly_gross_income")))
    first = training.fit_preparation(marked.where("not is_test").drop("is_test"))
    second = training.fit_preparation(wild.where("not is_test").drop("is_test"))
    everything = training.fit_preparation(wild.drop("is_test"))
    scaled, again, wide = (
        next(s.moments for s in p.steps if hasattr(s, "moments"))["monthly_gross_income"] for p in (first, second, everything)
    )
    assert again == pytest.approx(scaled, rel=1e-12)
    assert wide[0] > 1e9


def test_missing_dates_and_text_dates(view):
    texts = view.withColumn(
        "application_date",
        F.when(F.col("loan_id") % 10 == 0, "unknown").otherwise(F.date_format("application_date", "yyyy-MM-dd")),
    )
    rows = training.with_parsed_date(texts)
    table = training.fit_preparation(rows).transform(rows)
    assert table.agg(F.sum("is_application_date_missing")).first()[0] == rows.where("application_date is null").count() > 0
    assert table.where("application_month is null").count() == 0


def test_random_scores_are_worth_nothing(view):
    random = view.select(F.col("is_default").alias("label"), F.abs(F.xxhash64("loan_id")).cast("double").alias("score"))
    assert abs(metrics.roc_auc(random).first()[0] - 0.5) < 0.06


def test_search_draws_stay_in_range_and_repeat():
    import random

    draws = [SearchSpace().draw(random.Random(i)) for i in range(200)]
    assert draws[0] == SearchSpace().draw(random.Random(0))
    for d in draws:
        assert 100 <= d["maxIter"] <= 999 and 3 <= d["maxDepth"] <= 9 and 1 <= d["minInstancesPerNode"] <= 9
        assert 0.01 <= d["stepSize"] <= 0.21 and 0.6 <= d["subsamplingRate"] <= 1 and 0 <= d["minInfoGain"] <= 0.5
        assert 0.6 <= float(d["featureSubsetStrategy"]) <= 1


def test_random_search(spark, view):
    _, train, _, _ = training.prepared_split(view)
    weighted = metrics.with_class_weight(train, "is_default", "positive_ratio")
    found = random_search(weighted, "is_default", "loan_id", SearchSpace(rounds=(2, 4), depth=(2, 3)), draws=2, folds=2)
    rows = search_result(spark, found).collect()
    assert [r.draw for r in rows] in ([0, 1], [1, 0])
    assert rows[0].mean_roc_auc == max(found.avgMetrics) > 0.5


def test_lost_search_goes_on_where_it_stopped(spark, view, tmp_path, monkeypatch):
    """Lost between two fits and started again: no fit is repeated, and the outcome is that of a search in one go."""
    from creditloom.modelling import search

    _, train, _, _ = training.prepared_split(view)
    weighted = metrics.with_class_weight(train, "is_default", "positive_ratio")
    settings = {"space": SearchSpace(rounds=(2, 4), depth=(2, 3)), "draws": 2, "folds": 2, "parallelism": 1}
    made, real = [], search.boosted

    def counting(*args, **params):
        if len(made) == 3 and lost:
            raise RuntimeError("lost")
        made.append(params["stepSize"])
        return real(*args, **params)

    monkeypatch.setattr(search, "boosted", counting)
    ledger, lost = str(tmp_path / "ledger"), True
    assert search.fits(spark, ledger).isEmpty()
    with pytest.raises(RuntimeError, match="lost"):
        search.random_search(weighted, "is_default", "loan_id", ledger=ledger, **settings)
    assert search.fits(spark, ledger).count() == 3
    (tmp_path / "ledger" / "search=half" / "_temporary").mkdir(parents=True)  # a write that did not end
    lost = False
    again = search.random_search(weighted, "is_default", "loan_id", ledger=ledger, **settings)
    assert len(made) == 3 + 1 + 1  # the fourth fit and the best draw on all rows
    assert search.fits(spark, ledger).count() == 4
    whole = search.random_search(weighted, "is_default", "loan_id", **settings)
    assert again.avgMetrics == pytest.approx(whole.avgMetrics) and len(made) == 10
    other = search.random_search(weighted, "is_default", "loan_id", ledger=ledger, **settings | {"seed": 7})
    assert len(made) == 15 and search.fits(spark, ledger).count() == 8 and other.ledger == ledger


def test_tuned_pipeline_scores_raw_rows_alike(view, tmp_path):
    path = str(tmp_path / "tuned")
    space = SearchSpace(rounds=(2, 4), depth=(2, 3))
    run, found = training.tune_evaluate_save(view, path, space, draws=2, folds=2)
    assert len(found.avgMetrics) == 2 and run.auc("tuned") > 0.5
    cells = run.confusion("tuned").collect()
    assert sum(r.n for r in cells) == run.scored["tuned"].count() and run.curve("tuned").count() > 2
    expected = {r.loan_id: r.score for r in run.scored["tuned"].collect()}
    again = {r.loan_id: r.score for r in training.score_batch(path, view.drop("is_default")).collect()}
    assert all(again[k] == pytest.approx(s, rel=1e-12) for k, s in expected.items())


def test_rows_with_missing_numbers_are_scored(trained, view):
    _, path = trained
    holes = view.withColumn("rla_other_emi_declared", F.lit(None).cast("double")).withColumn("age", F.lit(None).cast("int"))
    found = training.score_batch(path, holes).where("score between 0 and 1").count()
    assert found == view.count()


def test_importances_cover_all_inputs(spark, trained):
    run, _ = trained
    model = run.pipelines["forest"].stages[-1]
    rows = models.importances(spark, model, run.preparation.inputs).collect()
    assert len(rows) == len(run.preparation.inputs)
    assert sum(r.importance for r in rows) == pytest.approx(1)


def test_forest_keeps_places_and_grows_the_same_trees(spark, view):
    """Rows do not go down every tree again in every pass; the trees are those of the plain way."""
    _, train, _, _ = training.prepared_split(view)
    weighted = metrics.with_class_weight(train, "is_default", "balanced")
    forest = models.fit_forest(weighted, "is_default", numTrees=4)
    assert forest.getCacheNodeIds() and spark.sparkContext.getCheckpointDir()
    plain = models.fit_forest(weighted, "is_default", numTrees=4, cacheNodeIds=False)
    assert forest.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]


def test_large_forest_is_saved_tree_by_tree(trained, view, tmp_path, monkeypatch):
    """No stage holds more than one tree's nodes, and scores and classes are the forest's."""
    run, _ = trained
    monkeypatch.setattr(models, "NODES_TOGETHER", 0)
    path = str(tmp_path / "apart")
    models.save_model(run.pipelines["forest"], path)
    loaded = models.load_model(path)
    assert all(getattr(s, "getNumTrees", 1) == 1 for s in loaded.stages)
    expected = {r.loan_id: r for r in models.score(run.pipelines["forest"], view, "loan_id", "is_default").collect()}
    found = models.score(loaded, view, "loan_id", "is_default").collect()
    assert len(found) == len(expected) == view.count()
    assert {r.prediction for r in found} == {0, 1}
    for r in found:
        assert (r.prediction, r.is_default) == (expected[r.loan_id].prediction, expected[r.loan_id].is_default)
        assert r.score == pytest.approx(expected[r.loan_id].score, rel=1e-12)


def test_forest_is_fitted_last(view, monkeypatch):
    """The largest model is not held while others are fitted; the order of results stays as asked for."""
    order = []
    for kind in ("logistic", "forest", "boosted"):
        real = getattr(models, f"fit_{kind}")
        monkeypatch.setattr(models, f"fit_{kind}", lambda *a, k=kind, f=real, **p: order.append(k) or f(*a, **p))
    run = training.train_evaluate(view, params=SMALL)
    assert order == ["logistic", "boosted", "forest"] and list(run.pipelines) == list(run.scored) == ["logistic", "forest", "boosted"]


def test_forest_that_the_driver_cannot_hold_grows_in_groups(spark, view, tmp_path, monkeypatch):
    """All trees are grown on all rows, a few at a time; scores, classes and importances are those of Spark's forest of
    these trees, before saving and after loading."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassifier

    from creditloom.modelling import forests

    preparation, train, _, test = training.prepared_split(view)
    weighted = metrics.with_class_weight(train, "is_default", "balanced")
    monkeypatch.setattr(models, "GROWN_TOGETHER", 0)
    monkeypatch.setattr(forests, "NODES_AT_ONCE", 120)
    sizes, real = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: sizes.append(self.getNumTrees()) or real(self, rows))
    forest = models.fit_forest(weighted, "is_default", numTrees=8, maxDepth=5)
    assert isinstance(forest, forests.StoredForest) and sum(sizes) == forest.getNumTrees == 8
    assert len(sizes) > 2 and min(sizes) > 1 and len(forest.groups()) > 1
    pipeline = PipelineModel([*preparation.stages(), forest])
    path = str(tmp_path / "stored")
    models.save_model(pipeline, path)
    models.save_model(pipeline, path)  # over the first
    loaded = models.load_model(path)
    assert loaded.stages[-1].place.startswith(path)

    trees = [DecisionTreeClassificationModel.load(f"{forest.place}/tree-{i}") for i in range(8)]
    assert [t.numNodes for t in trees] == forest.nodes and len({t.toDebugString.split("\n", 1)[1] for t in trees}) == 8
    gains = sum(t.featureImportances.toArray() for t in trees)
    assert forest.featureImportances.toArray() == pytest.approx(gains / gains.sum())
    assert loaded.stages[-1].featureImportances == forest.featureImportances
    rows = models.importances(spark, forest, preparation.inputs).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1)

    given = models.PipelineModel([*preparation.stages(), *trees]).transform(test)
    mean = {
        r.loan_id: sum(r[f"{models.TREE}{i}"][1] for i in range(8)) / 8
        for r in given.select("loan_id", *[f"{models.TREE}{i}" for i in range(8)]).collect()
    }
    for model in (pipeline, loaded):
        found = models.score(model, test, "loan_id", "is_default").collect()
        assert found[0].asDict().keys() == {"loan_id", "is_default", "score", "prediction"}
        assert len(found) == len(mean) == test.count() and {r.prediction for r in found} == {0, 1}
        for r in found:
            assert r.score == pytest.approx(mean[r.loan_id], rel=1e-12)
            assert r.prediction == (r.score > 0.5) or r.score == pytest.approx(0.5)
    batch = training.score_batch(path, view.drop("is_default"), threshold=0.3)
    assert batch.count() == view.count() and batch.where("prediction = cast(score >= 0.3 as int)").count() == view.count()


def test_forest_in_groups_grows_on_no_more_parts_than_cores(spark, view, monkeypatch):
    """Each part of the rows sends the counts of every open node: parts by the size of files would multiply with nodes."""
    from pyspark.ml.classification import RandomForestClassifier

    _, train, _, _ = training.prepared_split(view)
    weighted = metrics.with_class_weight(train, "is_default", "balanced").repartition(40)
    monkeypatch.setattr(models, "GROWN_TOGETHER", 0)
    parts, real = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: parts.append((rows.rdd.getNumPartitions(), rows.count())) or real(self, rows))
    models.fit_forest(weighted, "is_default", numTrees=3, maxDepth=2)
    assert parts == [(spark.sparkContext.defaultParallelism, train.count())] * len(parts) and parts
