"""Properties that hold for any input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.functions.dates import in_window, months_back
from creditloom.modelling import metrics, split
from creditloom.operators import encoding, quantiles, running, selection, skew
from creditloom.operators import timegrid as tg


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double").repartition(4)


@pytest.fixture(scope="module")
def skewed_scores():
    """A third of all rows shares one score."""
    rng = random.Random(3)
    rows = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(400)]
    return rows + [(int(i % 5 == 0), 0.5) for i in range(200)]


def test_auc_equals_all_pairs(spark, skewed_scores):
    positives = [s for l, s in skewed_scores if l == 1]
    negatives = [s for l, s in skewed_scores if l == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    found = metrics.roc_auc(scored(spark, skewed_scores)).first().roc_auc
    assert found == pytest.approx(wins / (len(positives) * len(negatives)), rel=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(scored(spark, [])).first().roc_auc is None
    assert metrics.roc_auc(scored(spark, [(1, 0.1), (1, 0.2)])).first().roc_auc is None


def test_curve_points(spark, skewed_scores):
    points = {r.threshold: (r.precision, r.recall) for r in metrics.pr_curve(scored(spark, skewed_scores)).collect()}
    assert points.pop(None) == (1, 0)
    assert set(points) == {s for _, s in skewed_scores}
    total = sum(l for l, _ in skewed_scores)
    for threshold, (precision, recall) in points.items():
        over = [l for l, s in skewed_scores if s >= threshold]
        assert precision == pytest.approx(sum(over) / len(over))
        assert recall == pytest.approx(sum(over) / total)


@pytest.mark.parametrize("rows_per_range", [1000, 150, 43, 5])
def test_running_total(spark, rows_per_range):
    values = [(float(v), v % 3) for v in random.Random(1).sample(range(-500, 500), 300)]
    df = spark.createDataFrame(values, "x double, n long")
    found = running.running_total(df, "x", ["n"], rows_per_range=rows_per_range).collect()
    assert len(found) == 300
    for r in found:
        assert r.n_below == sum(n for x, n in values if x < r.x)


def test_plan_does_not_grow_with_the_ranges(spark):
    df = spark.range(4000).selectExpr("cast(id as double) as x", "id % 7 as n")
    found = [running.running_total(df, "x", ["n"], rows_per_range=size) for size in (2000, 10)]
    ranges = [running._ranged(df, ["x"], None, size).select(running.RANGE).distinct().count() for size in (2000, 10)]
    assert ranges[0] == 2 and ranges[1] > 300
    plans = [f._jdf.queryExecution().optimizedPlan().toString() for f in found]
    assert len(plans[1]) == pytest.approx(len(plans[0]), abs=40)


def test_places_do_not_depend_on_the_partitioning(spark):
    df = spark.range(900).selectExpr("id as key", "pmod(xxhash64(id), 50) as x")
    want = {r.key: i for i, r in enumerate(df.orderBy("x", "key").collect())}
    for parts, size in ((1, 1000), (7, 100), (3, 9)):
        found = running.placed(df.repartition(parts), ["x", "key"], rows_per_range=size).collect()
        assert {r.key: r.place for r in found} == want


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1001])
def test_quantiles_equal_linear_interpolation(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([None, 7, rng.randrange(50)]), rng.gauss(0, 1e6)) for _ in range(size)]
    df = spark.createDataFrame(rows, "a int, b double").repartition(3)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = {(r.column_name, r.probability): r.value for r in quantiles.exact_quantiles(df, ["a", "b"], wanted).collect()}
    for i, name in enumerate(["a", "b"]):
        known = [r[i] for r in rows if r[i] is not None]
        for p in wanted:
            if known:
                assert found[name, p] == pytest.approx(np.quantile(known, p), rel=1e-12)
            else:
                assert (name, p) not in found


@pytest.mark.parametrize("accuracy, few", [(3, 1), (3, 500), (50, 20), (1000, 10)])
def test_quantiles_by_narrowing(spark, monkeypatch, accuracy, few):
    """Rough sketches and many rounds still give exact values, also where a third of the rows is one value."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "FEW_VALUES", few)
    values = [float(v) for v in np.random.default_rng(5).lognormal(size=2000)] + [1.0] * 1000
    df = spark.createDataFrame([(v, int(v * 3)) for v in values], "v double, w int").repartition(8)
    wanted = [0.0, 0.01, 0.5, 0.99, 1.0]
    found = {(r.column_name, r.probability): r.value for r in quantiles.exact_quantiles(df, ["v", "w"], wanted).collect()}
    for p in wanted:
        assert found["v", p] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert found["w", p] == pytest.approx(np.quantile([int(v * 3) for v in values], p), rel=1e-12)


def test_no_task_orders_more_values_than_the_limit(spark, monkeypatch):
    """Half of the rows are one value and the median lies just past it."""
    monkeypatch.setattr(quantiles, "FEW_VALUES", 40)
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    ordered, seen = quantiles._order, []

    def watched(counts, ranks):
        for column, low, high in quantiles._open(ranks):
            inside = counts.where((F.col("c") == column) & quantiles._between(F.col("value"), low, high))
            seen.append((inside.count(), inside.select("value").distinct().count()))
        ordered(counts, ranks)

    monkeypatch.setattr(quantiles, "_order", watched)
    values = [0.0] * 3000 + [1 + i / 7 for i in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    assert quantiles.medians(df, ["v"])["v"] == np.quantile(values, 0.5)
    assert quantiles.exact_quantiles(df, ["v"], [0.9]).first().value == pytest.approx(np.quantile(values, 0.9), rel=1e-12)
    assert all(rows == distinct <= 40 for rows, distinct in seen)


def test_medians_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.medians(df, ["v"]) == {"v": None}


@pytest.mark.parametrize("classes", [(7, 3), (100, 1), (1234, 567)])
def test_split_is_exact_disjoint_and_stable(spark, classes):
    rows = [(f"{label}-{i}", label) for label, n in enumerate(classes) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, label int")
    train, test = split.stratified_split(df.repartition(5), "label", "k")
    tested = {r.k for r in test.collect()}
    trained = {r.k for r in train.collect()}
    assert tested | trained == {k for k, _ in rows} and not tested & trained
    for label, n in enumerate(classes):
        assert sum(k.startswith(f"{label}-") for k in tested) == round(n * 0.2)
    assert tested == {r.k for r in split.stratified_split(df.repartition(2), "label", "k")[1].collect()}
    assert tested != {r.k for r in split.stratified_split(df, "label", "k", seed=1)[1].collect()} or sum(classes) < 200


def test_folds_differ_by_one_row_at_most(spark):
    df = spark.createDataFrame([(i, int(i < 23)) for i in range(200)], "k long, label int")
    counts = {
        (r.label, r.fold): r["count"]
        for r in split.stratified_folds(df, "label", "k", 5).groupBy("label", "fold").count().collect()
    }
    for label in (0, 1):
        sizes = [counts[label, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_scaled_columns_have_mean_zero_and_deviation_one(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") * 3 + 7).cast("double").alias("x"), F.lit(4.0).alias("same"))
    table = encoding.fit_standardize(df, ["x", "same"]).transform(df)
    row = table.agg(F.avg("x"), F.stddev_pop("x"), F.max("same"), F.min("same")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1, rel=1e-12)
    assert (row[2], row[3]) == (0, 0)


def test_dummies_sum_to_one_at_most(spark):
    df = spark.createDataFrame([(c,) for c in ("a", "b", "c", "b", None)], "c string")
    table = encoding.fit_one_hot(df, ["c"], null_category=False).transform(df)
    assert sorted(sum(r) for r in table.collect()) == [0, 1, 1, 1, 1]


def test_scalable_columns(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 5, "x", None), (1, 2.0, 5, "y", None), (0, 3.0, 5, "z", None), (1, 2.5, 5, "z", None)],
        "flag int, x double, same int, s string, none double",
    )
    assert selection.scalable_columns(df) == ["x"]
    assert selection.scalable_columns(df, exclude=("x",)) == []


def test_confusion_cells_sum_to_n(spark, skewed_scores):
    df = metrics.classify_at(scored(spark, skewed_scores), 0.4)
    assert sum(r.n for r in metrics.confusion(df).collect()) == len(skewed_scores)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    sums = metrics.with_class_weight(df, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in sums] == pytest.approx([4, 4])
    ratio = metrics.with_class_weight(df, "label", "positive_ratio").where("label = 1").first().weight
    assert ratio == 3
    with pytest.raises(ValueError):
        metrics.with_class_weight(df.where("label = 0"), "label")


def test_grid_sums_stay_within_the_window(spark):
    days = spark.sql("select 'c' as customer_id, explode(sequence(date'2023-01-01', date'2024-12-31')) as day, 1D as v")
    anchors = spark.sql("select 'c' as customer_id, date'2024-08-31' as anchor_date")
    day, anchor = F.col("day"), F.col("anchor_date")
    grid = tg.month_grid(F.col("v"), in_window(day, anchor, 6), months_back(day, anchor))
    row = tg.point_in_time(anchors, days).groupBy("customer_id").agg(*[c.alias(f"m{i}") for i, c in enumerate(grid)])
    assert list(row.first())[1:] == [31, 31, 30, 31, 30, 31]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1, 3, 1000])
def test_spread_join_equals_plain_join(spark, how, share):
    """One key holds a third of the rows; some keys have no partner, and one is null."""
    rows = [("hot", i) for i in range(200)] + [(f"k{i % 50}", i) for i in range(390)] + [(None, i) for i in range(10)]
    many = spark.createDataFrame(rows, "k string, i long")
    partners = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 80, 2)]], "k string, v long")
    spread = skew.spread_join(many, partners, "k", "i", how, share)
    assert spread.columns == ["k", "i", "v"]
    plain = many.join(partners, "k", how)
    assert sorted(spread.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_heavy_keys_are_few_and_found(spark):
    rows = [("hot",)] * 500 + [(f"k{i}",) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string")
    for per_slot in (20, 40):
        heavy = skew.heavy_keys(df, "k", per_slot).collect()
        assert [tuple(r) for r in heavy] == [("hot", -(-500 // per_slot))]


def test_no_slot_exceeds_the_target_by_much(spark):
    rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id)) as k", "id as i")
    ways = skew.heavy_keys(rows, "k", 500).first()[1]
    sizes = rows.where("k = 'hot'").groupBy(F.pmod(F.xxhash64("i"), F.lit(ways))).count().collect()
    assert len(sizes) == ways == 20 and max(r["count"] for r in sizes) < 1.3 * 500
