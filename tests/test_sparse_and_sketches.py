"""Categories as sparse vectors, and stored sketches."""

import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators import encoding, sketches
from creditloom.operators.selection import n_unique
from creditloom.session import stored


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c c", "=", None]), rng.choice([1, 2, 10, None]), None) for i in range(300)]
    return spark.createDataFrame(rows, "id long, x string, y int, z string").repartition(4)


@pytest.mark.parametrize("drop_first", [False, True])
@pytest.mark.parametrize("null_category", [False, True])
def test_sparse_equals_columns(spark, table, drop_first, null_category):
    options = {"drop_first": drop_first, "null_category": null_category}
    names = ["x", "y", "z"]
    columns = encoding.fit_one_hot(table, names, **options)
    wide = columns.transform(table)
    made = [c for c in wide.columns if c != "id"]
    sparse = encoding.fit_sparse_one_hot(table, names, **options)
    assert [r.name for r in sparse.names().orderBy("slot").collect()] == made
    want = {r.id: [float(r[c]) for c in made] for r in wide.collect()}
    found = sparse.transform(table, "id")
    assert found.columns == [*table.columns, "categories"]
    assert {r.id: r.categories.toArray().tolist() for r in found.collect()} == want
    unseen = spark.createDataFrame([(1, "new", 99, "q")], table.schema)
    assert sparse.transform(unseen, "id").first().categories.numNonzeros() == 0


def test_a_hundred_thousand_categories(spark, monkeypatch):
    monkeypatch.setattr(encoding.spread_join, "__defaults__", ("inner", 20_000))  # the shared value is spread over tasks
    rows = spark.range(150_000).selectExpr("id", "if(id < 100000, concat('v', id), 'v7') as v")
    sparse = encoding.fit_sparse_one_hot(rows, ["v"])
    assert sparse.sizes == [100_000]
    found = sparse.transform(rows, "id")
    places = {r.name: r.slot for r in sparse.names().where("name in ('v_v7', 'v_v99999')").collect()}
    for key, name in ((7, "v_v7"), (149_999, "v_v7"), (99_999, "v_v99999")):
        vector = found.where(F.col("id") == key).first().categories
        assert vector.size == 100_000 and vector.indices.tolist() == [places[name]]
    assert found.count() == 150_000


def test_merged_daily_sketches_answer_like_one_over_all(spark):
    rng = random.Random(4)
    rows = [(d, None if rng.random() < 0.1 else rng.gauss(d, 30), rng.randrange(3000), f"t{rng.randrange(50)}") for d in range(40) for _ in range(500)]
    df = spark.createDataFrame(rows, "day int, x double, y int, t string").repartition(6)
    daily = stored(sketches.sketch_table(df, ["x", "y", "t"], by=["day"]), "daily")
    assert daily.count() == 120
    got = {r.column_name: r for r in sketches.estimates(sketches.merged(daily), (0.1, 0.5, 0.9)).collect()}
    one = {r.column_name: r for r in sketches.estimates(sketches.sketch_table(df, ["x", "y", "t"])).collect()}
    for i, name in ((1, "x"), (2, "y")):
        known = sorted(r[i] for r in rows if r[i] is not None)
        assert got[name].n == one[name].n == len(known)
        for p in (0.1, 0.5, 0.9):
            value = got[name][f"p{p * 100:g}"]
            below, upto = sum(v < value for v in known), sum(v <= value for v in known)
            assert below / len(known) <= p + sketches.RANK_ERROR and upto / len(known) >= p - sketches.RANK_ERROR
        assert got[name].distinct == pytest.approx(len(set(known)), rel=3 * sketches.DISTINCT_ERROR)
    assert got["t"].distinct == 50 and got["t"].p50 is None
    week = sketches.merged(daily.where("day < 7").withColumn("half", F.expr("day < 3")), by=["half"])
    assert {(r.half, r.column_name) for r in week.collect()} == {(h, c) for h in (True, False) for c in ("x", "y", "t")}
    empty = {r.column_name: r for r in sketches.estimates(sketches.sketch_table(df.limit(0), ["x", "t"])).collect()}
    assert empty["x"].distinct == 0 and empty["x"].p50 is None


def test_distinct_counts_of_odd_columns(spark):
    rows = [(0.0, None, "a"), (-0.0, None, "a "), (float("nan"), None, None), (float("nan"), None, "a")]
    df = spark.createDataFrame(rows, "x double, y string, z string")
    assert {r.column_name: r.n_unique for r in n_unique(df).collect()} == {"x": 2, "y": 0, "z": 2}
    assert {r.column_name: r.n_unique for r in n_unique(df.limit(0)).collect()} == {"x": 0, "y": 0, "z": 0}
