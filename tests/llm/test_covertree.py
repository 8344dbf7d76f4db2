import numpy as np
import pytest

from creditloom.llm import covertree


def by_hand(rows, cosine=0.95):
    """All pairs."""
    sound = [
        i for i, (k, v) in enumerate(rows)
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    up, count = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in sound}
    units = {i: x / np.linalg.norm(x) for i, x in scaled.items()}
    for x, i in enumerate(sound):
        for j in sound[x + 1 :]:
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                count[i] += 1
                count[j] += 1
                a, b = find(i), find(j)
                up[max(a, b, key=lambda r: rows[r][0])] = min(a, b, key=lambda r: rows[r][0])
    return sorted(
        ((rows[i][0], count[i], rows[find(i)][0], rows[i][0] is not None and rows[i][0] == rows[find(i)][0]) for i in range(len(rows))),
        key=repr,
    )


def check(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as n", "3 as cell")
    got = [tuple(r) for r in covertree.near_duplicates(table).collect()]
    assert sorted(got, key=repr) == by_hand(rows)


def near(rng, centre, spread, n):
    x = centre + rng.normal(0, spread, (n, len(centre)))
    return [v.tolist() for v in x]


@pytest.mark.parametrize("seed", range(4))
def test_groups_chains_and_copies(spark, monkeypatch, seed):
    """Small blocks and nodes, so that whole nodes, descents and direct products all occur."""
    monkeypatch.setattr(covertree, "ROWS", 100)
    monkeypatch.setattr(covertree, "DIRECT", 300)
    monkeypatch.setattr(covertree, "FAN", 4)
    rng = np.random.default_rng(seed)
    vectors = near(rng, np.zeros(6), 1, 150)
    for spread in (0.01, 0.05, 0.1, 0.2):
        vectors += near(rng, rng.normal(0, 1, 6), spread, 60)
    vectors += [vectors[3]] * 40 + [(2 * np.array(vectors[3])).tolist()] * 3
    vectors += [[float(np.cos(t)), float(np.sin(t)), 0.0, 0.0, 0.0, 0.0] for t in np.arange(0, 3, 0.25)]  # a chain
    order = rng.permutation(len(vectors))
    check(spark, [(int(k), vectors[i]) for k, i in enumerate(order)])


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(np.float32(x)) for x in r.embedding]) for r in table.collect()]
    got = [tuple(r) for r in covertree.near_duplicates(table).collect()]
    assert sorted(got, key=repr) == by_hand(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [1e-300, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]),
        (9, [1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e300, 1e299]),
    ]
    check(spark, rows)
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
