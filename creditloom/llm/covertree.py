"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import prepare, ranked_blocks, stored
from creditloom.llm.graph import components

COSINE = 0.95
PIVOTS = 16  # cells at the top of the tree
SAMPLE = 2048  # distinct vectors that the pivots are chosen from, at most
ROWS = 4096  # distinct vectors in a block, about; two blocks meet in a task
FAN = 32  # children of a node, at most
DIRECT = 1 << 16  # products computed at once instead of descending
SLACK = 1e-7  # over the rounding of a distance


def farthest_first(x: np.ndarray, most: int, halved: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, each the row farthest from those before it; the nearest centre of every row, and its distance.

    With ``halved`` it ends as soon as the largest distance is half of what the first centre left.
    """
    centres, nearest = [0], np.zeros(len(x), np.int64)
    least = distances(x, x[:1])[:, 0]
    goal = least.max() / 2 if halved else 0.0
    while len(centres) < most and least.max() > max(goal, SLACK):
        centres.append(int(least.argmax()))
        d = distances(x, x[centres[-1] :][:1])[:, 0]
        closer = d < least
        nearest[closer], least = len(centres) - 1, np.where(closer, d, least)
    return np.array(centres), nearest, least


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


@dataclass
class Node:
    """Members within ``radius`` of the centre; children split them, with half the radius where the fan-out allows."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node]
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def cover_tree(x: np.ndarray, rows: np.ndarray, centre: np.ndarray, radius: float, small: int = 64) -> Node:
    """Nested levels: the centre of a node is one of its members and stays a centre below."""
    node = Node(rows, centre, radius, [])
    if len(rows) > small and radius > SLACK:
        chosen, nearest, least = farthest_first(x[rows], FAN, halved=True)
        for k in range(len(chosen)):
            own = nearest == k
            node.children.append(cover_tree(x, rows[own], x[rows[chosen[k]]], float(least[own].max()), small))
        node.centres = np.array([c.centre for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
    return node


class Links:
    """Numbers of linked vectors, and a forest that connects what is linked, for the rows of one or two blocks."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count = weights, np.zeros(len(weights), np.int64)
        self.up = list(range(len(weights)))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, rows: np.ndarray) -> None:
        first = self.find(int(rows[0]))
        for i in rows[1:].tolist():
            self.up[self.find(i)] = first

    def all_of(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every row of ``a`` is linked to every other row of ``b``."""
        self.count[a] += self.weights[b].sum() - (self.weights[a] if same else 0)
        if not same:
            self.count[b] += self.weights[a].sum()
            self.join(np.concatenate([a, b]))
        else:
            self.join(a)

    def some_of(self, a: np.ndarray, b: np.ndarray, met: np.ndarray, same: bool) -> None:
        """Links where ``met`` says so; with ``same`` both sides are the same rows."""
        if same:
            np.fill_diagonal(met, False)
        if not met.any():
            return
        self.count[a] += met @ self.weights[b]
        if not same:
            self.count[b] += self.weights[a] @ met
        # smallest place that links reach, on both sides, until nothing changes
        top, many = np.iinfo(np.int64).max, len(a)
        left = np.arange(many)
        while True:
            right = np.where(met, left[:, None], top).min(axis=0)
            new = np.minimum(left, np.where(met, right[None, :], top).min(axis=1))
            if np.array_equal(new, left):
                break
            left = new
        for i in np.flatnonzero(met.any(axis=1)).tolist():
            self.up[self.find(int(a[i]))] = self.find(int(a[left[i]]))
        for j in np.flatnonzero(right < top).tolist():
            self.up[self.find(int(b[j]))] = self.find(int(a[right[j]]))


def traverse(x: np.ndarray, one: Node, two: Node, links: Links, cosine: float) -> None:
    """All pairs of the two nodes' members whose cosine reaches the threshold.

    A pair of nodes is left out if even the nearest members would be too far apart, taken whole if even the farthest are
    near enough, compared directly if it is small, and else replaced by the pairs of the larger node's children.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    todo = [(one, two)]
    while todo:
        a, b = todo.pop()
        same = a is b
        apart = 0.0 if same else float(distances(a.centre[None], b.centre[None])[0, 0])
        if not same and apart > a.radius + b.radius + reach + SLACK:
            continue
        if apart + a.radius + b.radius <= reach - SLACK:
            links.all_of(a.rows, b.rows, same)
        elif len(a.rows) * len(b.rows) <= DIRECT or not (a.children or b.children):
            step = max(1, DIRECT // len(b.rows)) if not same else len(a.rows)
            for at in range(0, len(a.rows), step):
                part = a.rows[at : at + step]
                links.some_of(part, b.rows, x[part] @ x[b.rows].T >= cosine, same)
        elif same:
            for i, c in enumerate(a.children):
                near = np.flatnonzero(distances(a.centres[i][None], a.centres)[0] <= a.radii[i] + a.radii + reach + SLACK)
                todo += [(c, a.children[j]) for j in near.tolist() if j >= i]
        else:
            if not a.children or (b.children and len(b.rows) > len(a.rows)):
                a, b = b, a
            near = np.flatnonzero(distances(b.centre[None], a.centres)[0] <= b.radius + a.radii + reach + SLACK)
            todo += [(a.children[j], b) for j in near.tolist()]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of the same length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _placed(batches, pivots: dict[int, np.ndarray]):
    """Nearest pivot and the distance to it."""
    for batch in batches:
        vectors = batch.column("v")
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        cell, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if size in pivots:
                d = distances(unit(matrix(vectors.take(pa.array(own)))), pivots[size])
                cell[own], far[own] = d.argmin(axis=1), d.min(axis=1)
            else:
                far[own] = 2.0
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"]
        )


def _compared(table: pa.Table, cosine: float) -> pa.Table:
    """The links between two blocks, or within one: for each vector with a link their number and one to be joined with."""
    side = table.column("side").to_numpy()
    x = unit(matrix(table.column("v").combine_chunks()))
    ids, links = table.column("rep").to_numpy(), Links(table.column("n").to_numpy())
    parts = [np.flatnonzero(side == s) for s in (0, 1)]
    trees = []
    for rows in parts:
        if len(rows):
            own = x[rows]
            trees.append(cover_tree(x, rows, own[0], float(distances(own, own[:1]).max())))
    if len(trees) == 2:
        traverse(x, trees[0], trees[1], links, cosine)
    elif table.column("a")[0].as_py() == table.column("b")[0].as_py():
        traverse(x, trees[0], trees[0], links, cosine)
    linked = np.flatnonzero(links.count)
    other = np.array([ids[links.find(int(i))] for i in linked], np.int64)
    return pa.table({"rep": pa.array(ids[linked], pa.int64()), "links": pa.array(links.count[linked]), "other": pa.array(other)})


def _cells(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by dimension, from the sample of smallest hash: the top of the tree, in the order of shrinking radii."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()
    found: dict[int, np.ndarray] = {}
    for size in sorted({len(r.v) for r in rows}):
        x = unit(np.array([r.v for r in rows if len(r.v) == size]))
        found[size] = x[farthest_first(x, PIVOTS)[0]]
    return found


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, purpose: str = "covertree") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row; labels and other columns are not looked at.

    Equal vectors are one class with a weight. Classes go to the nearest of a few pivots (the top of the cover tree,
    chosen from a bounded sample; all vectors are placed), which gives cells with true covering radii. Pairs of cells too
    far apart by these radii are dropped. The others are compared block by block, a block holding about ``ROWS`` classes
    of one cell, so that no task depends on the size of a cell; within a task cover trees of both blocks are traversed
    together. Dense groups are taken as whole nodes, and a task gives back counts and a forest, never all pairs.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    dimension do not link. Rows without vec_id link with nothing, have no component and are not kept. Repeated rows are
    vectors of their own that share an id.
    """
    prepare(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sound = F.expr(
        "vec_id is not null and v is not null and size(v) > 0 and exists(v, x -> x <> 0D) "
        "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    )
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).select(
        "vec_id", "v", "sound", F.when(F.col("sound"), F.xxhash64("v")).alias("k1"), F.when(F.col("sound"), F.xxhash64(F.lit(1), "v")).alias("k2")
    )
    classes = stored(
        keyed.where("sound").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), purpose
    )
    kind = "k1 long, k2 long, rep long, n long, v array<double>, cell int, far double"
    placed = stored(classes.mapInArrow(partial(_placed, pivots=(pivots := _cells(classes))), kind), purpose)
    held = placed.groupBy(F.size("v").alias("dim"), "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()

    reach = float(np.sqrt(2 - 2 * cosine))
    # a row for each pair of near cells, at most PIVOTS^2 / 2 per dimension
    near = []
    for a in held:
        for b in held:
            if a.dim == b.dim and a.cell <= b.cell:
                p = pivots.get(a.dim)
                apart = 0.0 if p is None or a.cell == b.cell else float(distances(p[a.cell][None], p[b.cell][None])[0, 0])
                if apart <= a.radius + b.radius + reach + SLACK:
                    near.append((a.dim, a.cell, b.cell))
    spark = vectors.sparkSession
    sizes = spark.createDataFrame([(h.dim, h.cell, ranked_blocks(h.n, ROWS)) for h in held], "dim int, cell int, many int")
    blocks = sizes.select("dim", "cell", F.explode(F.expr("sequence(0, many - 1)")).alias("block"))
    name = F.concat_ws("-", "dim", "cell", "block")
    pairs = (
        spark.createDataFrame(near, "dim int, one int, two int")
        .join(blocks.select("dim", F.col("cell").alias("one"), name.alias("a"), F.col("block").alias("i")), ["dim", "one"])
        .join(blocks.select("dim", F.col("cell").alias("two"), name.alias("b"), F.col("block").alias("j")), ["dim", "two"])
        .where("one <> two or i <= j")
    )
    sides = pairs.select(F.col("a").alias("name"), "a", "b", F.lit(0).alias("side")).union(
        pairs.where("a <> b").select(F.col("b").alias("name"), "a", "b", F.lit(1).alias("side"))
    )
    own = placed.withColumn("dim", F.size("v")).join(F.broadcast(sizes), ["dim", "cell"]).select(
        F.concat_ws("-", "dim", "cell", F.pmod(F.xxhash64("rep"), F.col("many"))).alias("name"), "rep", "n", "v"
    )
    met = own.join(sides, "name").select("a", "b", "side", "rep", "n", "v")
    found = met.groupBy("a", "b").applyInArrow(lambda t: _compared(t, cosine), "rep long, links long, other long")
    links = stored(found, purpose)
    reached = components(links.select(F.col("rep").alias("u"), F.col("other").alias("v")), purpose)
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (
        classes.select("k1", "k2", F.col("rep").alias("r"), "n")
        .join(counted, F.col("r") == counted.rep, "left")
        .join(reached, F.col("r") == reached.node, "left")
        .select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "r").alias("c"))
    )
    out = keyed.drop("v").join(known, ["k1", "k2"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
