"""Approximate nearest neighbours by cosine: a forest of random-projection trees behind one priority queue.

Each tree splits the space by hyperplanes between two sampled points; its shape comes from a bounded sample, and every
row is sent to one leaf of every tree. A query walks all trees at once: a priority queue over the open branches of the
whole forest yields the branch whose margin (the smallest on its way, negative on the far side of a plane) is best,
until the leaves it has opened hold the wanted share of all vectors. The members of these leaves are compared with
the query exactly, on the original vectors in double precision.

Equal vectors are one entry that carries its smallest ids, as many as a result can need; so a vector that very many
rows share is one entry of a leaf. Leaves are dealt out in blocks of bounded size; a query meets every block of its
leaves, each block sends its best few, and the best of these are exact.

Vectors that are null, of zero length, or hold null or non-finite components take no part. Rows without an id neither.
Equal rows (same id and vector) count once. If fewer candidates than asked for exist, all are returned. An empty table
gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Trees; expected rows of the sample that shapes them (the bound of the fit); sample points in a leaf.
TREES, SAMPLE, LEAF_POINTS = 4, 8_000, 60
# The share of all vectors that the opened leaves hold, counted over all trees. Vectors without any structure, spread
# evenly in 64 dimensions, need that much for a recall of over 0.9; clustered ones need far less.
SEARCHED = 1.4
# Entries of a leaf that are compared in one group of rows.
BLOCK = 2_000
SEED = 20


def _plane(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A plane between two of the points, moved to the median so that both sides get half of the points."""
    a, b = points[rng.choice(len(points), 2, replace=False)]
    normal = a - b
    length = np.linalg.norm(normal)
    normal = normal / length if length else rng.standard_normal(points.shape[1]) / np.sqrt(points.shape[1])
    return normal, float(np.median(points @ normal))


class Tree:
    """Inner nodes with their planes and children; children below zero are leaves (-1 - number)."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator, leaf_points: int):
        self.normals, self.offsets, self.children, self.leaves = [], [], [], 0
        self.root = self._grow(points, rng, leaf_points)

    def _grow(self, points: np.ndarray, rng: np.random.Generator, leaf_points: int) -> int:
        todo, root = [(points, None, 0)], None
        while todo:
            own, parent, side = todo.pop()
            number = None
            if len(own) > leaf_points:
                normal, offset = _plane(own, rng)
                right = own @ normal > offset
                if right.any() and not right.all():
                    number = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.children.append([0, 0])
                    todo += [(own[~right], number, 0), (own[right], number, 1)]
            if number is None:
                number = -1 - self.leaves
                self.leaves += 1
            if parent is None:
                root = number
            else:
                self.children[parent][side] = number
        return root

    def finish(self, width: int) -> Tree:
        self.normals = np.array(self.normals).reshape(-1, width)
        self.offsets = np.array(self.offsets)
        self.children = np.array(self.children, np.int64).reshape(-1, 2)
        return self

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        while (inner := np.nonzero(node >= 0)[0]).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", points[inner], self.normals[at]) > self.offsets[at]
            node[inner] = self.children[at, right.astype(int)]
        return -1 - node


def forest(points: np.ndarray, trees: int = TREES, leaf_points: int = LEAF_POINTS) -> list[Tree]:
    rng = np.random.default_rng(SEED)
    return [Tree(points, rng, leaf_points).finish(points.shape[1]) for _ in range(trees)]


def opened_leaves(trees: list[Tree], sizes: dict[tuple[int, int], int], query: np.ndarray, wanted: float) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the shared priority queue until the leaves hold ``wanted`` vectors."""
    margins = [tree.normals @ query - tree.offsets for tree in trees]
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    held = 0
    while queue and held < wanted:
        bound, t, node = heapq.heappop(queue)
        if node < 0:
            held += sizes.get((t, -1 - node), 0)
            yield t, -1 - node
            continue
        margin = margins[t][node]
        left, right = trees[t].children[node]
        heapq.heappush(queue, (max(bound, margin), t, left))
        heapq.heappush(queue, (max(bound, -margin), t, right))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _unit(points: np.ndarray) -> np.ndarray:
    return points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part; the components stay floats if they are."""
    kind = df.select(F.col(f"`{vector_col}`").alias("v")).schema["v"].dataType.elementType.simpleString()
    vector = F.col(f"`{vector_col}`").cast(f"array<{kind if kind == 'float' else 'double'}>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _entries(rows: DataFrame, kept: int) -> DataFrame:
    """One row per distinct vector with its ``kept`` smallest ids. Copies are first cut down in groups of rows, so that a
    vector that a third of all rows share is not collected in one place."""
    for parts in (64, 1):
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        by = Window.partitionBy("vector", part).orderBy("id")
        rows = rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= kept).drop("place")
    return rows.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _routed(trees) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _unit(_matrix(batch.column("vector")))
            for t, tree in enumerate(trees.value):
                leaf = pa.array(tree.leaf_of(points), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), t), pa.int32()), leaf, *[batch.column(c) for c in ("entry", "least", "vector")]],
                    names=["tree", "leaf", "entry", "least", "vector"],
                )

    return run


def _visits(trees, sizes, wanted: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sizes.value
        for batch in batches:
            points = _unit(_matrix(batch.column("vector")))
            for i, point in enumerate(points):
                found = list(opened_leaves(trees.value, table, point, wanted))
                rows = batch.take(pa.array([i] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), rows.column("entry"), rows.column("vector")],
                    names=["tree", "leaf", "query", "vector"],
                )

    return run


_FOUND = "query long, entry long, least long, score double"


def _cosines(asked: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``asked`` with the same row of ``points``, summed in one order for every pair, so that equal
    vectors have equal scores wherever they are compared."""
    dot, a, b = np.zeros(len(asked)), np.zeros(len(asked)), np.zeros(len(asked))
    for d in range(asked.shape[1]):
        dot += asked[:, d] * points[:, d]
        a += asked[:, d] * asked[:, d]
        b += points[:, d] * points[:, d]
    return dot / (np.sqrt(a) * np.sqrt(b))


def _compared(k: int):
    """The best ``k`` entries of one block of a leaf for each query that opened the leaf."""

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, int), "entry": np.empty(0, int), "least": np.empty(0, int), "score": np.empty(0)})]
        if len(queries) and len(members):
            points = np.stack(members["vector"].to_numpy()).astype(np.float64)
            units = _unit(points).T
            entry, least = members["entry"].to_numpy(), members["least"].to_numpy()
            for start in range(0, len(queries), 500):
                part = queries.iloc[start : start + 500]
                asked = np.stack(part["vector"].to_numpy()).astype(np.float64)
                rough = _unit(asked) @ units
                most = min(k, rough.shape[1])
                worst = -np.partition(-rough, most - 1, axis=1)[:, most - 1]
                # All that may be among the best: sums in another order differ in the last digits only.
                q, e = np.nonzero(rough >= (worst - 1e-9)[:, None])
                score = _cosines(asked[q], points[e])
                order = np.lexsort((least[e], -score, q))
                q, e, score = q[order], e[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q, "left")
                q, e, score = q[place < k], e[place < k], score[place < k]
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[q], "entry": entry[e], "least": least[e], "score": score}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest(
    df: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    searched: float = SEARCHED,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id`` and ``score`` of the ``k`` nearest other rows found for every row that
    ``queries``, a condition on ``id``, chooses. Ties go to the smaller id."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col).distinct()
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    rows = rows.filter(F.size("vector") == (widths["w"] if widths else 0))
    entries = _entries(rows, k + 1).withColumn("entry", F.monotonically_increasing_id()).withColumn("least", F.element_at("ids", 1))
    entries = stage(entries, "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")

    share = min(1.0, SAMPLE / n)
    sample = entries.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) <= share * (1 << 30)).select("vector").orderBy(F.xxhash64("vector")).collect()
    points = _unit(np.array([r["vector"] for r in sample], np.float64))
    grown = spark.sparkContext.broadcast(forest(points, trees))
    kind = entries.schema["vector"].dataType.simpleString()
    members = entries.select("entry", "least", "vector")
    leaves = stage(members.mapInArrow(_routed(grown), f"tree int, leaf int, entry long, least long, vector {kind}"), "leaves")
    # As many counts as the sample has leaves.
    counted = leaves.groupBy("tree", "leaf").count().collect()
    sizes = spark.sparkContext.broadcast({(r["tree"], r["leaf"]): r["count"] for r in counted})

    asked = rows.filter(queries).select("id", "vector").join(entries.select("entry", "vector"), "vector").select("id", "entry")
    asked = stage(asked, "queries")
    asking = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "vector")
    visits = asking.repartition(F.col("entry")).mapInArrow(_visits(grown, sizes, searched * n), f"tree int, leaf int, query long, vector {kind}")

    # A leaf with many members is cut into blocks; its queries meet each of them.
    most = {(r["tree"], r["leaf"]): -(-r["count"] // BLOCK) for r in counted}
    large = {key: b for key, b in most.items() if b > 1}
    blocks = F.lit(1)
    if large:
        table = F.create_map(*[x for (t, leaf), b in large.items() for x in (F.lit(f"{t}:{leaf}"), F.lit(b))])
        blocks = F.coalesce(F.try_element_at(table, F.concat_ws(":", "tree", "leaf")), F.lit(1))
    members = leaves.withColumn("block", F.pmod(F.xxhash64("entry"), blocks).cast("int"))
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    found = (
        visits.groupBy("tree", "leaf", "block").cogroup(members.groupBy("tree", "leaf", "block"))
        .applyInPandas(_compared(k + 1), _FOUND)
    )
    # The same entry can be found in several trees; the best k + 1 entries hold the best k rows.
    best = found.groupBy("query", "entry").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    best = best.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k + 1).select("query", "entry", "score")
    near = best.join(entries.select("entry", "ids"), "entry")
    pairs = asked.withColumnRenamed("entry", "query").join(near, "query").select("id", F.explode("ids").alias("other"), "score")
    pairs = pairs.filter("id <> other")
    ranked = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return (
        pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), "rank", F.col("other").alias("id"), "score")
    )
