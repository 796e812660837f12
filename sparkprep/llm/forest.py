"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: the distinct vectors with the smallest
hash, ``SAMPLE_VALUES`` numbers in all at most. A node's plane is the difference of
two random sample vectors, cut at the sample's median; leaves hold about
``LEAF_ROWS`` of all vectors as long as the sample can tell so many apart. Every
vector is indexed: it is put into one leaf of each tree. For the largest inner
product, vectors get one more component that gives all the same length, so the
nearest by angle are those of the largest product.

A query walks all trees through one shared priority queue: the open branch with
the smallest sum of squared distances to the planes that part it from the query
comes next, whichever tree it belongs to. It stops when the leaves reached hold
``BUDGET * N ** GROWTH`` vectors, counted once per tree; this grows more slowly than the table. The
vectors of those leaves are then ranked by their exact product in double
precision. Leaves are worked off in groups of neighbouring leaves, each group with
the queries that reached it, and every group passes on its best per query only.

Equal vectors are indexed once, with their smallest ids, as many as can matter.
The forest (bounded by the sample) is all that is broadcast.

Defined results: vectors that are null, zero or hold a null or non-finite
component take no part, nor do vectors of another length than the most frequent
one (the longer of equally frequent). A query gets all candidates if there are
fewer than asked for. Ties go to the smaller id. A repeated id counts as a row of
its own, except that a query never finds rows of its own id. Rows without an id
take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.session import materialise

TREES = 8
LEAF_ROWS = 128
SAMPLE_VALUES = 8_000_000
BUDGET, GROWTH = 4.4, 0.85
GROUP_ROWS = 8192


@dataclass
class Forest:
    """Complete binary trees as arrays: node i has children 2i + 1 and 2i + 2, leaves are numbered by their path."""

    depth: int
    planes: np.ndarray  # (trees, nodes, dimension)
    cuts: np.ndarray  # (trees, nodes)
    longest: float

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def widened(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes them all equally long."""
        rest = np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        wide = self.widened(x)
        out = np.zeros((len(x), len(self.planes)), dtype="i4")
        for t in range(len(self.planes)):
            node = np.zeros(len(x), dtype="i8")
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", wide, self.planes[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (self.leaves - 1)
        return out

    def reach(self, query: np.ndarray, held: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs by the shared queue until the leaves hold enough vectors."""
        wide = np.append(query, 0.0)
        sides = self.planes @ wide - self.cuts
        inner, found, total = self.leaves - 1, [], 0.0
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        heapq.heapify(queue)
        while queue and total < budget:
            far, t, node = heapq.heappop(queue)
            while node < inner:
                side = float(sides[t, node])
                near = 2 * node + 1 + (side >= 0)
                heapq.heappush(queue, (far + side * side, t, 4 * node + 3 - near))
                node = near
            leaf = node - inner
            found.append((t, leaf))
            total += held[t, leaf]
        return found


def grow(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> Forest:
    """A forest for ``rows`` vectors, from a sample of them."""
    depth = max(0, min(int(math.log2(max(1, rows / leaf_rows))), int(math.log2(max(1, len(sample) / 8)))))
    nodes = (1 << depth) - 1
    forest = Forest(depth, np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), longest)
    wide = forest.widened(sample)
    rng = np.random.default_rng(seed)
    for t in range(trees):
        own = [np.arange(len(wide))]
        for node in range(nodes):
            rows_here = own[node]
            pick = wide[rng.choice(rows_here, 2)] if len(rows_here) else rng.normal(size=(2, wide.shape[1]))
            plane = pick[0] - pick[1]
            if not plane.any():
                plane = rng.normal(size=len(plane))
            plane = plane / np.linalg.norm(plane)
            side = wide[rows_here] @ plane
            cut = float(np.median(side)) if len(side) else 0.0
            forest.planes[t, node], forest.cuts[t, node] = plane, cut
            own += [rows_here[side < cut], rows_here[side >= cut]]
    return forest


def _usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``id, v`` (doubles) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding", seed: int = 1) -> DataFrame:
    """The ``k`` nearest found of each query row: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on the column ``id``, the rows' key.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, key, column)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    width = sizes.n if sizes else 0
    rows = rows.where(F.size("v") == width).withColumn("h", F.xxhash64(F.lit(seed), "v"))
    # of equal vectors the smallest ids are enough: a query drops its own and needs k others
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    distinct = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = materialise(distinct.withColumn("d", F.monotonically_increasing_id()), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    total, longest = distinct.agg(F.count("*"), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    most = max(64, SAMPLE_VALUES // width)
    sample = np.array([r.v for r in distinct.select("h", "v").orderBy("h", "v").limit(most).collect()])
    forest = grow(sample, total, longest, seed=seed)
    counts = np.stack([np.bincount(leaf, minlength=forest.leaves) for leaf in forest.place(sample).T]) * (total / len(sample))
    shared = spark.sparkContext.broadcast((forest, counts))
    budget = BUDGET * total**GROWTH
    # neighbouring leaves that together hold about GROUP_ROWS vectors are one group
    per_group = max(1, int(GROUP_ROWS * forest.leaves / total))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = shared.value[0]
        for frame in frames:
            leaves = forest.place(np.stack(frame["v"].to_numpy()))
            for t in range(leaves.shape[1]):
                leaf = leaves[:, t]
                yield pd.DataFrame({"tree": t, "part": leaf // per_group, "leaf": leaf, "d": frame["d"], "v": frame["v"]})

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = shared.value
        for frame in frames:
            out = []
            for h, v in zip(frame["q"], frame["v"]):
                by_part: dict[tuple[int, int], list[int]] = {}
                for t, leaf in forest.reach(np.asarray(v), held, budget):
                    by_part.setdefault((t, leaf // per_group), []).append(leaf)
                out += [(t, part, leaves, h, v) for (t, part), leaves in by_part.items()]
            yield pd.DataFrame(out, columns=["tree", "part", "leaves", "q", "v"])

    # floats travel as floats; products are taken in double precision
    sent = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    index = distinct.select("d", "v").mapInPandas(put, f"tree int, part int, leaf int, d long, v {sent}")
    asking = rows.where(is_query)
    queries = asking.select("h", "v").distinct().join(distinct, ["h", "v"]).select(F.col("d").alias("q"), "v")
    routed = queries.mapInPandas(route, f"tree int, part int, leaves array<int>, q long, v {sent}")

    def rank(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(asked):
            x = np.stack(points["v"].to_numpy()).astype(float)
            leaf, d = points["leaf"].to_numpy(), points["d"].to_numpy()
            here = np.zeros(forest_leaves, dtype=bool)
            for q, leaves, v in zip(asked["q"], asked["leaves"], asked["v"]):
                here[leaves] = True
                rows_here = np.flatnonzero(here[leaf])
                here[leaves] = False
                v = np.asarray(v, dtype=float)
                close = x[rows_here] @ v
                # the best and all that tie with the last of them
                if len(close) > k + 1:
                    last = np.partition(close, len(close) - k - 1)[len(close) - k - 1]
                    rows_here = rows_here[close >= last - 1e-9 * (1 + abs(last))]
                exact = (x[rows_here] * v).sum(axis=1)
                out.append((q, d[rows_here], exact))
        return pd.DataFrame(out, columns=["q", "d", "s"])

    forest_leaves = forest.leaves
    best = index.groupBy("tree", "part").cogroup(routed.groupBy("tree", "part")).applyInPandas(rank, "q long, d array<long>, s array<double>")
    pairs = F.transform(F.arrays_zip("d", "s"), lambda p: F.struct((-p["s"]).alias("far"), p["d"].alias("d")))
    # sorted once per query; a vector that several trees met stands beside itself
    merged = best.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list(pairs))).alias("met"))
    merged = merged.select("q", F.filter("met", lambda p, i: ~p.eqNullSafe(F.get("met", i - 1))).alias("found"))
    # k + 1 distinct vectors, ties with the last kept, hold the k nearest rows
    last = F.element_at("found", F.least(F.size("found"), F.lit(k + 1)))["far"]
    near = merged.select("q", F.explode(F.filter("found", lambda p: p["far"] <= last)).alias("p"))
    near = near.select("q", F.col("p.d").alias("d"), (-F.col("p.far")).alias("score"))
    named = near.join(distinct.select("d", "ids"), "d").groupBy("q").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id"))))).alias("found"))
    named = materialise(named, "nearest")
    asked = asking.select("id", "h", "v").join(distinct.select("h", "v", F.col("d").alias("q")), ["h", "v"]).select("id", "q")
    own = F.filter("found", lambda p: p["id"] != F.col("id"))
    out = asked.join(named, "q").select("id", F.posexplode(F.slice(F.sort_array(own), 1, k)).alias("i", "p"))
    return out.select(F.col("id").alias("query_id"), (F.col("i") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.far")).alias("score"))
