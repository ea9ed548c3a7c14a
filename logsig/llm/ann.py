"""Nearest neighbours by vantage-point trees, one tree per shard.

Vectors are dealt to shards by the nearest of some vantage points, drawn by a hash of the id;
a shard's vectors lie between a least and a greatest distance from its point. A large shard
is cut into parts of bounded size by a hash, and each part has its tree. A query first goes
to its own shard; the ``k``-th distance there bounds the answer, and by the triangle inequality
only shards that reach into this distance are visited after that. A part's candidates are
sent to its task once a round; they become one tree, and the part's queries stream by in
tiles. Only where very many queries meet is a part sent again, once per ``slice_queries``
of them. In a tree a subtree is entered unless the triangle inequality rules it out.

``factor`` tightens the inequality, for shards and subtrees alike: factor one skips only what
cannot hold a nearer neighbour and so is exact, larger factors skip more. In many dimensions
little can be skipped, and an exact query then visits most shards.

Vectors that are null, zero, empty or hold a null or non-finite component take no part,
neither do rows without an id. Vectors meet only vectors of their own length. Ties go
to the smaller id; rows that repeat the query's id are left out with it, and other
repeated rows count as neighbours each. Any number of equal vectors is split evenly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsig.session import materialize

SHARD_ROWS = 8192
#: Vantage points of a vector length at most; larger shards are cut into parts.
MOST_SHARDS = 1024
#: Queries that stream by one copy of a part, and those that are searched at once.
SLICE_QUERIES = 1 << 16
TILE_QUERIES = 1024
LEAF = 64
#: Distances that are held at once.
TILE = 1 << 21
#: Relative error of a distance in double precision, and of the matrix product's bound on
#: a squared one, with room.
SLACK = 1e-12
BOUND_SLACK = 1e-10


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, components added in order."""
    return np.add.accumulate((a - b) ** 2, axis=-1)[..., -1]


class Tree:
    """Vantage-point tree over the rows of a matrix; halves by rank, so ties cannot unbalance it."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.vectors, self.ids, self.leaf = vectors, ids, leaf
        self.norms = (vectors * vectors).sum(axis=1)
        self.order = np.arange(len(vectors))
        self.nodes: dict[tuple[int, int], tuple] = {}
        stack = [(0, len(vectors))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                continue
            own = self.order[a:b]
            # The vantage point is a corner: the row farthest from the first one.
            far = int(squared(vectors[own], vectors[own[0]]).argmax())
            own[0], own[far] = own[far], own[0]
            rest = own[1:]
            apart = np.sqrt(squared(vectors[rest], vectors[own[0]]))
            by = np.argsort(apart, kind="stable")
            own[1:], apart = rest[by], apart[by]
            half = len(apart) // 2
            near, away = (a + 1, a + 1 + half), (a + 1 + half, b)
            self.nodes[a, b] = (
                (near, apart[0], apart[half - 1]),
                (away, apart[half], apart[-1]),
            )
            stack += [near, away]

    def search(
        self,
        queries: np.ndarray,
        own: np.ndarray,
        k: int,
        factor: float = 1.0,
        bound: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and ids of the ``k`` nearest of each query within its squared
        ``bound``, padded with the bound (or infinity) and the greatest id."""
        self.queries, self.own, self.factor = queries, own, factor
        self.query_norms = (queries * queries).sum(axis=1)
        limit = np.full(len(queries), np.inf) if bound is None else bound
        self.best = np.repeat(limit[:, None], k, axis=1)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        if len(self.vectors) and len(queries):
            self._visit((0, len(self.vectors)), np.arange(len(queries)))
        return self.best, self.found

    def _offer(self, rows: np.ndarray, who: np.ndarray) -> None:
        """Hold a leaf's vectors against queries.

        A matrix product bounds the squared distances from below; only those that could be
        among the nearest are worked out, in the order of the components.
        """
        product = self.queries[who] @ self.vectors[rows].T
        sizes = self.query_norms[who][:, None] + self.norms[rows][None, :]
        # Written so that what overflows is worked out.
        near = ~(sizes * (1 - BOUND_SLACK) - 2 * product > self.best[who, -1][:, None])
        near &= self.own[who][:, None] != self.ids[rows][None, :]
        q, v = np.nonzero(near)
        if not len(q):
            return
        kept, at = np.unique(q, return_inverse=True)
        d = np.full((len(kept), len(rows)), np.inf)
        d[at, v] = squared(self.queries[who[q]], self.vectors[rows[v]])
        self._merge(who[kept], d, np.broadcast_to(self.ids[rows], d.shape))

    def _merge(self, who: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        k = self.best.shape[1]
        d = np.concatenate([self.best[who], d], 1)
        i = np.concatenate([self.found[who], ids], 1)
        i = np.where(np.isinf(d), np.iinfo(np.int64).max, i)
        top = np.lexsort((i, d), axis=-1)[:, :k]
        self.best[who] = np.take_along_axis(d, top, 1)
        self.found[who] = np.take_along_axis(i, top, 1)

    def _visit(self, node: tuple[int, int], who: np.ndarray) -> None:
        a, b = node
        if not len(who) or a >= b:
            return
        if node not in self.nodes:
            step = max(1, TILE // ((b - a) * self.vectors.shape[1]))
            for at in range(0, len(who), step):
                self._offer(self.order[a:b], who[at : at + step])
            return
        vantage = self.order[a]
        apart = squared(self.queries[who], self.vectors[vantage])
        other = self.own[who] != self.ids[vantage]
        better = other & (apart <= self.best[who, -1])
        self._merge(
            who[better], apart[better, None], np.full((int(better.sum()), 1), self.ids[vantage])
        )
        apart = np.sqrt(apart)
        (near, low, high), (away, low2, high2) = self.nodes[node]
        inside = apart <= (high + low2) / 2
        for group, first in ((inside, True), (~inside, False)):
            for child, lo, hi in (
                ((near, low, high), (away, low2, high2)) if first
                else ((away, low2, high2), (near, low, high))
            ):
                bound = np.maximum(lo - apart, apart - hi) * self.factor
                reach = np.sqrt(self.best[who, -1])
                open_ = group & (bound <= reach + SLACK * (apart + hi))
                self._visit(child, who[open_])


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(
        v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False)
    )


class Shards:
    """Vantage points by vector length, and the distances their shards lie between."""

    def __init__(self, points: dict[int, np.ndarray]):
        self.points = points
        self.low = {d: np.full(len(p), np.inf) for d, p in points.items()}
        self.high = {d: np.full(len(p), -np.inf) for d, p in points.items()}

    def home(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest vantage point, and the distance."""
        apart = self.apart(vectors)
        best = apart.argmin(axis=1)
        return best, apart[np.arange(len(best)), best]

    def apart(self, vectors: np.ndarray) -> np.ndarray:
        points = self.points[vectors.shape[1]]
        made = np.empty((len(vectors), len(points)))
        step = max(1, TILE // (len(points) * max(vectors.shape[1], 1)))
        for at in range(0, len(vectors), step):
            made[at : at + step] = np.sqrt(squared(vectors[at : at + step, None], points[None]))
        return made

    def reached(self, vectors: np.ndarray, bound: np.ndarray, factor: float = 1.0) -> np.ndarray:
        """Which shards may hold a vector at most ``bound`` away."""
        d = vectors.shape[1]
        apart, low, high = self.apart(vectors), self.low[d], self.high[d]
        least = np.maximum(low - apart, apart - high) * factor
        slack = SLACK * (apart + np.where(np.isfinite(high), high, 0.0))
        return (least <= bound[:, None] + slack) & np.isfinite(low)


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a batch's vectors of each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.flatten().to_numpy().astype(np.float64), np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def shards_of(rows: DataFrame, shard_rows: int) -> tuple[Shards, DataFrame]:
    """Shards for stored ``rows`` (``id, v, dim``), and the rows with their ``shard``, stored."""
    sizes = rows.groupBy("dim").agg(
        F.least(F.ceil(F.count(F.lit(1)) / shard_rows), F.lit(MOST_SHARDS)).alias("points")
    )
    turn = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v"))
    drawn = rows.withColumn("turn", turn).filter(F.col("turn") <= MOST_SHARDS)
    points: dict[int, list] = {}
    # As many vectors as there are shards.
    for r in drawn.join(sizes, "dim").filter("turn <= points").orderBy("dim", "turn").select("dim", "v").collect():
        points.setdefault(r["dim"], []).append(r["v"])
    shards = Shards({d: np.array(p, np.float64) for d, p in points.items()})

    @F.arrow_udf("struct<shard:int,apart:double>")
    def place(batch: pa.Array) -> pa.Array:
        shard, apart = np.zeros(len(batch), np.int32), np.zeros(len(batch))
        for at, vectors in _by_length(batch):
            shard[at], apart[at] = shards.home(vectors)
        return pa.StructArray.from_arrays([pa.array(shard), pa.array(apart)], names=["shard", "apart"])

    placed = materialize(
        rows.withColumn("_at", place.asNondeterministic()(F.col("v"))).select("id", "v", "dim", "_at.*")
    )
    shape = placed.groupBy("dim", "shard").agg(F.min("apart").alias("low"), F.max("apart").alias("high"))
    for r in shape.collect():
        shards.low[r["dim"]][r["shard"]], shards.high[r["dim"]][r["shard"]] = r["low"], r["high"]
    return shards, placed.drop("apart")


def searched(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Neighbours from rows sorted by place, a place's candidates before its queries. A place's
    candidates are one tree; its queries are searched a tile at a time."""
    place, tree, held = None, None, []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "part", "slice", "asks")]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if place != (own := tuple(int(c[a]) for c in columns[:4])):
                place, tree, held = own, None, []
            d = int(columns[0][a])
            vectors = batch.column("v").slice(a, b - a).flatten().to_numpy().astype(np.float64).reshape(-1, d)
            ids = batch.column("id").slice(a, b - a).to_numpy()
            if not columns[4][a]:
                held.append((vectors, ids))
                continue
            if tree is None:
                vectors_of, ids_of = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros((0, d)), ids[:0])
                tree, held = Tree(vectors_of, ids_of), []
            bound = batch.column("bound").slice(a, b - a).to_numpy(zero_copy_only=False)
            # The root of a square may be less than it by rounding.
            bound = bound * bound * (1 + BOUND_SLACK)
            for at in range(0, len(ids), TILE_QUERIES):
                tile = slice(at, at + TILE_QUERIES)
                best, found = tree.search(vectors[tile], ids[tile], k, factor, bound[tile])
                hit = found < np.iinfo(np.int64).max
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[tile], k).reshape(-1, k)[hit]),
                        pa.array(found[hit]),
                        pa.array(np.sqrt(best[hit])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )


def _meet(placed: DataFrame, visits: DataFrame, k: int, factor: float, shard_rows: int, slice_queries: int) -> DataFrame:
    """The ``k`` nearest of each query in each part of a shard that it visits."""
    visits = materialize(visits)
    count = lambda df, n, name: df.groupBy("dim", "shard").agg(
        F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name)
    )
    # A row per shard.
    shape = F.broadcast(
        materialize(count(placed, shard_rows, "parts").join(count(visits, slice_queries, "slices"), ["dim", "shard"]))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    candidates = placed.join(shape, ["dim", "shard"]).select(
        "dim", "shard", own("parts").alias("part"), every("slices").alias("slice"),
        F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("bound"),
    )
    asking = visits.join(shape, ["dim", "shard"]).select(
        "dim", "shard", every("parts").alias("part"), own("slices").alias("slice"),
        F.lit(True).alias("asks"), "id", "v", "bound",
    )
    keys = ["dim", "shard", "part", "slice"]
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, math.ceil(placed.count() / (4 * shard_rows)))
    return (
        candidates.unionByName(asking)
        .repartition(tasks, *keys)
        .sortWithinPartitions(*keys, "asks")
        .mapInArrow(lambda rows: searched(rows, k, factor), "query_id bigint, vec_id bigint, score double")
    )


def visits_of(asked: DataFrame, shards: Shards, factor: float) -> DataFrame:
    """Queries (``id, v, dim, shard, bound``) once per further shard that they visit."""

    @F.arrow_udf("array<int>")
    def others(vectors: pa.Array, home: pa.Array, bound: pa.Array) -> pa.Array:
        limit, own = bound.to_numpy(zero_copy_only=False), home.to_numpy(zero_copy_only=False)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(vectors)
        for at, rows in _by_length(vectors):
            reached = shards.reached(rows, limit[at], factor)
            reached[np.arange(len(at)), own[at]] = False
            for place, row in zip(at.tolist(), reached):
                found[place] = np.flatnonzero(row).astype(np.int32)
        return pa.array(found, pa.list_(pa.int32()))

    away = others.asNondeterministic()(F.col("v"), F.col("shard"), F.col("bound"))
    return asked.withColumn("_others", away).select("id", "v", "dim", "bound", F.explode("_others").alias("shard"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    slice_queries: int = SLICE_QUERIES,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest vectors of each query by
    Euclidean distance, its own id left out. Repeated queries are answered once."""
    part = lambda df: df.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")
    ).filter(F.col("id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))
    shards, placed = shards_of(materialize(part(vectors)), shard_rows)
    asked = part(queries).dropDuplicates(["id"])

    @F.arrow_udf("int")
    def home(batch: pa.Array) -> pa.Array:
        shard = np.full(len(batch), -1, np.int32)
        for at, rows in _by_length(batch):
            if rows.shape[1] in shards.points:
                shard[at] = shards.home(rows)[0]
        return pa.array(shard)

    asked = asked.withColumn("shard", home.asNondeterministic()(F.col("v")))
    asked = materialize(asked.filter("shard >= 0").withColumn("bound", F.lit(float("inf"))))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = materialize(best(_meet(placed, asked, k, factor, shard_rows, slice_queries)))
    enough = F.when(F.count(F.lit(1)) >= k, F.max("score"))
    limits = first.groupBy(F.col("query_id").alias("id")).agg(enough.alias("limit"))
    bounded = asked.join(limits, "id", "left").withColumn("bound", F.coalesce("limit", "bound"))
    visits = visits_of(bounded.select("id", "v", "dim", "shard", "bound"), shards, factor)
    others = _meet(placed, visits, k, factor, shard_rows, slice_queries)
    return best(first.drop("rank").unionByName(others)).select("query_id", "rank", "vec_id", "score")
