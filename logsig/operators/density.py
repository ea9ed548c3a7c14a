"""Density clusters of weighted vectors.

Flat density clustering at a fixed radius: a point is core when the rows within
``epsilon`` of it, other than itself, weigh at least ``min_samples``; core points
within ``epsilon`` of each other share a cluster; clusters lighter than
``min_cluster_size`` and all other points are outliers.

The radius join is exact. Points go to the cell of their nearest pivot and to
every further cell whose border is no farther than the radius (for Euclidean
distance a point's distance to the bisecting plane of two pivots), so a point and
its neighbours meet in the point's home cell. Cells that are too large are cut again by
pivots of their own, level by level, as long as that makes them smaller, so there is
no limit to their number. What still is too large is dense: its points within half the
radius of a local centre are all neighbours, so if they weigh enough they are core points
of one cluster, and they are not compared with each other at all.

Cells are cut into blocks, and a task compares two blocks tile by tile by matrix products. A
block holds an eighth of all rows, so a row goes to a fixed number of tasks, or fewer rows if
these would not fit the memory of a task. Pairs are never emitted, and what a block on its
own tells is not asked of others: most points find enough neighbours in their own block, and
only the rest visit all blocks; the core points of a block are joined up to parts first, and
pairs of blocks are compared only where their parts still differ. Each is reduced to the
stars of its connected parts, which are joined up by min-label rounds.

Vectors that are mostly zeros travel as their entries, and tasks lay out a tile of them at a
time, so their blocks hold many more rows, however long the vectors are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, materialize, sequential_ids, spread
from ..sources.logs import OUTLIER
from .vectors import Compact, _matrix

BLOCK_POINTS = 2048
# Rows are dealt to so many blocks; a block's vectors take so many bytes at most, and twice as
# many as entries, which are never laid out as a whole.
BLOCKS, BLOCK_BYTES = 8, 48 << 20
# Vectors travel as their entries if these are at most this share of all components.
FILLED = 0.25
# A cell with more points is cut by local pivots, into so many cells at most, and so often.
POINTS_PER_PIVOT = 20_000
FANOUT = 256
LEVELS = 6
# A cell is cut only if no part keeps more than this share of its points,
SHRINKS = 0.8
# and all cuts together leave no more than this many copies of a point.
COPIES = 8
# Local centres of a dense cell.
CENTRES = 64
DIRECT_EDGES = 200_000
# Slack for rounding in squared distances from a matrix product.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Density:
    min_cluster_size: int
    min_samples: int
    epsilon: float


# The parameter sets to choose from.
DENSITY_PRESETS = {
    "ultra_sensitive": Density(2, 1, 0.05),
    "preprocessed": Density(5, 3, 0.1),
    "moderate": Density(15, 10, 0.2),
    "high": Density(25, 15, 0.3),
}


def density_parameters(
    preset: str | None = "high",
    min_cluster_size: int = 25,
    min_samples: int = 15,
    epsilon: float = 0.3,
) -> Density:
    """A known preset overrides the explicit values."""
    return DENSITY_PRESETS.get(preset, Density(min_cluster_size, min_samples, epsilon))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = a @ b.T
    squares *= -2.0
    squares += (a * a).sum(axis=1)[:, None]
    squares += (b * b).sum(axis=1)[None, :]
    return np.maximum(squares, 0.0, out=squares)


def _factors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product (one transposed) are the squared distances of the rows, but for
    rounding; components that are zero on one side add to the squares only."""
    both = a.any(axis=0) & b.any(axis=0)
    squares = [(m * m).sum(axis=1)[:, None] for m in (a, b)]
    ones = [np.ones((len(m), 1)) for m in (a, b)]
    return np.hstack([-2.0 * a[:, both], squares[0], ones[0]]), np.hstack([b[:, both], ones[1], squares[1]])


def _tiled(rows: np.ndarray) -> list[slice]:
    return [slice(i, i + BLOCK_POINTS) for i in range(0, len(rows), BLOCK_POINTS)]


def _held(column: pa.ChunkedArray) -> np.ndarray | Compact:
    """The vectors of a block, whose slices are matrices."""
    return Compact.of(column) if pa.types.is_struct(column.type) else _matrix(column)


def _laid(column: pa.ChunkedArray) -> np.ndarray:
    """The few vectors of a column as one matrix."""
    return _held(column)[0 : len(column)]


def tiles(
    rows: pa.Table, others: pa.Table, skip: Callable[[slice, slice], bool] = lambda at, of: False
) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Squared distances of two blocks, of ``BLOCK_POINTS`` by ``BLOCK_POINTS`` sites at a time."""
    a, b = _held(rows.column("vec")), _held(others.column("vec"))
    for at in _tiled(a):
        left = None
        for of in _tiled(b):
            if not skip(at, of):
                left = a[at] if left is None else left
                one, other = _factors(left, b[of])
                squares = one @ other.T
                yield at, of, np.maximum(squares, 0.0, out=squares)


def _chunks() -> Column:
    return F.ceil(F.col("_rows") / BLOCK_POINTS).cast("int")


def _chunk() -> Column:
    return F.pmod(F.xxhash64("site"), _chunks()).cast("int")


def _beside(rows: DataFrame, chosen: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` of a cell's rows, some thousands at a time, with the rows chosen from it.

    Both carry ``_rows``, the size of the cell; the chosen are few per cell.
    """
    dealt = rows.withColumn("_chunk", _chunk())
    each = chosen.withColumn("_chunk", F.explode(F.sequence(F.lit(0), _chunks() - 1)))
    key = ["cell", "_chunk"]
    return dealt.groupBy(*key).cogroup(each.groupBy(*key)).applyInArrow(compare, schema)


def _chosen(rows: DataFrame, most: int) -> DataFrame:
    """A hash-random choice of the sites at home in each cell, numbered from one, stored."""
    turn = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("site"), "site"))
    own = rows.filter("home").select("cell", "site", "vec", "_rows")
    return materialize(own.withColumn("_turn", turn).filter(F.col("_turn") <= most))


def _cut(rows: DataFrame, pivots: DataFrame, epsilon: float) -> DataFrame:
    """The rows of cells, each in every smaller cell it can matter to."""

    def place(points: pa.Table, own: pa.Table) -> pa.Table:
        if not len(points) or not len(own):
            return points.slice(0, 0).select(_PLACED)
        corner = _laid(own.sort_by("_turn").column("vec"))
        apart = np.sqrt(squared_distances(corner, corner))
        squares = squared_distances(_laid(points.column("vec")), corner)
        nearest = squares.argmin(axis=1)
        at_home = squares[np.arange(len(nearest)), nearest][:, None]
        reach = 2.0 * (epsilon + ROUNDING) * apart[nearest]
        at, child = np.nonzero(squares - at_home <= reach + ROUNDING)
        home = points.column("home").to_numpy(zero_copy_only=False)[at] & (child == nearest[at])
        cell = points.column("cell").to_numpy()[at] * FANOUT + child + 1
        moved = points.select(["site", "vec", "weight"]).take(pa.array(at))
        return pa.table([pa.array(cell), pa.array(home), *moved.columns], names=_PLACED)

    kinds = dict(rows.dtypes)
    return _beside(rows, pivots, place, ", ".join(f"{c} {kinds[c]}" for c in _PLACED))


_PLACED = ["cell", "home", "site", "vec", "weight"]


def _parted(rows: DataFrame, pivots: DataFrame, epsilon: float) -> DataFrame:
    """The cells that a cut makes smaller, as a sample of their rows says, without more copies
    of their points than they may make: ``cell`` and what its parts may make (``_most``)."""
    sample = materialize(rows.filter(_chunk() == 0))
    whole = sample.groupBy("cell", "_most").agg(F.count(F.lit(1)).alias("_whole"))
    child = _cut(sample, pivots, epsilon).groupBy("cell").agg(F.count(F.lit(1)).alias("_part"))
    around = F.floor((F.col("cell") - 1) / FANOUT).cast("bigint")
    parts = child.groupBy(around.alias("cell")).agg(
        F.max("_part").alias("_part"), F.sum("_part").alias("_parts")
    )
    pays = (F.col("_part") <= SHRINKS * F.col("_whole")) & (
        F.col("_parts") <= F.col("_most") * F.col("_whole")
    )
    left = F.col("_most") * F.col("_whole") / F.col("_parts")
    return whole.join(parts, "cell").filter(pays).select("cell", left.alias("_left"))


def cells(sites: DataFrame, epsilon: float) -> DataFrame:
    """``(cell, home, site, vec, weight)``: each site in every cell it can matter to.

    A cell that its pivots do not part stays whole.
    """
    rows = sites.select(
        F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("home"), "site", "vec", "weight"
    )
    if sites.count() <= POINTS_PER_PIVOT:
        return rows
    done = before = None
    for _ in range(LEVELS):
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))
        sizes = sizes.filter(F.col("_rows") > POINTS_PER_PIVOT)
        if before is None:
            sizes = sizes.withColumn("_most", F.lit(float(COPIES)))
        else:
            around = F.floor((F.col("cell") - 1) / FANOUT).cast("bigint")
            sizes = sizes.withColumn("_around", around).join(before, "_around").drop("_around")
        large = broadcast_if_bounded(sizes)
        if not large.isEmpty():
            wanted = F.ceil(F.col("_rows") / POINTS_PER_PIVOT) + 1
            big = rows.join(large, "cell")
            pivots = _chosen(big, FANOUT).filter(F.col("_turn") <= wanted)
            large = broadcast_if_bounded(large.join(_parted(big, pivots, epsilon), "cell"))
        ready = rows.join(large, "cell", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if large.isEmpty():
            return done
        before = large.select(F.col("cell").alias("_around"), F.col("_left").alias("_most"))
        rows = materialize(_cut(rows.join(large, "cell"), pivots, epsilon))
    return done.unionByName(rows)


def cliques(placed: DataFrame, epsilon: float, enough: int) -> DataFrame | None:
    """``(site, clique)`` of the sites that are core for certain, stored; None without dense cells.

    In a cell that could not be cut, the sites at home within half the radius of a local
    centre are within the radius of each other. A clique is named by its lowest site.
    """
    own = placed.filter("home")
    dense = own.groupBy("cell").agg(F.count(F.lit(1)).alias("_rows"))
    dense = broadcast_if_bounded(dense.filter(F.col("_rows") > POINTS_PER_PIVOT))
    if dense.isEmpty():
        return None
    rows = own.join(dense, "cell")

    def nearest(points: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(points) or not len(centres):
            ids = points.column("site").slice(0, 0)
            return pa.table({"site": ids, "weight": ids, "centre": ids})
        centres = centres.sort_by("_turn")
        squares = squared_distances(_laid(points.column("vec")), _laid(centres.column("vec")))
        # The first centre that is near enough takes a site, so near centres make one clique.
        near = squares <= (epsilon / 2) ** 2
        inside = near.any(axis=1)
        kept = points.select(["site", "weight"]).filter(pa.array(inside))
        centre = centres.column("site").to_numpy()[near[inside].argmax(axis=1)]
        return kept.append_column("centre", pa.array(centre))

    schema = "site bigint, weight bigint, centre bigint"
    near = materialize(_beside(rows, _chosen(rows, CENTRES), nearest, schema))
    heavy = near.groupBy("centre").agg(
        F.sum("weight").alias("_mass"), F.min("site").alias("clique")
    )
    heavy = broadcast_if_bounded(heavy.filter(F.col("_mass") >= enough).select("centre", "clique"))
    return materialize(near.join(heavy, "centre").select("site", "clique"))


def block_points(placed: DataFrame) -> int:
    """Rows of a block: a share of all rows that a task can hold."""
    if dict(placed.dtypes)["vec"].startswith("struct"):
        row, most = 12 * F.avg(F.size("vec.at")) + 16, 2 * BLOCK_BYTES
    else:
        row, most = 8 * F.max(F.size("vec")), BLOCK_BYTES
    size = placed.agg(F.count(F.lit(1)).alias("n"), row.alias("bytes")).first()
    held = int(most // max(size["bytes"] or 8, 8))
    return max(1, min(max(-(-size["n"] // BLOCKS), BLOCK_POINTS), held))


def block_pairs(placed: DataFrame, asking, compare, schema: str, both: bool = True) -> DataFrame:
    """Run ``compare`` on every pair of an asking home block and a cell block.

    Without ``both``, two sites that are at home in one cell meet in one order only.

    Both sides of a task hold about ``block_points`` sites, whatever a cell holds. Blocks
    of one clique (a column, -1 for none) are not compared with each other; a clique that
    does not fill a block is dealt out with the rest of its cell.
    """
    if "clique" not in placed.columns:
        placed = placed.withColumn("clique", F.lit(-1).cast("bigint"))
    points = block_points(placed)
    held = placed.filter("clique <> -1").groupBy("cell", "clique").agg(F.count(F.lit(1)).alias("_held"))
    loose = held.filter(F.col("_held") < points).select("cell", "clique", F.lit(-1).cast("bigint").alias("_loose"))
    placed = placed.join(broadcast_if_bounded(loose), ["cell", "clique"], "left")
    # ``asking`` still sees the clique itself.
    placed = placed.withColumn("_clique", F.coalesce("_loose", "clique")).drop("_loose")
    of = placed.groupBy("cell", "_clique").agg(
        F.ceil(F.count(F.lit(1)) / points).cast("int").alias("_blocks")
    )
    before = Window.partitionBy("cell").orderBy("_clique")
    numbered = of.withColumn(
        "_first", (F.sum("_blocks").over(before) - F.col("_blocks")).cast("int")
    )
    group = F.collect_list(F.struct("_clique", "_first", "_blocks"))
    sizes = numbered.withColumn("_groups", group.over(Window.partitionBy("cell")))
    sized = placed.join(broadcast_if_bounded(sizes), ["cell", "_clique"]).withColumn(
        "_own", F.col("_first") + F.pmod(F.xxhash64("site"), F.col("_blocks")).cast("int")
    )
    if not both:
        guests = placed.filter(~F.col("home")).select("cell").distinct()
        guests = broadcast_if_bounded(guests.withColumn("_guests", F.lit(True)))
        sized = sized.join(guests, "cell", "left")
    others = F.filter(
        "_groups", lambda g: (F.col("_clique") == -1) | (g["_clique"] != F.col("_clique"))
    )
    every = F.explode(
        F.flatten(
            F.transform(
                others, lambda g: F.sequence(g["_first"], g["_first"] + g["_blocks"] - 1)
            )
        )
    )
    # Fresh aliases: both sides come from one table.
    data = [F.col(c).alias(c) for c in ("cell", "site", "vec", "weight", "part") if c in placed.columns]
    more_names = [] if both else ["home", "_guests"]
    more = [F.col(c).alias(c) for c in more_names]
    left = sized.filter(F.col("home") & asking).select(
        *data, *more, F.col("_own").alias("_a"), every.alias("_b")
    )
    right = sized.select(*data, *more, every.alias("_a"), F.col("_own").alias("_b"))
    if not both:
        once = F.col("_a") <= F.col("_b")
        left, right = left.filter(once | F.col("_guests")), right.filter(once | ~F.col("home"))
        left, right = left.drop(*more_names), right.drop(*more_names)
    key = ["cell", "_a", "_b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema)


def _dealt(placed: DataFrame, points: int, block: str) -> DataFrame:
    """Rows with the ``block`` of their cell that they fall in, and how many it has (``_of``)."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / points).cast("int").alias("_of"))
    own = F.pmod(F.xxhash64("site"), F.col("_of")).cast("int")
    return placed.join(broadcast_if_bounded(sizes), "cell").withColumn(block, own)


def _reached(rows: pa.Table, others: pa.Table, radius: float, enough: int) -> pa.Table:
    """Weight of ``others`` within the radius of each row; a row that has enough is not counted on."""
    ids, weights = rows.column("site").to_numpy(), others.column("weight").to_numpy()
    total = np.zeros(len(ids), np.int64)
    a, b, todo = _held(rows.column("vec")), _held(others.column("vec")), np.arange(len(ids))
    take = a.take if isinstance(a, Compact) else a.__getitem__
    for of in _tiled(weights) if len(ids) else ():
        right, own = b[of], weights[of]
        for at in _tiled(todo):
            one, other = _factors(take(todo[at]), right)
            near = one @ other.T <= radius
            if (own == own[0]).all():
                total[todo[at]] += np.count_nonzero(near, axis=1) * own[0]
            else:
                found = near.astype(np.float64) @ own.astype(np.float64)
                total[todo[at]] += np.rint(found).astype(np.int64)
        todo = todo[total[todo] < enough]
        if not len(todo):
            break
    return pa.table({"site": ids, "near": total})


def dense_sites(placed: DataFrame, asking: Column, epsilon: float, enough: int) -> DataFrame:
    """``(site)`` of the asking sites with rows of ``enough`` weight within ``epsilon``, itself included.

    Each asks its own block first; who has enough there does not go on to all others.
    """
    radius, schema = epsilon * epsilon + ROUNDING, "site bigint, near bigint"
    points = block_points(placed)
    asks = F.col("home") & asking

    def alone(rows: pa.Table) -> pa.Table:
        return _reached(rows.filter(rows.column("_asks")), rows, radius, enough)

    blocks = _dealt(placed.withColumn("_asks", asks), points, "_own")
    own = blocks.select("cell", "_own", "_asks", "site", "vec", "weight").groupBy("cell", "_own")
    weighed = lambda parts: parts.groupBy("site").agg(F.sum("near").alias("near"))
    much = F.col("near") >= enough
    found = materialize(weighed(own.applyInArrow(alone, schema)).filter(much).select("site"))
    rest = placed.filter(asks).join(broadcast_if_bounded(found, stored=True), "site", "left_anti")
    # The askers are few now, so blocks of all rows go to few tasks.
    left = _dealt(materialize(rest.select("cell", "site", "vec")), points, "_a")
    right = _dealt(placed.select("cell", "site", "vec", "weight"), max(points // 2, 1), "_b")
    of_left = left.groupBy("cell").agg(F.first("_of").alias("_as"))
    of_right = right.groupBy("cell").agg(F.first("_of").alias("_bs"))
    count = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(broadcast_if_bounded(of_right), "cell").withColumn("_b", count("_bs"))
    right = right.join(broadcast_if_bounded(of_left), "cell").withColumn("_a", count("_as"))
    key = ["cell", "_a", "_b"]
    pairs = left.select(*key, "site", "vec").groupBy(*key).cogroup(
        right.select(*key, "site", "vec", "weight").groupBy(*key)
    )
    parts = pairs.applyInArrow(lambda rows, others: _reached(rows, others, radius, enough), schema)
    return found.union(weighed(parts).filter(much).select("site"))


def _stars(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each connected part of a bipartite graph to its lowest id."""
    edges, seen_left, seen_right = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in range(len(left)):
        if seen_left[start]:
            continue
        front, part_left, part_right = np.array([start]), [start], []
        seen_left[start] = True
        while len(front):
            fresh = np.nonzero(near[front].any(axis=0) & ~seen_right)[0]
            seen_right[fresh] = True
            part_right.extend(fresh)
            front = np.nonzero(near[:, fresh].any(axis=1) & ~seen_left)[0] if len(fresh) else []
            seen_left[front] = True
            part_left.extend(front)
        members = np.unique(np.concatenate([left[part_left], right[np.array(part_right, int)]]))
        edges.extend((int(m), int(members[0])) for m in members[1:])
    return edges


def sparse(near: np.ndarray) -> bool:
    """Whether the pairs of a tile are few enough to be listed."""
    return np.count_nonzero(near) <= 16 * sum(near.shape)


def _united(label: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """Labels after the parts that edges between labels join; the lowest label stays."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    moved = np.arange(len(label))
    moved[list(parent)] = [root(v) for v in parent]
    return moved[label]


def _links(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the different labels which the near pairs of a tile join."""
    runs = [np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) for n in (left, right)]
    for axis, at in enumerate(runs):
        if len(at) < near.shape[axis]:
            near = np.logical_or.reduceat(near, at, axis=axis)
    left, right = left[runs[0]], right[runs[1]]
    near = near & (left[:, None] != right)
    if not sparse(near):
        return _stars(left, right, near)
    i, j = np.nonzero(near)
    most = max(int(left.max()), int(right.max())) + 1
    pairs = np.unique(left[i].astype(np.int64) * most + right[j])
    return list(zip((pairs // most).tolist(), (pairs % most).tolist(), strict=True))


def _part_edges(rows: pa.Table, others: pa.Table, radius: float) -> pa.Table:
    """Edges between the parts (by their names) of which some rows are within the radius."""
    if not len(rows) or not len(others):
        return pa.table({"src": np.zeros(0, np.int64), "dst": np.zeros(0, np.int64)})
    same = rows is others
    # Rows of a part follow each other, so that tiles are of few parts.
    rows = rows.sort_by("part")
    others = rows if same else others.sort_by("part")
    names = [t.column("part").to_numpy() for t in (rows, others)]
    parts, place = np.unique(np.concatenate(names), return_inverse=True)
    left, right = place[: len(rows)], place[len(rows) :]
    label = np.arange(len(parts))

    def known(at: slice, of: slice) -> bool:
        """Whether all sites of a tile are in one part already."""
        if same and of.start < at.start:
            return True
        low = label[left[at.start]]
        return bool((label[left[at]] == low).all() and (label[right[of]] == low).all())

    for at, of, apart in tiles(rows, others, known):
        edges = _links(label[left[at]], label[right[of]], apart <= radius)
        if edges:
            label = _united(label, edges)
    moved = np.flatnonzero(label != np.arange(len(parts)))
    return pa.table({"src": parts[moved], "dst": parts[label[moved]]})


def block_stars(placed: DataFrame, epsilon: float) -> DataFrame:
    """Edges that connect what is connected inside the blocks of each cell, taken alone."""
    radius = epsilon * epsilon + ROUNDING
    home = placed.filter("home").select("cell", F.col("site").alias("part"), "site", "vec")
    blocks = _dealt(home, block_points(placed), "_own").drop("_of").groupBy("cell", "_own")
    alone = lambda rows: _part_edges(rows, rows, radius)
    return blocks.applyInArrow(alone, "src bigint, dst bigint")


def part_stars(placed: DataFrame, epsilon: float) -> DataFrame:
    """Edges that connect the parts (``part``) which edges of at most ``epsilon`` connect."""
    radius = epsilon * epsilon + ROUNDING
    several = placed.groupBy("cell").agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
    several = broadcast_if_bounded(several.filter("_low <> _high").select("cell"))
    open_ = materialize(placed.join(several, "cell", "left_semi"))
    compare = lambda rows, others: _part_edges(rows, others, radius)
    return block_pairs(open_, F.lit(True), compare, "src bigint, dst bigint", both=False).distinct()


def _joined_edges(edges: pa.Table) -> pa.Table:
    """Lowest connected id of every vertex on a bounded number of edges."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in zip(edges.column("src").to_pylist(), edges.column("dst").to_pylist(), strict=True):
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return pa.table(
        {"site": pa.array(list(parent), pa.int64()), "low": pa.array(map(root, parent), pa.int64())}
    )


def _part_of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the lowest vertex of what edges connect, ``DIRECT_EDGES`` of them at a time."""

    def joined(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _joined_edges(pa.Table.from_batches(rows)).rename_columns(["src", "dst"])
        yield from found.filter(pc.not_equal(found.column("src"), found.column("dst"))).to_batches()

    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= DIRECT_EDGES:
            yield from joined(held)
            held = []
    if held:
        yield from joined(held)


def connected_components(
    vertices: DataFrame,
    edges: DataFrame,
    direct_edges: int = DIRECT_EDGES,
    by_task: bool = False,
) -> DataFrame:
    """``(site, component)``: the lowest id each vertex is connected to.

    Up to ``direct_edges`` edges are joined up in one task. For more, each round
    takes the lowest label among a vertex and its neighbours, then the label of
    that label, until nothing changes. With ``by_task`` tasks join up the edges they hold
    before that, which takes few rounds then; all ends of edges are vertices there.
    """
    edges = materialize(edges)
    if edges.count() <= direct_edges:
        joined = edges.groupBy().applyInArrow(_joined_edges, "site bigint, low bigint")
        return vertices.join(joined, "site", "left").select(
            "site", F.coalesce("low", "site").alias("component")
        )
    if by_task:
        edges = edges.select("src", "dst").mapInArrow(_part_of_edges, "src bigint, dst bigint")
        edges = materialize(edges)
    both = materialize(edges.union(edges.select("dst", "src")).distinct())
    labels = materialize(vertices.select("site", F.col("site").alias("component")))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("site", "dst"), "dst")
            .groupBy(F.col("src").alias("site"))
            .agg(F.min("component").alias("_heard"))
        )
        lower = labels.join(heard, "site", "left").select(
            "site",
            F.col("component").alias("_before"),
            F.least("component", "_heard").alias("component"),
        )
        jump = lower.select(F.col("site").alias("component"), F.col("component").alias("_jump"))
        moved = materialize(
            lower.join(jump, "component").select(
                "site", "_before", F.least("component", "_jump").alias("component")
            )
        )
        labels = moved.select("site", "component")
        if moved.filter(F.col("_before") != F.col("component")).isEmpty():
            return labels


def core_components(
    sites: DataFrame,
    parameters: Density,
    block_points: int = BLOCK_POINTS,
    direct_edges: int = DIRECT_EDGES,
) -> DataFrame:
    """``(site, component)`` of the core sites. Up to ``block_points`` need one task only."""
    if sites.count() <= block_points:
        return sites.groupBy().applyInArrow(
            _block_components(parameters), "site bigint, component bigint"
        )
    enough = parameters.min_samples + 1
    sites = packed(sites)
    placed = materialize(cells(sites, parameters.epsilon))
    groups = cliques(placed, parameters.epsilon, enough)
    light = F.col("weight") < enough
    sure = sites.filter(~light).select("site")
    if groups is not None:
        known = broadcast_if_bounded(groups, stored=True)
        placed = placed.join(known, "site", "left").fillna(-1, ["clique"])
        light = light & (F.col("clique") == -1)
        sure = sure.union(groups.select("site")).distinct()
    cores = materialize(sure.union(dense_sites(placed, light, parameters.epsilon, enough)))
    core_cells = placed.join(broadcast_if_bounded(cores, stored=True), "site", "left_semi")
    stars = block_stars(core_cells, parameters.epsilon)
    if groups is not None:
        stars = stars.union(groups.filter("site <> clique").select("site", "clique"))
    parts = connected_components(cores, stars, direct_edges).withColumnRenamed("component", "part")
    parts = materialize(parts)
    known = placed.join(broadcast_if_bounded(parts.distinct()), "site")
    joins = part_stars(known, parameters.epsilon)
    names = parts.select(F.col("part").alias("site")).distinct()
    joined = connected_components(names, joins, direct_edges).withColumnRenamed("site", "part")
    return parts.join(broadcast_if_bounded(joined), "part").select("site", "component")


def _block_components(parameters: Density):
    radius = parameters.epsilon * parameters.epsilon + ROUNDING

    def components(sites: pa.Table) -> pa.Table:
        ids = sites.column("site").to_numpy()
        matrix = _matrix(sites.column("vec"))
        near = squared_distances(matrix, matrix) <= radius
        weights = sites.column("weight").to_numpy().astype(np.float64)
        core = np.rint(near.astype(np.float64) @ weights) >= parameters.min_samples + 1
        lowest = {int(i): int(i) for i in ids[core]}
        lowest.update(_stars(ids[core], ids[core], near[np.ix_(core, core)]))
        return pa.table(
            {
                "site": pa.array(list(lowest), pa.int64()),
                "component": pa.array(list(lowest.values()), pa.int64()),
            }
        )

    return components


def sites_of(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The points with the id of their ``site``, and the stored sites ``(site, vec, weight)``.

    A site is all points of one vector, named by the lowest ``point_id``. Vectors meet as
    digests of 128 bits; they are neither grouped by nor joined on.
    """
    vec = F.col("vec").cast("array<double>")
    # Stored first: a featurizer runs once.
    typed = materialize(
        spread(points).select(
            "point_id",
            vec.alias("vec"),
            "weight",
            F.xxhash64(vec).alias("_h1"),
            F.xxhash64(F.lit(1), vec).alias("_h2"),
        )
    )
    named = broadcast_if_bounded(
        typed.groupBy("_h1", "_h2").agg(
            F.min("point_id").alias("site"), F.sum("weight").alias("_mass")
        )
    )
    rows = materialize(
        typed.join(named, ["_h1", "_h2"]).select("point_id", "vec", "weight", "site", "_mass")
    )
    sites = rows.filter("point_id = site").select("site", "vec", F.col("_mass").alias("weight"))
    return rows.drop("_mass"), sites


def without_zeros(sites: DataFrame) -> DataFrame:
    """The sites without the components that are zero in all of them, if these are many.

    That changes no distance. Vectors of several lengths or without a length stay.
    """
    length = F.coalesce(F.size("vec"), F.lit(-1))
    ends = sites.agg(F.min(length).alias("low"), F.max(length).alias("high")).first()
    if ends["low"] is None or ends["low"] < 1 or ends["low"] != ends["high"]:
        return sites
    filled = F.filter(
        F.sequence(F.lit(0), F.lit(ends["high"] - 1)), lambda i: ~F.get("vec", i).eqNullSafe(F.lit(0.0))
    )
    used = sorted(r["at"] for r in sites.select(F.explode(filled).alias("at")).distinct().collect())
    if not used or 2 * len(used) > ends["high"]:
        return sites
    kept = F.transform(F.array(*map(F.lit, used)), lambda i: F.get("vec", i))
    return materialize(sites.withColumn("vec", kept))


def packed(sites: DataFrame) -> DataFrame:
    """The sites with their vectors as ``(width, at, x)``, the places and values of the entries
    that are not zero, if these are few; others go ``without_zeros``.

    That changes no distance. Vectors of several lengths or without a length stay.
    """
    length = F.coalesce(F.size("vec"), F.lit(-1))
    filled = F.filter(
        F.transform("vec", lambda x, i: F.when(~x.eqNullSafe(F.lit(0.0)), i)), lambda i: i.isNotNull()
    )
    seen = sites.agg(
        F.min(length).alias("low"),
        F.max(length).alias("high"),
        F.avg(F.size(filled)).alias("entries"),
    ).first()
    if seen["low"] is None or seen["low"] < 1 or seen["low"] != seen["high"]:
        return sites
    if seen["entries"] > FILLED * seen["high"]:
        return without_zeros(sites)
    entries = F.struct(
        F.lit(seen["high"]).alias("width"),
        F.col("_at").alias("at"),
        F.transform("_at", lambda i: F.get("vec", i)).alias("x"),
    )
    return materialize(sites.withColumn("_at", filled).withColumn("vec", entries).drop("_at"))


def density_cluster(
    points: DataFrame,
    parameters: Density,
    block_points: int = BLOCK_POINTS,
    direct_edges: int = DIRECT_EDGES,
) -> DataFrame:
    """Label ``(point_id, vec, weight)`` rows: adds ``cluster_id``, -1 for outliers.

    Clusters are numbered by their lowest ``point_id``. Equal vectors are one site
    with their summed weight, so copies cost nothing.
    """
    rows, sites = sites_of(points)
    parts = materialize(core_components(sites, parameters, block_points, direct_edges))
    weighed = parts.join(sites.select("site", "weight"), "site")
    kept = (
        weighed.groupBy("component")
        .agg(F.sum("weight").alias("weight"))
        .filter(F.col("weight") >= parameters.min_cluster_size)
    )
    numbered = sequential_ids(kept.select("component"), ["component"], "cluster_id")
    labelled = parts.join(numbered, "component").select("site", "cluster_id")
    return rows.join(broadcast_if_bounded(labelled), "site", "left").select(
        "point_id",
        "vec",
        "weight",
        F.coalesce("cluster_id", F.lit(OUTLIER).cast("bigint")).alias("cluster_id"),
    )
