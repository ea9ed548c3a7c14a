"""A hierarchy of density clusters, and the selection of its most stable ones.

Two sites are as far apart as the largest of their distance and of both core distances (the
least radius at which the rows around a site, other than itself, weigh ``min_samples``).
Cutting the minimum spanning forest of that distance at a radius gives the flat clusters of
``density_cluster`` at this radius, so one forest holds them for all radii at once.

The forest is built without emitting pairs. A pair of blocks (``density.cells``) is reduced to
the spanning forest of the pairs in it; an edge that this drops has a path of no longer
edges, so the union of the blocks' forests still holds a minimum spanning forest of all.
A task looks at most pairs in single precision only: a site that knows enough near rows asks
for nearer ones, and a pair that is longer than the ways of both its sites to the hub of their
part is the longest of a cycle. What is left is measured in double precision.
Boruvka rounds reduce this union: each part takes its least edge to another part, parts that
an edge joins become one, until no edge leaves a part. Edges are compared by length, then
by their sites, so no round closes a cycle.

On a grid of growing radii a cluster that has exactly one cluster of the next smaller
radius in it goes on; with none or several it begins. Its stability is its weight times the
growth of 1 / radius, summed over the radii it lasts (excess of mass, on the grid). From the
largest radius down a cluster is taken if it is at least as stable as what could be taken
inside it. Points get the cluster at the largest radius that it lasts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, sequential_ids
from ..sources.logs import OUTLIER
from .density import (
    BLOCK_POINTS,
    DIRECT_EDGES,
    ROUNDING,
    Density,
    _factors,
    _tiled,
    block_pairs,
    cells,
    connected_components,
    sites_of,
    sparse,
)
from .vectors import _matrix

#: Edges that a task gathers before it keeps their forest.
MOST_EDGES = 1_000_000
_EDGE = [("length", float), ("low", np.int64), ("high", np.int64)]
#: Multiples of a preset's radius that are tried.
GRID = (1.0, 1.25, 1.5, 2.0)


class Pairs:
    """The pairs of two blocks: tiles of squared distances in single precision, of which few pairs
    are measured in double precision."""

    def __init__(self, rows: pa.Table, others: pa.Table):
        self.a, self.b = _matrix(rows.column("vec")), _matrix(others.column("vec"))
        self.squares = [np.einsum("ij,ij->i", m, m) for m in (self.a, self.b)]
        known = [x[~np.isnan(x)].max(initial=0.0) for x in self.squares]
        # Large numbers have no single precision.
        self.kind = np.float32 if max(known) < 1e30 else np.float64
        # More than the error of a product of so many terms.
        self.slack = 4 * (self.a.shape[1] + 8) * np.finfo(self.kind).eps * max(known) + 1e-37
        _, own, place = np.intersect1d(
            rows.column("site").to_numpy(), others.column("site").to_numpy(), return_indices=True
        )
        # Where a row's own site lies among the others.
        self.same = np.full(len(self.a), -1)
        self.same[own] = place

    def rounded(self, bound: np.ndarray) -> np.ndarray:
        """What a distance in a tile may be if it is up to ``bound``."""
        return (bound + self.slack).astype(self.kind)

    def _own(self, at: slice, of: slice) -> tuple[np.ndarray, np.ndarray]:
        place = self.same[at]
        i = np.flatnonzero((place >= of.start) & (place < of.stop))
        return i, place[i] - of.start

    def tiles(self):
        """Squared distances, but for ``slack``, of ``BLOCK_POINTS`` by ``BLOCK_POINTS`` sites at a time."""
        for at in _tiled(self.a):
            left = self._factor(self.a[at], -2.0, [self.squares[0][at], 1.0])
            for of in _tiled(self.b):
                apart = left @ self._factor(self.b[of], 1.0, [1.0, self.squares[1][of]]).T
                apart[self._own(at, of)] = 0.0
                yield at, of, apart

    def _factor(self, rows: np.ndarray, times: float, more: list) -> np.ndarray:
        factor = np.empty((len(rows), rows.shape[1] + 2), self.kind)
        factor[:, :-2] = rows * times
        factor[:, -2], factor[:, -1] = more
        return factor

    def measured(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of some rows and others."""
        found = np.empty(len(i))
        for k in range(0, len(i), BLOCK_POINTS):
            part = slice(k, k + BLOCK_POINTS)
            apart = self.a[i[part]] - self.b[j[part]]
            found[part] = np.einsum("ij,ij->i", apart, apart)
        found[self.same[i] == j] = 0.0
        return found

    def measured_tile(self, at: slice, of: slice) -> np.ndarray:
        one, other = _factors(self.a[at], self.b[of])
        apart = one @ other.T
        np.maximum(apart, 0.0, out=apart)
        apart[self._own(at, of)] = 0.0
        return apart


def _keep_nearest(
    held: np.ndarray, mass: np.ndarray, bound: np.ndarray, at: np.ndarray, apart: np.ndarray, weight: np.ndarray
) -> None:
    """Merge found distances into the least ones held of each row, and lower the rows' bounds to
    where these weigh as much as a row holds entries."""
    enough = held.shape[1]
    order = np.lexsort((apart, at))
    at, apart, weight = at[order], apart[order], weight[order]
    rows, first, place, counts = np.unique(at, return_index=True, return_inverse=True, return_counts=True)
    turn = np.arange(len(at)) - np.repeat(first, counts)
    kept = turn < enough
    near, heavy = np.full((len(rows), enough), np.inf), np.zeros((len(rows), enough), np.int64)
    near[place[kept], turn[kept]], heavy[place[kept], turn[kept]] = apart[kept], weight[kept]
    near, heavy = np.hstack([held[rows], near]), np.hstack([mass[rows], heavy])
    best = np.argsort(near, axis=1, kind="stable")[:, :enough]
    held[rows], mass[rows] = (np.take_along_axis(x, best, axis=1) for x in (near, heavy))
    full = np.cumsum(mass[rows], axis=1) >= enough
    reached = np.flatnonzero(full.any(axis=1))
    core = held[rows[reached], full[reached].argmax(axis=1)]
    bound[rows[reached]] = np.minimum(bound[rows[reached]], core)


def _block_nearest(rows: pa.Table, others: pa.Table, most: float, enough: int) -> pa.Table:
    """Of each row the least squared distances up to ``most``, as many as can be needed."""
    ids, weights = rows.column("site").to_numpy(), others.column("weight").to_numpy()
    # Each site weighs one or more, so no more than ``enough`` are needed.
    held = np.full((len(ids), enough if len(others) else 0), np.inf)
    mass = np.zeros(held.shape, np.int64)
    # Nothing beyond the distance at which a row has enough can matter.
    bound = np.full(len(ids), most)
    pairs = Pairs(rows, others) if len(ids) and len(others) else None
    for at, of, apart in pairs.tiles() if pairs else ():
        near = apart <= pairs.rounded(bound[at])[:, None]
        if sparse(near):
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            found = pairs.measured(at.start + i, of.start + j)
        else:
            apart = pairs.measured_tile(at, of)
            width = min(enough, apart.shape[1])
            j = np.argpartition(apart, width - 1, axis=1)[:, :width]
            found = np.take_along_axis(apart, j, axis=1).ravel()
            i, j = np.repeat(np.arange(len(j)), width), j.ravel()
        inside = found <= bound[at.start + i]
        if inside.any():
            heavy = weights[of.start + j[inside]]
            _keep_nearest(held, mass, bound, at.start + i[inside], found[inside], heavy)
    inside = held <= bound[:, None]
    offsets = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
    near = pa.StructArray.from_arrays(
        [pa.array(held[inside]), pa.array(mass[inside])], names=["apart", "weight"]
    )
    return pa.table({"site": ids, "near": pa.ListArray.from_arrays(pa.array(offsets), near)})


def core_distances(placed: DataFrame, min_samples: int, radius: float) -> DataFrame:
    """``(site, core)``: squared core distances of the sites that have one up to ``radius``."""
    enough, most = min_samples + 1, radius * radius + ROUNDING
    nearest = "array<struct<apart:double,weight:bigint>>"

    def compare(rows: pa.Table, others: pa.Table) -> pa.Table:
        return _block_nearest(rows, others, most, enough)

    parts = block_pairs(placed, F.lit(True), compare, f"site bigint, near {nearest}")
    near = F.array_sort(F.flatten(F.collect_list("near")))
    reached = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("bigint").alias("mass"), F.lit(None).cast("double").alias("core")),
        lambda s, x: F.struct(
            (s["mass"] + x["weight"]).alias("mass"),
            F.when(s["core"].isNull() & (s["mass"] + x["weight"] >= enough), x["apart"])
            .otherwise(s["core"])
            .alias("core"),
        ),
    )
    cores = parts.groupBy("site").agg(near.alias("near"))
    return cores.select("site", reached["core"].alias("core")).filter("core is not null")


def _forest(left: np.ndarray, right: np.ndarray, apart: np.ndarray, most: float) -> np.ndarray:
    """Rows (squared length, low, high) of a minimum spanning forest of the pairs of two lists of
    sites; by Prim's method on the matrix of their distances, unless the pairs are few."""
    near = apart <= most
    if sparse(near):
        i, j = np.nonzero(near & (left[:, None] != right))
        edges = np.zeros(len(i), _EDGE)
        edges["length"] = apart[i, j]
        edges["low"], edges["high"] = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
        return _reduced(edges)
    sites = np.unique(np.concatenate([left, right]))
    row_of, column_of = (np.full(len(sites), -1) for _ in range(2))
    row_of[np.searchsorted(sites, left)] = np.arange(len(left))
    column_of[np.searchsorted(sites, right)] = np.arange(len(right))
    rows_at, columns_at = np.searchsorted(sites, left), np.searchsorted(sites, right)
    best, before = np.full(len(sites), np.inf), np.full(len(sites), -1)
    open_ = np.ones(len(sites), bool)
    edges = []
    for _ in range(len(sites)):
        here = int(np.where(open_, best, np.inf).argmin())
        if not open_[here] or best[here] == np.inf:
            here = int(open_.argmax())
        elif best[here] < np.inf:
            low, high = sorted((int(sites[here]), int(sites[before[here]])))
            edges.append((best[here], low, high))
        open_[here] = False
        for at, line in ((columns_at, row_of[here]), (rows_at, column_of[here])):
            if line < 0:
                continue
            lengths = apart[line] if at is columns_at else apart[:, line]
            nearer = open_[at] & (lengths <= most) & (lengths < best[at])
            best[at[nearer]], before[at[nearer]] = lengths[nearer], here
    return np.array(edges, dtype=_EDGE)


def _reduced(edges: np.ndarray) -> np.ndarray:
    """The minimum spanning forest of a bounded number of edges."""
    edges = edges[np.lexsort((edges["high"], edges["low"], edges["length"]))]
    sites, place = np.unique(np.concatenate([edges["low"], edges["high"]]), return_inverse=True)
    parent = list(range(len(sites)))
    kept = []
    ends = place.reshape(2, -1).tolist()
    for i, (a, b) in enumerate(zip(*ends, strict=True)):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            kept.append(i)
    return edges[kept]


class _Ways:
    """The spanning forest of the pairs that a task has seen, and of each site the longest edge
    (``longest``) on a way to the hub of its ``part``.

    A pair inside a part that is longer than both ways is the longest edge of a cycle, so no
    minimum spanning forest has it. Sites are numbers from 0 on.
    """

    def __init__(self, sites: int, most: float):
        self.most = most
        self.longest, self.part = np.full(sites, most), np.full(sites, -1)
        self.forest = tuple(np.zeros(0, t) for t in (float, np.int64, np.int64))
        self.fresh, self.held = [], 0

    def add(self, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        wanted = (a != b) & (length <= self.most)
        apart = self.part[a] != self.part[b]
        wanted &= apart | (length <= np.maximum(self.longest[a], self.longest[b]))
        if not wanted.any():
            return
        length, a, b = length[wanted], a[wanted], b[wanted]
        self.fresh.append((length, a, b))
        self.held += len(length)
        if self.held >= min(max(BLOCK_POINTS, 2 * len(self.forest[0])), MOST_EDGES):
            self.reduce()
            return
        known = ~apart[wanted] & (self.part[a] >= 0)
        length, a, b = length[known], a[known], b[known]
        for one, other in ((a, b), (b, a)):
            np.minimum.at(self.longest, one, np.maximum(length, self.longest[other]))

    def reduce(self) -> None:
        """Leave the forest of all edges held, and take its ways."""
        length, a, b = (np.concatenate(x) for x in zip(self.forest, *self.fresh, strict=True))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a, length))
        length, a, b = length[order], a[order], b[order]
        sites = len(self.part)
        parent, kept = list(range(sites)), []
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[x] = y
                kept.append(i)
        self.forest = length, a, b = length[kept], a[kept], b[kept]
        self.fresh, self.held = [], 0
        root = np.array(parent)
        while (root[root] != root).any():
            root = root[root]
        degree = np.bincount(np.concatenate([a, b]), minlength=sites)
        self.part = np.where(degree > 0, root, -1)
        self.longest = np.full(sites, self.most)
        # The hub of a part is its site with the most edges.
        order = np.lexsort((-degree, root))
        hubs = order[np.concatenate([[True], root[order][1:] != root[order][:-1]])[: len(order)]]
        ends, others = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(ends, kind="stable")
        others, lengths = others[order], np.concatenate([length, length])[order]
        starts = np.concatenate([[0], np.cumsum(degree)])
        front, seen = hubs[degree[hubs] > 0], np.zeros(sites, bool)
        self.longest[front], seen[front] = 0.0, True
        while len(front):
            sizes = degree[front]
            at = np.repeat(starts[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            way = np.maximum(np.repeat(self.longest[front], sizes), lengths[at])
            new = ~seen[others[at]]
            front = others[at[new]]
            self.longest[front], seen[front] = way[new], True

    def reach(self, apart: np.ndarray, to: np.ndarray, by: np.ndarray, core: np.ndarray, slack: float) -> None:
        """Ways of the sites of a tile that have none yet, by those that have one."""
        new, known = np.flatnonzero(self.part[to] < 0), np.flatnonzero(self.part[by] >= 0)
        if not len(new) or not len(known):
            return
        ways = np.maximum(apart[np.ix_(new, known)], self.longest[by[known]].astype(apart.dtype))
        best = ways.argmin(axis=1)
        way = np.maximum(ways[np.arange(len(new)), best].astype(float) + 2 * slack, core[new])
        found = way <= self.most
        self.longest[to[new[found]]] = way[found]
        self.part[to[new[found]]] = self.part[by[known[best[found]]]]

    def open(self, apart: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: Pairs) -> np.ndarray:
        """Which pairs of a tile may be in the forest."""
        ends = [pairs.rounded(self.longest[x]) for x in (left, right)]
        near = apart <= ends[0][:, None]
        near |= apart <= ends[1][None, :]
        mine, other = self.part[left], self.part[right]
        named = np.concatenate([mine[mine >= 0], other[other >= 0]])
        if len(named) and (named != named[0]).any():
            near |= (mine[:, None] != other[None, :]) & (apart <= pairs.rounded(np.array(self.most)))
        return near


def _block_forest(rows: pa.Table, others: pa.Table, most: float) -> pa.Table:
    """Edges of a minimum spanning forest of the pairs of two blocks up to ``most``."""
    names = [t.column("site").to_numpy() for t in (rows, others)]
    cores = [t.column("weight").to_numpy() for t in (rows, others)]
    sites, place = np.unique(np.concatenate(names), return_inverse=True)
    left, right = place[: len(rows)], place[len(rows) :]
    pairs, ways = Pairs(rows, others), _Ways(len(sites), most)
    for at, of, apart in pairs.tiles():
        mine, other = left[at], right[of]
        ways.reach(apart, mine, other, cores[0][at], pairs.slack)
        ways.reach(apart.T, other, mine, cores[1][of], pairs.slack)
        near = ways.open(apart, mine, other, pairs)
        if sparse(near):
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            length = pairs.measured(at.start + i, of.start + j)
            np.maximum(length, np.maximum(cores[0][at][i], cores[1][of][j]), out=length)
            ways.add(length, mine[i], other[j])
        else:
            apart = pairs.measured_tile(at, of)
            np.maximum(apart, cores[0][at][:, None], out=apart)
            np.maximum(apart, cores[1][of][None, :], out=apart)
            edges = _forest(mine, other, apart, most)
            ways.add(edges["length"], edges["low"], edges["high"])
    ways.reduce()
    length, low, high = ways.forest
    return pa.table({"length": length, "low": sites[low], "high": sites[high]})


def reachability_edges(placed: DataFrame, radius: float) -> DataFrame:
    """``(length, low, high)``, squared: edges that hold a minimum spanning forest of all pairs up
    to ``radius``. ``placed`` has core distances in the place of weights."""
    most = radius * radius + ROUNDING

    def compare(rows: pa.Table, others: pa.Table) -> pa.Table:
        if not len(rows) or not len(others):
            edges = np.zeros(0, dtype=_EDGE)
            return pa.table({n: edges[n].copy() for n in edges.dtype.names})
        return _block_forest(rows, others, most)

    found = block_pairs(placed, F.lit(True), compare, EDGES, both=False)
    return found.groupBy("low", "high").agg(F.min("length").alias("length")).select(
        "length", "low", "high"
    )


EDGES = "length double, low bigint, high bigint"


def _joined_in_order(edges: pa.Table, ends: Sequence[str]) -> pa.Table:
    """The spanning forest of a bounded number of edges between what ``ends`` name."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    order = edges.select(["length", "low", "high"])
    columns = (c.to_pylist() for c in (*order.columns, *edges.select(list(ends)).columns))
    for i, (_, _, _, one, other) in sorted(enumerate(zip(*columns, strict=True)), key=lambda e: e[1][:3]):
        a, b = root(one), root(other)
        if a != b:
            parent[a] = b
            kept.append(i)
    return order.take(kept)


def _followed(least: DataFrame) -> DataFrame:
    """``(component, _to)``: the part at the end of the way from each part over its least edge, of
    stored rows ``(part, other)``.

    Edges are in one order, so such a way ends in two parts that have the same least edge; the
    lower one gives its name. Each step follows a way four times as far.
    """
    back = least.select(F.col("part").alias("other"), F.col("other").alias("_back"))
    ends = (F.col("_back") == F.col("part")) & (F.col("part") < F.col("other"))
    ways = least.select("part", "other").join(back, "other").select(
        "part", F.when(ends, F.col("part")).otherwise(F.col("other")).alias("to")
    )
    ways = materialize(ways)
    while True:
        further = ways
        for _ in range(2):
            on = further.select(F.col("part").alias("_at"), F.col("to").alias("_on"))
            further = further.join(on, F.col("to") == F.col("_at")).select("part", F.col("_on").alias("to"))
        before = ways.select("part", F.col("to").alias("_before"))
        further = materialize(further.join(before, "part"))
        ways = further.select("part", "to")
        if further.filter("to <> _before").isEmpty():
            return ways.select(F.col("part").alias("component"), F.col("to").alias("_to"))


def spanning_forest(
    sites: DataFrame, edges: DataFrame, direct_edges: int = DIRECT_EDGES
) -> DataFrame:
    """The edges ``(length, low, high)`` of the minimum spanning forest, by Boruvka rounds.

    Up to ``direct_edges`` edges are joined up in one task.
    """
    edges = materialize(edges)
    if edges.count() <= direct_edges:
        return edges.groupBy().applyInArrow(lambda rows: _joined_in_order(rows, ("low", "high")), EDGES)
    parts = materialize(sites.select("site", F.col("site").alias("component")))
    forest = edges.select("length", "low", "high").limit(0)
    while True:
        ends = edges
        for end, name in (("low", "a"), ("high", "b")):
            own = parts.select(F.col("site").alias(end), F.col("component").alias(name))
            ends = ends.join(own, end)
        # Edges inside a part never leave one again.
        edges = materialize(ends.filter("a <> b").select("length", "low", "high", "a", "b"))
        left = edges.count()
        if left <= direct_edges:
            if left:
                join = lambda rest: _joined_in_order(rest, ("a", "b"))
                forest = forest.unionByName(edges.groupBy().applyInArrow(join, EDGES))
            # Two parts may have taken one edge.
            return forest.distinct()
        edge = F.struct("length", "low", "high", "a", "b")
        least = (
            edges.select(edge.alias("edge"), F.explode(F.array("a", "b")).alias("part"))
            .groupBy("part")
            .agg(F.min("edge").alias("edge"))
        )
        other = F.when(F.col("part") == F.col("edge.a"), F.col("edge.b")).otherwise(F.col("edge.a"))
        least = materialize(least.select("part", other.alias("other"), "edge.length", "edge.low", "edge.high"))
        forest = forest.unionByName(least.select("length", "low", "high"))
        if least.count() <= direct_edges:
            links = least.select(F.col("part").alias("src"), F.col("other").alias("dst"))
            whole = connected_components(least.select(F.col("part").alias("site")), links, direct_edges)
            whole = whole.select(F.col("site").alias("component"), F.col("component").alias("_to"))
        else:
            whole = _followed(least)
        parts = materialize(
            parts.join(whole, "component", "left").select(
                "site", F.coalesce("_to", "component").alias("component")
            )
        )
        edges = edges.select("length", "low", "high")


def reachability_forest(
    sites: DataFrame,
    min_samples: int,
    radius: float,
    direct_edges: int = DIRECT_EDGES,
) -> tuple[DataFrame, DataFrame]:
    """Stored core distances ``(site, core)`` and the forest ``(length, low, high)``, squared and
    up to ``radius``, of stored ``sites`` (``site, vec, weight``)."""
    placed = materialize(cells(sites, radius))
    cores = materialize(core_distances(placed, min_samples, radius))
    reaching = materialize(sites.join(cores, "site").select("site", "vec", F.col("core").alias("weight")))
    edges = reachability_edges(materialize(cells(reaching, radius)), radius)
    return cores, materialize(spanning_forest(cores, edges, direct_edges))


def grid_clusters(
    sites: DataFrame,
    cores: DataFrame,
    forest: DataFrame,
    radii: Sequence[float],
    min_cluster_size: int,
    direct_edges: int = DIRECT_EDGES,
) -> DataFrame:
    """``(level, site, component, mass)`` of the sites in a cluster of each radius, stored.

    The parts at one radius are the vertices of the next, so each radius only looks at its
    own edges between them.
    """
    weights = sites.select("site", "weight")
    known = cores.join(weights, "site")
    parts, low, levels = None, -1.0, None
    for level, radius in enumerate(radii):
        most = radius * radius + ROUNDING
        present = known.filter(F.col("core") <= most).select("site", "weight")
        if parts is None:
            labels = present.withColumn("part", F.col("site"))
        else:
            labels = present.join(parts, "site", "left").withColumn(
                "part", F.coalesce("component", "site")
            )
        labels = labels.select("site", "weight", "part")
        own = forest.filter((F.col("length") > low) & (F.col("length") <= most))
        for end, name in (("low", "src"), ("high", "dst")):
            own = own.join(labels.select(F.col("site").alias(end), F.col("part").alias(name)), end)
        vertices = labels.select(F.col("part").alias("site")).distinct()
        whole = connected_components(vertices, own.select("src", "dst"), direct_edges, by_task=True)
        whole = whole.select(F.col("site").alias("part"), "component")
        at = materialize(labels.join(whole, "part").select("site", "weight", "component"))
        parts = at.select("site", "component")
        mass = at.groupBy("component").agg(F.sum("weight").alias("mass"))
        kept = at.join(mass.filter(F.col("mass") >= min_cluster_size), "component").select(
            F.lit(level).alias("level"), "site", "component", "mass"
        )
        levels = kept if levels is None else levels.unionByName(kept)
        low = most
    return materialize(levels)


def selected_clusters(grid: DataFrame, radii: Sequence[float]) -> DataFrame:
    """``(level, component, stability)`` of the clusters that are taken.

    One small table per radius: a cluster's children are those of the next smaller radius.
    """
    clusters = materialize(
        grid.groupBy("level", "component").agg(F.first("mass").alias("mass"))
    )
    # A cluster's lowest site names it, and is in the cluster around it.
    up = grid.select(
        F.col("level").alias("_above"), "site", F.col("component").alias("parent")
    )
    nested = clusters.join(
        up,
        (F.col("_above") == F.col("level") + 1) & (F.col("site") == F.col("component")),
        "left",
    ).select("level", "component", "mass", "parent")
    nested = materialize(nested)
    last = len(radii) - 1
    scored: list[DataFrame] = []
    for level in range(last + 1):
        # Nothing is known beyond the largest radius, so nothing is gained there.
        gain = 1.0 / radii[level] - 1.0 / radii[min(level + 1, last)]
        own = nested.filter(F.col("level") == level)
        if not scored:
            found = own.withColumn("chain", F.col("mass") * gain).withColumn("below", F.lit(0.0))
        else:
            inner = scored[-1].groupBy(F.col("parent").alias("component")).agg(
                F.count(F.lit(1)).alias("_n"),
                F.sum("chain").alias("_chain"),
                F.sum("below").alias("_below"),
                F.sum(F.greatest("chain", "below")).alias("_best"),
            )
            one = F.coalesce(F.col("_n"), F.lit(0)) == 1
            found = own.join(inner, "component", "left").select(
                *own.columns,
                (F.col("mass") * gain + F.when(one, F.col("_chain")).otherwise(0.0)).alias("chain"),
                F.when(one, F.col("_below"))
                .otherwise(F.coalesce("_best", F.lit(0.0)))
                .alias("below"),
            )
        scored.append(materialize(found))
    taken, closed = None, None
    for level in range(last, -1, -1):
        # Looked at: what has no cluster around it, and what is in one that was passed over.
        at = scored[level]
        if closed is not None:
            at = at.join(closed.withColumnRenamed("component", "parent"), "parent", "left").filter(
                F.col("_open").isNull() | F.col("_open")
            )
        wins = F.round(F.col("chain"), 9) >= F.round(F.col("below"), 9)
        at = materialize(at.select("level", "component", "chain", wins.alias("_wins")))
        own = at.filter("_wins").select("level", "component", F.col("chain").alias("stability"))
        taken = own if taken is None else taken.unionByName(own)
        closed = scored[level].select("component").join(at, "component", "left").select(
            "component", (~F.coalesce("_wins", F.lit(True))).alias("_open")
        )
    return taken


def density_hierarchy(
    points: DataFrame,
    parameters: Density,
    radii: Sequence[float] | None = None,
    direct_edges: int = DIRECT_EDGES,
) -> DataFrame:
    """Label ``(point_id, vec, weight)`` rows: adds ``cluster_id`` (-1 for outliers), ``radius``
    and ``stability`` of the cluster.

    ``radii`` are tried together; without them multiples of ``epsilon``, below which no
    cluster is split. Clusters are numbered by their lowest ``point_id``.
    """
    grid = sorted({float(r) for r in radii or [parameters.epsilon * g for g in GRID]})
    if not grid or grid[0] <= 0:
        raise ValueError("radii are positive numbers")
    rows, sites = sites_of(points)
    cores, forest = reachability_forest(
        sites, parameters.min_samples, grid[-1], direct_edges
    )
    levels = grid_clusters(
        sites, cores, forest, grid, parameters.min_cluster_size, direct_edges
    )
    taken = materialize(selected_clusters(levels, grid))
    members = materialize(
        levels.join(taken, ["level", "component"]).select("site", "level", "stability", "component")
    )
    lowest = members.groupBy("level", "component").agg(F.min("site").alias("first"))
    numbered = sequential_ids(lowest, ["first"], "cluster_id")
    size = F.element_at(F.array(*map(F.lit, grid)), F.col("level") + 1)
    labelled = members.join(numbered, ["level", "component"]).select(
        "site", "cluster_id", size.alias("radius"), "stability"
    )
    return rows.join(labelled, "site", "left").select(
        "point_id",
        "vec",
        "weight",
        F.coalesce("cluster_id", F.lit(OUTLIER).cast("bigint")).alias("cluster_id"),
        "radius",
        "stability",
    )
