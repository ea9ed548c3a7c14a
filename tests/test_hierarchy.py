"""The spanning forest and the choice of clusters against plain versions over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsig.operators import density, hierarchy
from logsig.operators.density import Density, density_cluster, sites_of
from logsig.operators.hierarchy import density_hierarchy, reachability_forest

ROUNDING = density.ROUNDING


def vectors(seed, n=90, d=3):
    """Blobs of several widths, noise, and copies."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-3, 3, (6, d))
    rows = [rng.normal(centres[i % 6], 0.1 + 0.15 * (i % 6)) for i in range(n)]
    rows += [rng.uniform(-4, 4, d) for _ in range(12)] + [rows[0]] * 5 + [np.zeros(d)] * 2
    return np.round(np.array(rows), 3)


def points(spark, rows):
    data = [(i, [float(x) for x in v], 1 + i % 2) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "point_id bigint, vec array<double>, weight bigint")


def plain_sites(rows):
    firsts, weights = {}, {}
    for i, v in enumerate(map(tuple, rows)):
        firsts.setdefault(v, i)
        weights[firsts[v]] = weights.get(firsts[v], 0) + 1 + i % 2
    return firsts, weights


def plain_reach(rows, samples, radius):
    """Squared mutual reachability of the sites that have a core distance."""
    firsts, weights = plain_sites(rows)
    ids = sorted(weights)
    apart = ((rows[ids][:, None] - rows[ids][None]) ** 2).sum(axis=2)
    core = {}
    for a, i in enumerate(ids):
        mass = 0
        for b in np.argsort(apart[a], kind="stable"):
            mass += weights[ids[b]]
            if mass >= samples + 1:
                core[i] = apart[a][b]
                break
    core = {i: c for i, c in core.items() if c <= radius**2 + ROUNDING}
    edges = sorted(
        (max(apart[ids.index(i), ids.index(j)], core[i], core[j]), i, j)
        for i in core for j in core if i < j
    )
    return core, [e for e in edges if e[0] <= radius**2 + ROUNDING]


def parts(ids, edges):
    of = {i: i for i in ids}
    for _, i, j in edges:
        a, b = sorted((of[i], of[j]))
        if a != b:
            of = {k: a if c == b else c for k, c in of.items()}
    return of


def kruskal(ids, edges):
    of, length = {i: i for i in ids}, []
    for w, i, j in edges:
        if of[i] != of[j]:
            a, b = of[i], of[j]
            of = {k: a if c == b else c for k, c in of.items()}
            length.append(w)
    return length


@pytest.mark.parametrize("forced", [False, True])
def test_forest_weighs_what_kruskal_finds(spark, monkeypatch, forced):
    """Over several cells and blocks and by rounds, and in one task."""
    if forced:
        monkeypatch.setattr(density, "BLOCK_POINTS", 16)
        monkeypatch.setattr(density, "POINTS_PER_PIVOT", 30)
    rows, samples, radius = vectors(1), 3, 0.9
    _, sites = sites_of(points(spark, rows))
    cores, forest = reachability_forest(sites, samples, radius, 0 if forced else 10**6)
    core, edges = plain_reach(rows, samples, radius)
    got = {r.site: r.core for r in cores.collect()}
    assert got.keys() == core.keys() and all(abs(got[i] - core[i]) < 1e-9 for i in core)
    found = forest.collect()
    want = kruskal(core, edges)
    assert len(found) == len(want)
    assert np.allclose(sorted(r.length for r in found), sorted(want), atol=1e-9)
    # A cut at any radius leaves the same parts.
    for cut in (0.2, 0.5, 0.9):
        kept = [(r.length, r.low, r.high) for r in found if r.length <= cut**2 + ROUNDING]
        assert parts(core, kept) == parts(core, [e for e in edges if e[0] <= cut**2 + ROUNDING])


def plain_choice(rows, p, radii):
    """Excess of mass over a grid, recursively from the top."""
    _, weights = plain_sites(rows)
    core, edges = plain_reach(rows, p.min_samples, radii[-1])
    levels = []
    for r in radii:
        most = r * r + ROUNDING
        of = parts([i for i in core if core[i] <= most], [e for e in edges if e[0] <= most])
        own = {}
        for i, c in of.items():
            own.setdefault(c, set()).add(i)
        masses = {c: sum(weights[i] for i in own[c]) for c in own}
        levels.append({c: own[c] for c in own if masses[c] >= p.min_cluster_size})

    def inside(level, c):
        return [k for k in levels[level - 1] if k in levels[level][c]] if level else []

    def chain(level, c):
        gain = 1 / radii[level] - 1 / radii[min(level + 1, len(radii) - 1)]
        own = inside(level, c)
        rest = chain(level - 1, own[0]) if len(own) == 1 else 0.0
        return sum(weights[i] for i in levels[level][c]) * gain + rest

    def best(level, c):
        """Its value and the clusters taken inside, or itself."""
        own = inside(level, c)
        if len(own) == 1:
            below, taken = under(level - 1, own[0])
        else:
            below, taken = under(level, c)
        value = chain(level, c)
        return (value, [(level, c, value)]) if value >= below - 5e-10 else (below, taken)

    def under(level, c):
        own = inside(level, c)
        if len(own) == 1:
            return under(level - 1, own[0])
        found = [best(level - 1, k) for k in own]
        return sum(v for v, _ in found), [t for _, ts in found for t in ts]

    tops = [
        (g, c) for g in range(len(radii)) for c in levels[g]
        if g + 1 == len(radii) or not any(c in m for m in levels[g + 1].values())
    ]
    return {
        i: (radii[level], round(value, 6))
        for g, c in tops for level, k, value in best(g, c)[1] for i in levels[level][k]
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_choice_against_plain_recursion(spark, seed):
    rows = vectors(seed)
    p, radii = Density(6, 3, 0.3), [0.25, 0.35, 0.5, 0.7, 1.0, 1.6]
    got = density_hierarchy(points(spark, rows), p, radii).collect()
    want = plain_choice(rows, p, radii)
    firsts, _ = plain_sites(rows)
    for r in got:
        own = want.get(firsts[tuple(rows[r.point_id])])
        assert (r.cluster_id == -1) == (own is None)
        assert own is None or (r.radius, round(r.stability, 6)) == own
    assert len({r.radius for r in got if r.cluster_id >= 0}) > 1


def test_one_radius_is_the_flat_clustering(spark):
    rows, p = points(spark, vectors(3)), Density(6, 3, 0.6)
    flat = density_cluster(rows, p).select("point_id", "cluster_id")
    deep = density_hierarchy(rows, p, [p.epsilon]).select("point_id", "cluster_id")
    assert sorted(flat.collect()) == sorted(deep.collect())


def test_no_points_and_radii(spark):
    none = points(spark, np.zeros((0, 2)))
    got = density_hierarchy(none, Density(2, 1, 0.5))
    assert got.count() == 0 and got.columns[-3:] == ["cluster_id", "radius", "stability"]
    with pytest.raises(ValueError):
        density_hierarchy(none, Density(2, 1, 0.0), [0.0])


def test_hierarchy_splits_what_one_radius_joins(spark):
    """Two dense groups with a thin bridge, beside a wide group."""
    rng = np.random.default_rng(0)
    rows = np.concatenate([
        rng.normal([0, 0], 0.05, (40, 2)), rng.normal([2, 0], 0.05, (40, 2)),
        np.column_stack([np.linspace(0, 2, 9), np.zeros(9)]), rng.normal([9, 9], 0.5, (40, 2)),
    ])
    data = points(spark, np.round(rows, 3))
    flat = density_cluster(data, Density(8, 2, 0.5))
    deep = density_hierarchy(data, Density(8, 2, 0.1), [0.1, 0.15, 0.3, 0.5])
    count = lambda df: df.filter(F.col("cluster_id") >= 0).select("cluster_id").distinct().count()
    assert count(flat) == 2 and count(deep) == 3
    assert hierarchy.GRID[0] == 1.0


def block(rows, sites, weights):
    vec = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())
    return pa.table({"site": sites, "vec": vec, "weight": weights})


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e18])
@pytest.mark.parametrize("kind", ["wide", "groups", "lump"])
def test_blocks_measure_few_pairs(monkeypatch, scale, kind):
    """Nearest rows and forests of two overlapping blocks against all pairs; all are looked at in
    single precision, few are measured."""
    monkeypatch.setattr(density, "BLOCK_POINTS", 128)
    monkeypatch.setattr(hierarchy, "BLOCK_POINTS", 128)
    rng = np.random.default_rng(5)
    centres = {"wide": np.zeros((1, 6)), "groups": rng.normal(0, 40, (5, 6)), "lump": np.zeros((1, 6))}[kind]
    rows = rng.normal(centres[np.arange(900) % len(centres)], 1.0)
    if kind == "lump":
        rows[::3] = rng.normal(0, 1e-3, (300, 6))
    rows, names = rows * scale, rng.permutation(5000)[:900]
    at, of = np.arange(500), np.arange(400, 900)
    most, count = (3.0 * scale) ** 2, []
    measured = hierarchy.Pairs.measured
    monkeypatch.setattr(hierarchy.Pairs, "measured", lambda s, i, j: count.append(len(i)) or measured(s, i, j))
    apart = ((rows[at][:, None] - rows[of][None]) ** 2).sum(axis=2)

    weights = 1 + np.arange(900) % 2
    found = hierarchy._block_nearest(
        block(rows[at], names[at], weights[at]), block(rows[of], names[of], weights[of]), most, 4
    )
    assert kind == "lump" or sum(count) < apart.size / 4
    for a, near in enumerate(found.column("near").to_pylist()):
        order = [b for b in np.argsort(apart[a], kind="stable") if apart[a][b] <= most]
        full = np.flatnonzero(np.cumsum(weights[of][order]) >= 4)
        order = order[: full[0] + 1] if len(full) else order
        near = sorted((n["apart"], n["weight"]) for n in near)[: len(order)]
        assert np.allclose([n[0] for n in near], apart[a][order], rtol=1e-6, atol=0)

    cores = np.full(900, (0.2 * scale) ** 2)
    count.clear()
    forest = hierarchy._block_forest(
        block(rows[at], names[at], cores[at]), block(rows[of], names[of], cores[of]), most
    )
    assert kind == "lump" or sum(count) < apart.size / 4
    reach = np.maximum(apart, cores[0])
    edges = sorted(
        (reach[a, b], names[at[a]], names[of[b]])
        for a, b in zip(*np.nonzero(reach <= most), strict=True) if at[a] != of[b]
    )
    want = sorted(kruskal(names, edges))
    assert np.allclose(sorted(forest.column("length").to_pylist()), want, rtol=1e-6, atol=0)


@pytest.mark.parametrize("direct", [0, 12, 40])
def test_rounds_follow_the_least_edges(spark, monkeypatch, direct):
    """Parts on long ways of growing edges become one in a round, whose steps grow fourfold."""
    rng = np.random.default_rng(7)
    line = [(float(k), k, k + 1) for k in range(60)]
    wild = [(float(rng.integers(1, 9)), a, b) for a in range(70, 120) for b in rng.integers(120, 150, 2).tolist()]
    edges = sorted(dict(((low, high), length) for length, low, high in line + wild).items())
    edges = [(length, low, high) for (low, high), length in edges]
    ids = [*range(61), *range(70, 150), 500]
    sites = spark.createDataFrame([(i,) for i in ids], "site bigint")
    stored = []
    keep = hierarchy.materialize
    for module in (hierarchy, density):
        monkeypatch.setattr(module, "materialize", lambda df: stored.append(1) or keep(df))
    forest = hierarchy.spanning_forest(
        sites, spark.createDataFrame(edges, hierarchy.EDGES), direct
    ).collect()
    want = kruskal(ids, sorted(edges))
    assert sorted(r.length for r in forest) == sorted(want)
    found = [(r.length, r.low, r.high) for r in forest]
    assert parts(ids, found) == parts(ids, edges) and len(found) == len(want)
    assert len(stored) <= 30


def test_tasks_join_up_what_they_hold(spark, monkeypatch):
    """A line of vertices over two tasks needs few rounds."""
    stored = []
    keep = density.materialize
    monkeypatch.setattr(density, "materialize", lambda df: stored.append(1) or keep(df))
    vertices = spark.range(401).select(F.col("id").alias("site"))
    edges = spark.range(0, 400, 1, 2).filter("id % 100 <> 99").select(
        F.col("id").alias("src"), (F.col("id") + 1).alias("dst")
    )
    found = density.connected_components(vertices, edges, 0, by_task=True).collect()
    assert {r.site: r.component for r in found} == {v: v - v % 100 for v in range(401)}
    assert len(stored) <= 6
