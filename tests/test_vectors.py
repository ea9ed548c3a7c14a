"""Geometry, assignment, density clusters, training and streams against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsig.operators import density, vectors
from logsig.operators.density import DENSITY_PRESETS, Density, density_cluster, density_parameters
from logsig.operators.query import log_query
from logsig.operators.registry import map_signatures, new_signatures
from logsig.operators.vectors import (
    assign_stable_cluster,
    centroid_nearest,
    cluster_geometry,
    cluster_sample_vectors,
    nearest_blocked,
    nearest_references,
)
from logsig.plans import train as plans
from logsig.plans.infer import assign_lines
from logsig.plans.train import train
from logsig.sources import (
    Model,
    Thresholds,
    load_model,
    read_clustered,
    read_log_directory,
    save_model,
)
from logsig.streaming import stream_assign


def cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 1.0 - (float(a @ b) / (na * nb) if na and nb else 0.0)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    labels = rng.integers(0, 6, 240)
    points = centers[labels] + rng.normal(scale=0.55, size=(240, 8))
    points[17] = 0
    rows = [(i, points[i].tolist(), int(labels[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, vec array<double>, label int").cache()
    centroids = cluster_geometry(df).select(F.col("label").alias("stable_id"), F.col("centroid").alias("vec"))
    samples = cluster_sample_vectors(df, "row_id", seed=None).select(
        F.col("label").alias("stable_id"), "idx", "vec"
    )
    return points, labels, df, Model(centroids, centroids.cache(), samples.cache(), Thresholds(0.1, 0.5, 5, 0.6))


def expected(points, labels, limits):
    cents = {c: points[labels == c].mean(axis=0) for c in range(6)}
    samples = [(c, i, points[j]) for c in range(6) for i, j in enumerate(np.nonzero(labels == c)[0][:10])]
    out = []
    for p in points:
        dist, cand = min((round(cosine(p, v), 9), c) for c, v in cents.items())
        near = sorted((round(cosine(p, v), 9), c, i) for c, i, v in samples)[:5]
        vote = sum(c == cand for _, c, _ in near) / 5
        if dist < limits.primary_distance:
            out.append((cand, "direct"))
        elif dist < limits.secondary_distance and vote >= limits.knn_confidence:
            out.append((cand, "knn"))
        else:
            out.append((-1, "outlier"))
    return out


def test_geometry_against_all_pairs(world):
    points, labels, df, _ = world
    for row in cluster_geometry(df).collect():
        own = points[labels == row["label"]]
        pairs = [cosine(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        assert row["size"] == len(own)
        assert np.allclose(row["centroid"], own.mean(axis=0))
        assert np.isclose(row["avg_intra_distance"], np.mean(pairs))


def test_weighted_geometry_counts_copies(spark, world):
    _, _, df, _ = world
    some = df.limit(60).withColumn("w", F.col("row_id") % 4 + 1)
    copies = some.select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("copy"))
    a = {r["label"]: r for r in cluster_geometry(some, weight="w").collect()}
    b = {r["label"]: r for r in cluster_geometry(copies).collect()}
    assert a.keys() == b.keys()
    for label in a:
        assert a[label]["size"] == b[label]["size"]
        assert np.isclose(a[label]["avg_intra_distance"], b[label]["avg_intra_distance"])


def test_routing_visits_only_what_can_hold_the_nearest(spark):
    """Far groups of references: few blocks are visited, and the answer is exact."""
    rng = np.random.default_rng(3)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    refs = np.concatenate([c + rng.normal(0, 0.02, (40, 12)) for c in centres] + [np.zeros((2, 12))])
    rows = np.concatenate([c + rng.normal(0, 0.02, (9, 12)) for c in centres] + [np.zeros((2, 12))])
    model = spark.createDataFrame(
        [(i // 4, i % 4, v.tolist()) for i, v in enumerate(refs)], "stable_id long, idx long, vec array<double>"
    )
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "row_id long, vec array<double>")
    for k in (1, 5, 50):
        got = nearest_blocked(asked, "row_id", model, k, "vec", 12, 20).collect()
        far = np.round(1 - vectors._directions(rows) @ vectors._directions(refs).T, 9)
        for i in range(len(rows)):
            want = [(j // 4, j % 4) for j in np.argsort(far[i], kind="stable")[:k]]
            own = sorted((r["rank"], r["stable_id"], r["idx"]) for r in got if r["row_id"] == i)
            assert [r[1:] for r in own] == want
    routing, _ = vectors.routing_of(model, 12)
    held = np.isfinite(routing.radii).sum()
    reached = routing.within(rows[:-2], np.full(len(rows) - 2, 0.002))
    assert held > 12 and reached.sum(axis=1).max() < held / 2
    assert nearest_blocked(asked, "row_id", model.limit(0), 3).count() == 0


@pytest.mark.parametrize("blocked", [False, True])
def test_assignment_against_brute_force(world, monkeypatch, blocked):
    points, labels, df, model = world
    if blocked:
        monkeypatch.setattr(vectors, "BROADCAST_COMPONENTS", 0)
        monkeypatch.setattr(vectors, "BLOCK_VECTORS", 4)
        monkeypatch.setattr(vectors, "GROUP_ROWS", 50)
    got = assign_stable_cluster(df, model, "row_id").orderBy("row_id").collect()
    want = expected(points, labels, model.thresholds)
    assert [(r["stable_id"], r["match_kind"]) for r in got] == want
    assert {k for _, k in want} == {"direct", "knn", "outlier"}


def test_nearest_ties_and_too_few(spark):
    refs = spark.createDataFrame([(4, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [0.0, 1.0])], "stable_id int, vec array<double>")
    rows = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "row_id long, vec array<double>")
    got = {r["row_id"]: (r["stable_id"], r["distance"]) for r in centroid_nearest(rows, refs).collect()}
    assert got == {1: (2, 0.0), 2: (2, 1.0)}
    assert nearest_references(rows, refs, 5).count() == 6
    model = Model(refs, refs, refs.limit(0), Thresholds(0.1, 2.0, 5, 0.2))
    kinds = [r["match_kind"] for r in assign_stable_cluster(rows, model).orderBy("row_id").collect()]
    assert kinds == ["direct", "outlier"]
    empty = assign_stable_cluster(rows, Model(refs, refs.limit(0), refs, Thresholds()))
    assert {r["stable_id"] for r in empty.collect()} == {-1}


# ---- density ----------------------------------------------------------------------


def brute_density(points, weights, p):
    n = len(points)
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= p.epsilon
    core = near @ weights >= p.min_samples + 1
    label, parts = np.full(n, -1), []
    for i in range(n):
        if core[i] and not any(i in q for q in parts):
            part, todo = {i}, [i]
            while todo:
                j = todo.pop()
                for k in np.nonzero(near[j] & core)[0]:
                    if k not in part:
                        part.add(int(k))
                        todo.append(int(k))
            parts.append(part)
    kept = sorted((min(q), q) for q in parts if weights[list(q)].sum() >= p.min_cluster_size)
    for number, (_, q) in enumerate(kept):
        label[list(q)] = number
    return label.tolist()


@pytest.mark.parametrize(
    ("blocks", "direct_edges", "epsilon"),
    [(4096, 0, 0.35), (4096, 0, 0.6), (7, 0, 0.35), (7, 10_000, 0.6), (60, 0, 0.6)],
)
def test_density_against_brute_force(spark, monkeypatch, blocks, direct_edges, epsilon):
    rng = np.random.default_rng(int(epsilon * 100))
    points = np.concatenate(
        [rng.normal(c, 0.25, size=(50, 3)) for c in (0.0, 1.6, 3.0)] + [rng.uniform(-2, 5, (60, 3))]
    )
    points[5] = points[3]
    weights = rng.integers(1, 4, len(points))
    p = Density(12, 6, epsilon)
    monkeypatch.setattr(density, "BLOCK_POINTS", blocks)
    monkeypatch.setattr(density, "POINTS_PER_PIVOT", 20)
    df = spark.createDataFrame(
        [(i, points[i].tolist(), int(weights[i])) for i in range(len(points))],
        "point_id long, vec array<double>, weight long",
    )
    got = density_cluster(df, p, blocks, direct_edges).orderBy("point_id").collect()
    assert [r["cluster_id"] for r in got] == brute_density(points, weights, p)


def test_cells_are_cut_level_by_level_and_dense_ones_merged(spark, monkeypatch):
    """Wide groups part on several levels; a heap of near points is one clique, not pairs."""
    rng = np.random.default_rng(8)
    points = np.concatenate(
        [rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5), (20, 20))]
        + [rng.normal((9, 9), 0.01, (150, 2))]
    )
    monkeypatch.setattr(density, "BLOCK_POINTS", 16)
    monkeypatch.setattr(density, "POINTS_PER_PIVOT", 25)
    monkeypatch.setattr(density, "FANOUT", 4)
    df = spark.createDataFrame(
        [(i, v.tolist(), 1) for i, v in enumerate(points)], "site long, vec array<double>, weight long"
    )
    placed = density.cells(df, 0.3).collect()
    # Each site is at home once, and meets all its neighbours there.
    assert sorted(r["site"] for r in placed if r["home"]) == list(range(len(points)))
    home = {r["site"]: r["cell"] for r in placed if r["home"]}
    members = {}
    for r in placed:
        members.setdefault(r["cell"], set()).add(r["site"])
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.3
    for i in range(len(points)):
        assert set(np.flatnonzero(near[i])) <= members[home[i]]
    assert max(home.values()) > density.FANOUT * (density.FANOUT + 1)  # the third level
    table = density.materialize(spark.createDataFrame(placed))
    held = density.cliques(table, 0.3, 10).collect()
    assert {r["site"] for r in held} >= set(range(300, 450)) and len({r["clique"] for r in held if r["site"] >= 300}) == 1
    known = table.join(density.cliques(table, 0.3, 10), "site", "left").fillna(-1, ["clique"])
    size = lambda a, b: pa.table({"n": [len(a) * len(b)]})
    every, fewer = (
        density.block_pairs(t, F.lit(True), size, "n bigint").agg(F.sum("n")).first()[0] for t in (table, known)
    )
    assert fewer <= every - 150 * 150
    got = density_cluster(
        df.withColumnRenamed("site", "point_id"), Density(10, 5, 0.3), 0, 0
    ).orderBy("point_id").collect()
    assert [r["cluster_id"] for r in got] == brute_density(points, np.ones(len(points), int), Density(10, 5, 0.3))


def test_density_asks_and_compares_only_what_is_open(spark, monkeypatch):
    """Components without entries go; rows with enough neighbours are not counted on; tiles of one part are skipped."""
    rng = np.random.default_rng(12)
    points = np.zeros((90, 12))
    points[:, [1, 4, 7]] = np.concatenate([rng.normal(c, 0.2, (30, 3)) for c in (0.0, 0.9, 6.0)])
    weights = rng.integers(1, 4, len(points))
    near = np.linalg.norm(points[:, None] - points[None], axis=2) <= 0.4
    monkeypatch.setattr(density, "BLOCK_POINTS", 8)
    rows = [(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(points, weights, strict=True))]
    sites = spark.createDataFrame(rows, "site bigint, vec array<double>, weight bigint")
    fewer = density.without_zeros(sites)
    assert {tuple(r["vec"]) for r in fewer.collect()} == {tuple(v) for v in points[:, [1, 4, 7]].tolist()}
    assert density.without_zeros(fewer) is fewer
    none = spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1)], sites.schema)
    assert density.without_zeros(none) is none
    placed = density.materialize(fewer.selectExpr("0L as cell", "true as home", "*"))
    found = density.dense_sites(placed, F.col("site") % 5 != 0, 0.4, 9).collect()
    wanted = [i for i in range(90) if near[i] @ weights >= 9 and i % 5]
    assert sorted(r["site"] for r in found) == wanted

    table = pa.table({"site": np.arange(90), "part": np.arange(90) // 30, "vec": points.tolist(), "weight": weights})
    tiles, seen = density.tiles, []

    def counted(*of):
        for at, of_, apart in tiles(*of):
            seen.append(apart.size)
            yield at, of_, apart

    monkeypatch.setattr(density, "tiles", counted)
    edges = density._part_edges(table, table, 0.4**2).to_pylist()
    joined = bool(near[:30, 30:60].any())
    assert edges == ([{"src": 1, "dst": 0}] if joined else [])
    # Tiles inside a part, half of the pairs here, are left out.
    assert sum(seen) < 90 * 90 * 0.5
    reached = density._reached(table.slice(0, 30), table, 0.4**2, 5)
    total = reached.column("near").to_numpy()
    assert ((total >= 5) == (near[:30] @ weights >= 5)).all() and (total < near[:30] @ weights).any()


def test_presets():
    assert density_parameters("moderate", 1, 1, 1.0) == DENSITY_PRESETS["moderate"]
    assert density_parameters(None, 4, 2, 0.5) == Density(4, 2, 0.5)


def test_references_are_held_by_their_entries(monkeypatch):
    """A model of mostly zeros takes little memory in a worker, and gives the same neighbours."""
    rng = np.random.default_rng(3)
    units = vectors._directions(rng.integers(0, 3, (700, 64)) * (rng.random((700, 64)) < 0.1).astype(float))
    units[[5, 690]] = units[300]
    rows = np.vstack([units[::7], vectors._directions(rng.normal(size=(40, 64))), np.zeros((1, 64))])
    held = vectors._compact(units)
    assert isinstance(held, vectors.Compact) and held.values.nbytes + held.places.nbytes < units.nbytes / 4
    assert (held[100:2000] == units[100:]).all()
    whole = np.round(1.0 - rows @ units.T, vectors.TIE_DIGITS)
    for k in (1, 5, 700):
        want = np.argsort(whole, axis=1, kind="stable")[:, :k]
        for many in (16, 699, 5000):
            monkeypatch.setattr(vectors, "REFERENCES", many)
            monkeypatch.setattr(vectors, "TILE", 16 * many)
            for matrix in (units, held):
                places, apart = vectors._nearest(rows, matrix, k)
                assert (places == want).all()
                assert np.allclose(apart, np.take_along_axis(whole, want, axis=1))
    assert vectors._compact(rng.normal(size=(5, 4))).shape == (5, 4)


def test_a_batch_is_compared_in_bounded_memory():
    """Neighbours and blocks of a batch of 10,000 rows, and what numpy holds for them at most."""
    rng = np.random.default_rng(4)
    rows, units = rng.normal(size=(10_000, 64)), vectors._directions(rng.normal(size=(20_000, 64)))
    column = pa.array(list(rows), pa.list_(pa.float64()))
    routing = vectors.Routing(units[:1024])
    routing.radii[:] = 0.1
    nearest = vectors._nearest(vectors._directions(rows[::500]), units, 5)[0]
    home = routing.home(rows)[0]

    def held(run):
        tracemalloc.start()
        found = run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, peak

    (found, _), peak = held(lambda: vectors._nearest_of(column, units, 5))
    assert (found[::500] == nearest).all() and peak < 60 << 20
    (found, _), peak = held(lambda: routing.homes(column))
    assert (found == home).all() and peak < 60 << 20
    assert [len(x) for x in vectors._slices(column)] == [4096, 4096, 1808]


# ---- training, inference, streams ---------------------------------------------------


@pytest.fixture(scope="module")
def trained(spark):
    shapes = ["[{0}] GET /a/b: {0}", "user={0} id={0} ok", "a.b.c {0}", "only ({0})"]
    lines = [s.format(i) for i in range(40) for s in shapes] + ["%% rare ++ {}".format(i) for i in range(2)]
    df = spark.createDataFrame(list(enumerate(lines)), "pos long, raw_log string")
    return train(df, preset="preprocessed")


def test_training(trained):
    stats = trained.stats.first()
    assert (stats["total_logs"], stats["num_clusters"], stats["num_outliers"]) == (162, 4, 2)
    registry = trained.model.registry.orderBy("stable_id").collect()
    assert [r["patterns"] for r in registry] == [["[X] / / :"], ["= ="], [". ."], ["( )"]]
    assert all(r["training_size"] == 40 and len(r["sample_logs"]) == 2 for r in registry)
    shape = trained.model.centroids.collect()
    assert all(np.isclose(r["centroid_norm"], 1) and np.isclose(r["avg_intra_distance"], 0) for r in shape)
    assert trained.model.samples.groupBy("stable_id").count().filter("count = 10").count() == 4


def test_training_signs_a_line_once(spark, monkeypatch):
    """Beyond the first pass only the lines that stand where samples do are signed."""
    shapes = ["[{0}] GET /a/b: {0}", "user={0} id={0} ok"]
    lines = [s.format(i) for i in range(40) for s in shapes]
    rows = [(i, line) for i, line in enumerate(lines)] + [(None, "user=x id=x ok"), (0, "[copy] GET /a/b: 1")]
    df = spark.createDataFrame(rows, "pos long, raw_log string")
    signed = []
    annotate = plans.annotate
    monkeypatch.setattr(plans, "annotate", lambda rows: signed.append(rows.count()) or annotate(rows))
    found = train(df, preset="preprocessed").model.registry.collect()
    assert signed[0] == 82 and sum(signed[1:]) <= 5 and len(signed) > 1
    every = sorted(found, key=lambda r: r["patterns"])
    assert [r["patterns"] for r in every] == [["= ="], ["[X] / / :"]]
    assert every[0]["sample_logs"] == ["user=x id=x ok", "user=0 id=0 ok"]
    assert sorted(every[1]["sample_logs"]) == ["[0] GET /a/b: 0", "[copy] GET /a/b: 1"]


def test_uniform_data_is_one_cluster(spark):
    df = spark.range(300).select(F.col("id").alias("pos"), F.lit("a: b").alias("raw_log"))
    assert [r["cluster_id"] for r in train(df).lines.select("cluster_id").distinct().collect()] == [0]


def test_clusters_do_not_depend_on_how_often_a_log_repeats(spark):
    """Two kinds of lines in 40 and in 4,000 lines; one cluster only where that is asked for."""
    text = F.when(F.col("id") % 2 == 0, "a: b").otherwise("[x] GET /q/r")

    def sizes(n, **how):
        lines = spark.range(n).select(F.col("id").alias("pos"), text.alias("raw_log"))
        training = train(lines, **how)
        found = training.model.registry.select("training_size", F.array_join("patterns", "|")).collect()
        assert training.stats.first()["num_clusters"] == len(found)
        return sorted(map(tuple, found))

    few, many = sizes(40), sizes(4000)
    assert [p for _, p in few] == [p for _, p in many] and len(few) == 2
    assert [s for s, _ in many] == [2000, 2000]
    assert [s for s, _ in sizes(4000, uniform=True)] == [4000]


@pytest.mark.parametrize("per_pattern", [True, False])
def test_inference(spark, trained, per_pattern, tmp_path):
    save_model(trained.model, str(tmp_path / "m"))
    model = load_model(spark, str(tmp_path / "m"))
    lines = spark.createDataFrame(
        [(0, "user=9 id=8 ok"), (1, "[x] GET /q/r: 5"), (2, "@@ ## never"), (3, "plain")],
        "pos long, raw_log string",
    )
    got = assign_lines(lines, model, per_pattern=per_pattern).orderBy("pos").collect()
    assert [r["stable_id"] for r in got] == [1, 0, -1, -1]


def test_stream_lines_have_the_order_of_a_batch(spark, trained, tmp_path):
    """Several files a trigger and several triggers, against the table a batch job appends."""
    logs = tmp_path / "logs"
    logs.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for names in ("ab", "cd", "e"):
        for name in names:
            text = "".join(f"user={name}{i} id={i} ok\n" for i in range(6))
            (logs / f"{name}.log").write_text(text)
        run = lambda: stream_assign(spark, str(logs), trained.model, out, state, files=3).awaitTermination()
        run()
    run()
    want = [f"user={n}{i} id={i} ok" for n in "abcde" for i in range(6)]
    table = read_clustered(spark, out)
    assert [r["raw_log"] for r in table.orderBy("pos").collect()] == want
    assert table.select("pos").distinct().count() == 30
    page, meta = log_query(table, 1, "=", limit=7, offset=10)
    assert [r["text"] for r in page.collect()] == want[10:17]
    assert meta.first()["total_matches"] == 30


def test_a_stream_batch_reads_the_registry_once(spark):
    """The registry's hashes and ids are all that finding new signatures reads of it."""
    rows = [(i, f"h{i}", ["p"], 1, None, ["s"], None) for i in range(4)]
    registry = spark.createDataFrame(
        rows, "stable_id long, signature_hash string, patterns array<string>, training_size long, "
        "inference_size long, sample_logs array<string>, is_new_pattern boolean",
    )
    signatures = spark.createDataFrame(
        [(0, "h2", ["p"], 5, ["s"], 3), (1, "new", ["q"], 2, ["t"], 9)],
        "cluster_id long, signature_hash string, patterns array<string>, size long, "
        "sample_logs array<string>, first_pos long",
    )
    mapping, added = new_signatures(signatures, registry)
    assert {(r[0], r[1], r[2]) for r in mapping.collect()} == {(0, 2, False), (1, 4, True)}
    assert [(r["stable_id"], r["signature_hash"], r["inference_size"]) for r in added.collect()] == [(4, "new", 2)]
    _, extended = map_signatures(signatures, registry)
    assert extended.count() == 5


def test_stream_equals_batch_and_replay_is_harmless(spark, trained, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "one.log").write_text("user=1 id=2 ok\n\n@@\n")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_assign(spark, str(logs), trained.model, out, state).awaitTermination()
    (logs / "two.log").write_text("only (7)\nuser=3 id=4 ok\n")
    stream_assign(spark, str(logs), trained.model, out, state).awaitTermination()
    stream_assign(spark, str(logs), trained.model, out, state).awaitTermination()
    got = spark.read.parquet(out).select("cluster", "source_file", "raw_log", "pattern")
    batch = assign_lines(read_log_directory(spark, str(logs)), trained.model)
    want = batch.select(
        F.col("stable_id").cast("int"), "source_file", "raw_log",
        F.when(F.col("stable_id") == -1, "outlier").otherwise(F.col("pattern")),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 4


def test_rows_meet_a_fixed_number_of_blocks(spark, monkeypatch):
    """However many blocks' worth a cell holds, a row goes to as many tasks; pairs meet once."""
    monkeypatch.setattr(density, "BLOCK_POINTS", 16)
    rng = np.random.default_rng(2)
    rows = [(0, True, i, [float(x) for x in rng.random(2)], 1) for i in range(640)]
    placed = spark.createDataFrame(rows, "cell long, home boolean, site long, vec array<double>, weight long")

    def size(a, b):
        return pa.table({"n": pa.array([len(a)], pa.int64()), "pairs": pa.array([len(a) * len(b)], pa.int64())})

    for both in (True, False):
        got = density.block_pairs(placed, F.lit(True), size, "n long, pairs long", both=both)
        n, pairs = got.agg(F.sum("n"), F.sum("pairs")).first()
        assert n <= density.BLOCKS * len(rows)
        assert pairs == len(rows) ** 2 if both else len(rows) ** 2 // 2 < pairs < len(rows) ** 2 * 0.7


def test_vectors_of_few_entries_travel_as_these(spark, monkeypatch):
    """The length of vectors that are mostly zeros does not bound their blocks, and no row changes."""
    rng = np.random.default_rng(5)
    points = np.zeros((400, 64))
    for i, c in enumerate(rng.integers(0, 12, 400)):
        points[i, 5 * c : 5 * c + 3] = rng.normal(1.0, 0.15, 3)
    points[399] = 0.0
    weights = rng.integers(1, 4, len(points))
    rows = [(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(points, weights, strict=True))]
    sites = spark.createDataFrame(rows, "site bigint, vec array<double>, weight bigint")
    held = density.packed(sites)
    table = held.orderBy("site").toArrow()
    assert (density._laid(table.column("vec")) == points).all()
    some = np.array([7, 399, 7, 0])
    assert (density._held(table.column("vec")).take(some) == points[some]).all()
    # Nothing to pack: filled vectors, several lengths, no vector at all.
    for odd in ([(1, [1.0, 2.0], 1)], [(1, [0.0] * 9, 1), (2, [0.0] * 8, 1)], [(1, None, 1), (2, [0.0] * 9, 1)]):
        assert "struct" not in dict(density.packed(spark.createDataFrame(odd, sites.schema)).dtypes)["vec"]
    monkeypatch.setattr(density, "BLOCK_POINTS", 16)
    monkeypatch.setattr(density, "BLOCK_BYTES", 50 * 52)
    place = lambda of: of.selectExpr("0L as cell", "true as home", "*")
    assert density.block_points(place(sites)) == 50 * 52 // (64 * 8)
    # An eighth of all rows fits, so a row goes to a fixed number of tasks.
    assert density.block_points(place(held)) == len(points) // density.BLOCKS
    points_ = sites.withColumnRenamed("site", "point_id")
    wanted = brute_density(points, weights, Density(6, 4, 0.4))
    for cut in (20_000, 40):
        monkeypatch.setattr(density, "POINTS_PER_PIVOT", cut)
        got = density_cluster(points_, Density(6, 4, 0.4), 0, 0).orderBy("point_id").collect()
        assert [r["cluster_id"] for r in got] == wanted
        assert [r["vec"] for r in got] == points.tolist()
    assert len(set(wanted)) > 3
