"""Substring dedup and nearest neighbours against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsig.llm import ann, substrings

from .conftest import ODD


def plain(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, own in words:
        if i is not None:
            for s in range(len(own) - window + 1):
                key = tuple(own[s : s + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, own in words:
        gone = set()
        for s in range(len(own) - window + 1 if i is not None else 0):
            if least[tuple(own[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = b" ".join(w for n, w in enumerate(own) if n not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, block", [(50, 25), (7, 4), (5, 2)])
def test_substrings(spark, make, window, block, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 3000)
    draw = random.Random(window)
    some = lambda n: [draw.choice("abcdefghij") * draw.randrange(1, 4) for _ in range(n)]
    passages = [some(draw.randrange(window - 2, 3 * window)) for _ in range(8)]
    rows = list(enumerate(ODD))
    for i in range(20, 140):
        own = []
        for _ in range(draw.randrange(4)):
            own += some(draw.randrange(30))
            passage = draw.choice(passages)
            own += passage[draw.randrange(6) :] if draw.random() < 0.5 else passage
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(own)))
    rows += [(i, rows[-1][1]) for i in (500, 501, 502)]
    rows += [(20, rows[60][1]), (21, rows[11][1]), (None, rows[40][1]), (None, None), (-5, rows[50][1])]
    rows.append((600, " ".join(passages[0]) + " x" * 5000 + " " + " ".join(passages[0])))
    draw.shuffle(rows)
    docs = make([(i, t, "en", "s", 0) for i, t in rows]).withColumn("digest", F.lit(1)).withColumn("hits", F.lit(1))
    got = substrings.deduplicated(docs, "doc_id", window=window, block=block).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, window)
    assert substrings.deduplicated(docs.limit(0), "doc_id").count() == 0


def test_copies_are_one_stretch():
    """Equal passages fall into equal stretches, whatever stands around them."""
    hot = " ".join(f"w{i}" for i in range(300))
    texts = [f"{'x ' * i}{hot} {'y ' * (9 - i)}".encode() for i in range(9)]
    found = substrings.Passages(texts, 25, substrings.Powers(0))
    own = found.aligned()
    first, n, _ = found.stretches(found.windows(np.ones(len(own), bool), 50), 50)
    digests = list(zip(*(c.tolist() for c in found.digests(first, n + 49)), strict=True))
    # All but the ends are shared, and every window is in one stretch.
    assert len(set(digests)) < 0.2 * len(digests)
    at = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
    assert len(at) == len(set(at.tolist())) == sum(max(len(t.split()) - 49, 0) for t in texts)


def test_a_hot_passage_between_other_words(spark, make, monkeypatch):
    draw = random.Random(5)
    hot = [f"h{i}" for i in range(60)]
    texts = [[f"{i}x{n}" for n in range(draw.randrange(9))] + hot * draw.randrange(3) for i in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = make([(i, t, "en", "s", 0) for i, t in rows]).repartition(4)
    got = substrings.deduplicated(docs, "doc_id").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 50)
    # What is marked by chance changes nothing.
    monkeypatch.setattr(substrings, "marked", lambda bits, keys: np.ones(len(keys), bool))
    again = substrings.without_repeats(docs.withColumn("kept", F.lit(1)), "doc_id").collect()
    kept = {r.doc_id: r.kept for r in again}
    assert {r.doc_id: r.kept_sha256 for r in got} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()
    }


def test_short_windows_are_refused(make):
    with pytest.raises(ValueError):
        substrings.deduplicated(make(["a"]), "doc_id", window=48, block=25)


def brute(rows, queries, k):
    out = []
    for q in queries:
        near = sorted(
            (float(np.sqrt(ann.squared(np.array(v, float), np.array(rows[q][1], float)))), i)
            for i, v in rows
            if i != rows[q][0] and len(v) == len(rows[q][1])
        )
        out += [(rows[q][0], n, i, d) for n, (d, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_nearest(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=6).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(90)]  # ties
    rows += [(2000 + i, draw.normal(size=3).tolist()) for i in range(5)]  # fewer than k
    bad = [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [float("nan")] * 6), (3004, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    data = [*rows, *bad, (3005, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id bigint, v array<double>").withColumn("shard", F.lit("x"))
    queries = [0, 7, 50, 399, 400, 489, 491]
    wanted = [rows[q][0] for q in queries] + [3000, 3002, 3005]
    for shard, block in ((8192, 1024), (60, 2)):
        got = ann.nearest(df, df.filter(F.col("vec_id").isin(wanted)), "vec_id", "v", 10, 1.0, shard, block)
        assert sorted(map(tuple, got.collect())) == brute(rows, queries, 10)
    assert ann.nearest(df.limit(0), df, "vec_id", "v").count() == 0
    assert ann.nearest(df, df.limit(0), "vec_id", "v").count() == 0


def test_factor_trades_recall_for_visits():
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(3000, 4))
    tree = ann.Tree(vectors, np.arange(3000))
    own = np.arange(0, 3000, 60)
    exact = tree.search(vectors[own], own, 10)[1]
    loose = tree.search(vectors[own], own, 10, factor=1.5)[1]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose)])
    assert 0.9 <= recall <= 1.0


def test_a_part_is_one_tree_whatever_the_queries(monkeypatch):
    """Candidates come once, queries stream by in tiles and over batches."""
    draw = np.random.default_rng(6)
    vectors, asking = draw.normal(size=(90, 3)), draw.normal(size=(70, 3))
    built = []
    real = ann.Tree
    monkeypatch.setattr(ann, "Tree", lambda *a: built.append(1) or real(*a))
    monkeypatch.setattr(ann, "TILE_QUERIES", 8)

    def rows(shard, asks, ids, v):
        n = len(ids)
        columns = [[3] * n, [shard] * n, [0] * n, [0] * n, [asks] * n, ids, v.tolist(), [float("inf")] * n]
        names = ["dim", "shard", "part", "slice", "asks", "id", "v", "bound"]
        return [pa.RecordBatch.from_arrays([pa.array(c[a : a + 25]) for c in columns], names=names) for a in range(0, n, 25)]

    batches = [b for s in (0, 1) for b in rows(s, False, list(range(90)), vectors) + rows(s, True, list(range(1000, 1070)), asking)]
    found = pa.Table.from_batches(ann.searched(iter(batches), 4, 1.0)).to_pylist()
    assert len(built) == 2 and len(found) == 2 * 70 * 4
    far = np.sqrt(ann.squared(asking[:, None], vectors[None]))
    for i in range(70):
        own = sorted({(r["score"], r["vec_id"]) for r in found if r["query_id"] == 1000 + i})
        assert own == sorted(zip(far[i].tolist(), range(90)))[:4]


def test_shards_out_of_reach_are_skipped(spark):
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(12, 5)) * 50
    points = np.concatenate([c + draw.normal(size=(40, 5)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    table = df.select(F.col("vec_id").alias("id"), "v", F.size("v").alias("dim"))
    shards, placed = ann.shards_of(table, 20)
    assert placed.count() == 480 and np.isfinite(shards.low[5]).sum() > 12
    reached = shards.reached(points, np.full(480, 6.0))
    assert reached.sum(axis=1).max() < 12 and reached[np.arange(480), shards.home(points)[0]].all()
    assert shards.reached(points, np.full(480, 6.0), factor=3.0).sum() <= reached.sum()
    got = ann.nearest(df, df.filter("vec_id % 30 = 0"), "vec_id", "v", 5, shard_rows=20)
    assert sorted(map(tuple, got.collect())) == brute(rows, list(range(0, 480, 30)), 5)
