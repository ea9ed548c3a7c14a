"""SimHash groups against all pairs."""

import random

import numpy as np
import xxhash

from logsig.llm import simhash

from .conftest import ODD


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def components(prints, distance=3):
    """Smallest id reachable, by all pairs; rows are ``(id, print)``."""
    low = {p: min((i for i, q in prints if q == p and i is not None), default=None) for _, p in prints}
    label = {p: p for p in low}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= distance and label[a] > label[b]:
                    label[a], changed = label[b], True
    least = {}
    for p, top in label.items():
        if low[p] is not None:
            least[top] = min(least.get(top, low[p]), low[p])
    return {p: least.get(label[p]) for p in label}


def test_fingerprint_of_odd_texts():
    for text in [*ODD, "The Cat sat on the mat. " * 9, "a b", "É é É é"]:
        assert simhash.fingerprint(text or "") == plain(text)


def test_unary_counts_bound_the_distance():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 1 << 63, (2, 500), np.uint64)
    b[:250] = a[:250] ^ (np.uint64(1) << draw.integers(0, 64, 250, np.uint64))
    assert (np.bitwise_count(simhash.unary(a) ^ simhash.unary(b)) <= np.bitwise_count(a ^ b)).all()
    for bits in range(4):
        assert bin(int(simhash.unary(np.array([bits], np.uint64))[0])).count("1") == bits.bit_count()


def linked(spark, values, distance):
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp bigint")
    return simhash.links(df, distance).collect()


def test_links_find_every_near_pair(spark, monkeypatch):
    draw = random.Random(3)
    for rows, distance in ((4096, 3), (8, 3), (4096, 0), (4096, 1), (4096, 5)):
        monkeypatch.setattr(simhash, "CELL_ROWS", rows)
        values = {draw.getrandbits(64) for _ in range(150)}
        for v in list(values)[:60]:
            for flips in (1, 2, 3, 4, 5):
                values.add(v ^ sum(1 << b for b in draw.sample(range(64), flips)))
        base = draw.getrandbits(64)
        values |= {base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
        values |= {0, (1 << 64) - 1}
        got = {v: v for v in values}

        def root(v):
            while got[v] != v:
                v = got[v]
            return v

        for r in linked(spark, values, distance):
            a, b = (int(np.int64(x).view(np.uint64)) for x in (r.src, r.dst))
            got[root(a)] = root(b)
        want = components([(v, v) for v in values], distance)
        groups = {}
        for v in values:
            groups.setdefault(root(v), set()).add(want[v])
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len(set(want.values()))


def test_a_cell_with_many_visitors_is_cut(spark, monkeypatch):
    """One fingerprint in a cell that very many others visit: no group holds them all."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 50)
    draw = random.Random(4)
    base = draw.getrandbits(64) & ~0x5555 & ~0xAAAA
    # The others differ in the last segments of the first band, and widely in the second.
    values = {base} | {(draw.getrandbits(32) << 32) | (base & 0xFFFFFFFF) for _ in range(600)}
    near = {v ^ (1 << draw.randrange(64)) for v in list(values)[:40]}
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values | near], "fp bigint")
    placed = df.select("fp").mapInArrow(
        simhash._places(3), "band int, cell bigint, guest boolean, fp bigint"
    )
    sizes = simhash._split_cells(placed).groupBy("band", "cell", "pair").count().collect()
    assert max(r["count"] for r in sizes) <= 4 * 50
    want = components([(v, v) for v in values | near])
    got = {v: v for v in values | near}

    def root(v):
        while got[v] != v:
            v = got[v]
        return v

    for r in linked(spark, values | near, 3):
        a, b = (int(np.int64(x).view(np.uint64)) for x in (r.src, r.dst))
        got[root(a)] = root(b)
    groups = {}
    for v in want:
        groups.setdefault(root(v), set()).add(want[v])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_groups(spark, make):
    draw = random.Random(9)
    words = ["".join(draw.choice("aeiourstn") for _ in range(5)) for _ in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([2, 40, 300]))]
        texts += [" ".join(base)] * 3
        for _ in range(4):
            near = list(base)
            near[draw.randrange(len(near))] = draw.choice(words)
            texts.append(" ".join(near))
    texts.append("w " * 30_000)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(3, texts[-2], "en", "s", 0), (None, texts[12], "en", "s", 0), (None, "lone words only here", None, None, None)]
    docs = make(rows).withColumnRenamed("lang", "fp")
    got = simhash.near_duplicates(docs, "doc_id").collect()
    prints = [(r[0], plain(r[1])) for r in rows]
    want = components(prints)
    signed = lambda p: int(np.uint64(p).view(np.int64))
    assert sorted(map(tuple, got), key=str) == sorted(
        ((i, signed(p), want[p]) for i, p in prints), key=str
    )
    kept = [r.doc_id for r in simhash.representatives(docs, "doc_id").collect()]
    # Id 3 leads two groups, and has a row in each.
    assert sorted(kept, key=str) == sorted([3, *{want[p] for _, p in prints}], key=str)
    assert simhash.near_duplicates(docs.limit(0), "doc_id").count() == 0


def test_groups_without_a_key_keep_a_row_each(spark, make):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcdefghij") * draw.randrange(1, 9) for _ in range(60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[2])]
    rows += [(7, texts[3]), (7, texts[3]), (8, texts[5]), (8, texts[4])]
    docs = make([(i, t, "en", "s", 0) for i, t in rows])
    kept = [(r.doc_id, r.text) for r in simhash.representatives(docs, "doc_id").collect()]
    assert sorted(kept, key=str) == sorted({*rows[1:3], *rows[4:6], *rows[7:]}, key=str)
