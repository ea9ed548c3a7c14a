import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsig.llm import suffixes
from logsig.llm.suffixes import Contexts, Family, kept_bytes, parts_of, without_repeats

from .conftest import ODD


def plain(texts, length):
    """Every string of every text, counted; the bytes of those that occur again go."""
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde é日\x00") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(20)))
        texts.append(" ".join(parts))
    near = texts[-1][:100] + "#" + texts[-1][100:]
    return [*texts, texts[0], texts[0], near, "ab" * 300, "x" * 500, "x" * 39, "x" * 40, *ODD]


def rows_of(df):
    got = df.orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]


@pytest.mark.parametrize("length", [40, 200, 3])
def test_against_plain_strings(spark, make, length):
    texts = sample(length)
    assert rows_of(without_repeats(make(texts), "doc_id", length=length)) == plain(texts, length)


def test_split_buckets_and_long_texts(spark, make, monkeypatch):
    """A passage that most documents quote, with its border in several buckets."""
    rng = random.Random(5)
    noise = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    passage = noise(120)
    texts = [noise(70) + passage + noise(70) for _ in range(150)] + [noise(2500) + passage] + sample(1, 20)
    want = plain(texts, 40)
    monkeypatch.setattr(suffixes, "BUCKET", 10)
    monkeypatch.setattr(suffixes, "BATCH", 3)
    monkeypatch.setattr(suffixes, "SLICE", 700)
    assert rows_of(without_repeats(make(texts).repartition(7), "doc_id", length=40)) == want


def test_odd_rows_and_clashing_columns(spark, make):
    text = "the same passage stands in two documents, byte by byte"
    rows = [(None, text, "en", "s", 0), (None, text + "!", "en", "s", 1), (None, None, "en", "s", 2)]
    rows += [(7, "short", "en", "s", 3), (7, "short", "en", "s", 4), (8, "x" + text, "en", "s", 5)]
    docs = make(rows).withColumn("kept", F.lit(1)).withColumn("bytes", F.lit(2)).withColumn("a.b", F.lit(3))
    got = {r.n_chars: r for r in without_repeats(docs, "doc_id", length=20).collect()}
    assert len(got) == 6 and bytes(got[1].kept) == b"!" and bytes(got[5].kept) == b"x"
    assert bytes(got[0].kept) == b"" and got[0].n_spans == 1 and got[2].n_bytes == 0
    assert bytes(got[3].kept) == b"short" and got[0].bytes == 2 and got[0]["a.b"] == 3
    empty = without_repeats(make([]), "doc_id")
    assert empty.count() == 0 and empty.columns[-5:] == ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    with pytest.raises(ValueError):
        without_repeats(docs, "doc_id", length=1)


def test_all_bits_set_changes_nothing(spark, make, monkeypatch):
    texts = sample(8, 20)
    monkeypatch.setattr(suffixes, "marked", lambda bits, keys: np.ones(len(keys), bool))
    assert rows_of(without_repeats(make(texts), "doc_id", length=30)) == plain(texts, 30)


def test_family_of_levels():
    """Strings are marked on both sides, and levels stay few and of falling rank."""
    rng = random.Random(2)
    stock = ["".join(rng.choice("ab") for _ in range(rng.randrange(6, 14))).encode() for _ in range(120)]
    family, n = Family(6), Counter()
    for a in range(0, 120, 5):
        family.add(stock[a : a + 5], np.ones(5, np.int64))
        ranks = [level.rank for level in family.levels]
        assert ranks == sorted(set(ranks), reverse=True)
        for level in family.levels:
            assert (level.keys[1:] > level.keys[:-1]).all()
    for text in stock:
        n.update(text[i : i + 6] for i in range(len(text) - 5))
    got = {(c, i) for c, a, b in family.ranges() for i in range(a, b)}
    want = {(c, i) for c, t in enumerate(stock) for i in range(len(t) - 5) if n[t[i : i + 6]] > 1}
    assert got == want
    assert sum(len(level.keys) for level in family.levels) == len(n)


def test_contexts_hold_each_string_once():
    powers = suffixes.Powers(0)
    text = bytes(random.Random(1).choice(b"abc") for _ in range(3000))
    found = Contexts([(4, 0, text), (5, 9, text[:50])], 40, powers)
    places = [
        (r, p + i) for r, p, n in zip(found.rows, found.places, found.sizes) for i in range(n)
    ]
    assert places == [(4, i) for i in range(2961)] + [(5, 9 + i) for i in range(11)]
    for i in range(len(found.rows)):
        assert len(found.text(i)) == found.sizes[i] + 39
    assert not len(Contexts([(0, 0, b"abc")], 40, powers).rows)
    assert [p[:2] for p in parts_of(3, b"x" * 39, 40)] == []
    assert kept_bytes(b"abcdefghij", [(5, 7), (1, 3), (2, 4), (4, 5)]) == (b"ahij", 1)
