import random
import re
from collections import Counter

import numpy as np
import pytest

from logsig.llm import collocation, rolling
from logsig.llm.collocation import Trie, collocations, longer, parts_of, shorter, words_of
from logsig.llm.rolling import hashed, mixed, unmixed

from .conftest import ODD

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, longest=4, top=2000):
    """The contract, phrase by phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for s in range(len(words) - k + 1):
                    f[lang, tuple(words[s : s + k])] += 1
    wanted = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, words), a in wanted.items():
        covered = any(
            g == lang
            and len(longer) > len(words)
            and any(longer[s : s + len(words)] == words for s in range(len(longer)))
            and 100 * b >= 80 * a
            for (g, longer), b in wanted.items()
        )
        if covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranks, result = Counter(), []
    for lang, phrase, a, left, right, total, score in sorted(
        out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())
    ):
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase, a, left, right, total, score))
    return result


def sample(seed, rows=60):
    rng = random.Random(seed)
    words = ["the", "a", "New", "york", "città", "日本", "x\x00y", "of", "b\x1fc"]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(rng.randrange(40)):
            parts += [rng.choice(words), rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"])]
        out.append(("".join(parts), rng.choice(["en", "fr", None, "und"])))
    hot = ("In New York city the Mayor of New York city said", "en")
    return out + [hot] * 30 + [(t, "en") for t in ODD] + [("", None), (None, None)]


def run(spark, make, rows, **options):
    docs = make([(i, t, g, "s", 0) for i, (t, g) in enumerate(rows)]).withColumnRenamed("source", "n")
    got = collocations(docs, "text", "lang", **options)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("least,longest,top", [(1, 4, None), (3, 3, 4)])
def test_against_plain_counts(spark, make, least, longest, top):
    rows = sample(least)
    got = run(spark, make, rows, least=least, longest=longest, top=top)
    assert got == plain(rows, least, longest, top or 10**9) and got


def test_many_tries_passes_and_slices(spark, make, monkeypatch):
    rows = sample(9)
    want = plain(rows, 2)
    monkeypatch.setattr(collocation, "BLOCK", 20)
    monkeypatch.setattr(collocation, "TRIE_BYTES", 1)
    monkeypatch.setattr(collocation, "PART", 7)
    assert run(spark, make, rows, least=2) == want


def test_counts_of_uneven_shards_are_exact(spark, make):
    """Shards that hold a phrase one, seven or ninety times still add up to a whole number."""
    rng = random.Random(11)
    texts = [
        "\n".join(f"w{i} x{i}" for i in range(150) for _ in range(rng.choice([0, 1, 2, 7, 90])))
        for _ in range(13)
    ]
    docs = make(texts).repartition(13, "doc_id")
    got = collocations(docs, "text", "lang", least=30)
    assert sorted(tuple(r) for r in got.collect()) == plain([(t, "en") for t in texts], 30)


def test_saturated_maps_change_nothing(spark, make, monkeypatch):
    rows = sample(4)
    monkeypatch.setattr(rolling, "BITS_EACH", 1)
    monkeypatch.setattr(
        collocation, "marked", lambda bits, keys: np.ones(len(keys), bool)
    )
    assert run(spark, make, rows, least=4) == plain(rows, 4)


def test_empty_table_and_no_phrase(spark, make):
    assert run(spark, make, []) == []
    assert run(spark, make, [("one two", "en"), (None, "en")]) == []


def test_colliding_keys_take_another_seed(spark, make, monkeypatch):
    tried = []
    real = collocation.distinct_keys

    def once(words):
        tried.append(1)
        return len(tried) > 1 and real(words)

    monkeypatch.setattr(collocation, "distinct_keys", once)
    rows = sample(2)
    assert run(spark, make, rows, least=6) == plain(rows, 6) and len(tried) == 2


def test_trie_of_many_children_and_prefixes():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    made = {tuple(rng.choice(keys[:700], rng.integers(1, 5)).tolist()) for _ in range(3000)}
    made |= {(int(keys[0]), int(k)) for k in keys[:600]}
    sequences = [np.array(s, np.uint64) for s in sorted(made)]
    trie = Trie.loads(Trie.of(sequences).dumps())
    text = rng.choice(keys, 5000)
    text[100:104] = sequences[-1][:4] if len(sequences[-1]) == 4 else text[100:104]
    pieces = np.sort(rng.integers(0, 300, 5000))
    want = Counter()
    for i in range(len(text)):
        for k in range(1, 5):
            if i + k <= len(text) and pieces[i] == pieces[i + k - 1]:
                want[tuple(text[i : i + k].tolist())] += 1
    got = trie.counts(text, pieces, np.arange(len(text)), 4, len(sequences))
    assert got.tolist() == [want[tuple(s.tolist())] for s in sequences] and got.sum() > 0


def test_parts_end_at_breaks():
    text = b"one two. three four, five\nsix seven eight nine ten eleven twelve"
    for most in (1, 8, 12, 30, 100):
        parts = list(parts_of(text, most))
        assert b"".join(parts) == text
        assert all(p[-1:] in b".,\n" for p in parts[:-1])
    words = words_of([b"A b", b"", b"b a"], ["en"] * 3, 1)
    assert words.keys[0] == words.keys[3] and words.keys[1] == words.keys[2]
    assert words.rows.tolist() == [0, 0, 2, 2] and words.pieces[1] != words.pieces[2]


def test_hashes_tell_lengths_and_zeros_apart():
    texts = [b"a", b"a\0", b"a\0\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"b" * 100, b"b" * 99]
    data = b"".join(texts) + b"\n" * 8
    ends = np.cumsum([len(t) for t in texts])
    sizes = np.array([len(t) for t in texts])
    made = hashed(data, ends - sizes, sizes, 0)
    assert len(set(made.tolist())) == len(texts)
    assert hashed(b"xx" + data, ends - sizes + 2, sizes, 0).tolist() == made.tolist()
    assert not set(hashed(data, ends - sizes, sizes, 1).tolist()) & set(made.tolist())


def test_fingerprints_tell_the_one_before():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 50, np.uint64)
    assert (unmixed(mixed(keys)) == keys).all() and (mixed(unmixed(keys)) == keys).all()
    two = longer(keys, keys, 2)
    three = longer(two, keys, 3)
    assert (shorter(three, keys[2:]) == two[:-1]).all() and (shorter(two, keys[1:]) == keys[:-1]).all()
