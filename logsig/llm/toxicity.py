"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document's probability is a noisy-or over its sentences with a leak,
``1 - (1 - leak) * prod(1 - p(sentence))``, and a sentence's is a logistic function of
the weights of its words. The weights are learned from document labels alone; sentences
at or above one half are the offending ones.

A word's weight is the sum over its features: the word and its beginnings of 3 to 9
letters. Features are chosen by how far their document odds differ between the labels.

Null and empty texts, and texts without a known feature, get the leak. With no positive
label to learn from the model is empty and the leak is the base rate. Documents with the
same id are scored one by one; a document with several label rows is toxic if any says so.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, per_text, structs

#: The model is fitted on at most about so many labelled documents of either label, drawn
#: by a hash of their id, each of at most so many characters.
SAMPLE_POSITIVE = 4000
SAMPLE_NEGATIVE = 7000
SAMPLE_CHARS = 12_000
FEATURES = 4000
#: Features are counted in so many hash buckets; the chosen buckets are then spelled out.
BUCKETS = 1 << 21
BIAS = -10.0
STEPS = 150
CACHED_WORDS = 50_000

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in range(3, min(len(word), 9) + 1))]


@dataclass
class Model:
    """Feature weights and the leak; at most ``FEATURES`` entries."""

    weights: dict[str, float] = field(default_factory=dict)
    leak: float = 0.0
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        # Most words share not even their first letters with a feature.
        self._long_heads = {f.removeprefix("=")[:4] for f in self.weights}
        self._short = {f for f in self.weights if len(f) == 3 and f[0] != "="}

    def word(self, word: str) -> float:
        weight = self._words.get(word)
        if weight is None:
            get = self.weights.get
            weight = sum(get(f, 0.0) for f in features(word))
            if len(self._words) >= CACHED_WORDS:
                self._words.clear()
            self._words[word] = weight
        return weight

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of a document, and start, end and probability of its sentences at
        or above one half."""
        low = text.lower()
        short, long_heads, word = self._short, self._long_heads, self.word
        telling = {
            w
            for w in set(WORD.findall(low))
            if (w[:4] in long_heads or w[:3] in short) and word(w) != 0.0
        }
        if not telling:
            return self.leak, []
        stays, found = math.log1p(-self.leak), []
        # Lower-casing may change lengths; spans are those of the text as given.
        for m in SENTENCE.finditer(text):
            hits = [w for w in WORD.findall(m[0].lower()) if w in telling]
            if hits:
                z = BIAS + sum(map(word, hits))
                stays -= _softplus(z)
                if z >= 0:
                    found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        return -math.expm1(stays), found


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def training_sample(
    documents: DataFrame,
    labels: DataFrame,
    learned: str | Column,
    positive: int = SAMPLE_POSITIVE,
    negative: int = SAMPLE_NEGATIVE,
    chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """``(doc_id, text, toxic)`` of a bounded number of labelled documents.

    The ids are drawn before the texts are touched, so that the join with the documents
    broadcasts a bounded side and moves no text.
    """
    rule = F.expr(learned) if isinstance(learned, str) else learned
    known = (
        labels.select("doc_id", "toxic")
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & rule)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    part = {1: positive / max(counts.get(1, 0), 1), 0: negative / max(counts.get(0, 0), 1)}
    drawn = known.filter(draw < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0]))
    return (
        documents.select("doc_id", "text")
        .filter(F.length("text").between(1, chars))
        .join(F.broadcast(drawn), "doc_id")
    )


def fit(sample: DataFrame) -> Model:
    """Fit a model on a bounded sample ``(doc_id, text, toxic)`` in one task."""
    rows = (
        sample.select("doc_id", "text", "toxic")
        .groupBy()
        .applyInPandas(_fit, "feature string, weight double")
        .collect()
    )
    weights = {r.feature: r.weight for r in rows}
    return Model(leak=weights.pop("", 0.0), weights=weights)


def _fit(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.sort_values(["doc_id", "text"])
    toxic = sample["toxic"].to_numpy(np.float64)
    vocabulary: dict[str, int] = {}
    words, sentences, owners = array("i"), array("i"), array("i")
    for doc, text in enumerate(sample["text"]):
        for sentence in SENTENCE.findall(text.lower()):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(sentence)]
            if ids:
                words.extend(ids)
                sentences.extend([len(owners)] * len(ids))
                owners.append(doc)
    rate = float(toxic.mean()) if len(toxic) else 0.0
    if not len(owners) or not 0 < rate < 1:
        return pd.DataFrame({"feature": [""], "weight": [min(max(rate, 0.0), 0.999)]})
    word, sentence, owner = (np.array(x, np.int32) for x in (words, sentences, owners))
    del words, sentences, owners
    counted = _table([[crc32(f.encode()) % BUCKETS for f in features(w)] for w in vocabulary])
    chosen = _chosen(counted, word, owner[sentence], toxic)
    names = sorted({f for w in vocabulary for f in features(w) if crc32(f.encode()) % BUCKETS in chosen})
    number = {f: i for i, f in enumerate(names)}
    table = _table([[number[f] for f in features(w) if f in number] for w in vocabulary])
    weights, leak = _noisy_or(table, len(names), word, sentence, owner, toxic)
    return pd.DataFrame({"feature": ["", *names], "weight": [leak, *weights]})


def _table(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as offsets and values."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((f for r in rows for f in r), np.int32, int(sizes.sum()))
    return np.concatenate([[0], np.cumsum(sizes)]), flat


def _pairs(table, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and places of word occurrences."""
    first, feature = table
    sizes = (first[1:] - first[:-1])[word]
    offsets = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return feature[np.repeat(first[word], sizes) + offsets], np.repeat(at, sizes)


def _chosen(table, word: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> set[int]:
    """The feature buckets whose document odds are most above those of the clean label."""
    in_toxic, in_clean = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    cuts = np.searchsorted(doc, np.arange(0, len(toxic) + 200, 200))
    for a, b in zip(cuts[:-1], cuts[1:]):
        f, d = _pairs(table, word[a:b], doc[a:b])
        both = np.unique(f.astype(np.int64) * len(toxic) + d)
        f, y = both // len(toxic), toxic[both % len(toxic)]
        for total, own in ((in_toxic, f[y > 0]), (in_clean, f[y == 0])):
            bucket, n = np.unique(own, return_counts=True)
            total[bucket] += n
    positive, negative = toxic.sum(), (1 - toxic).sum()
    often = np.flatnonzero(in_toxic >= 4)
    a, b = in_toxic[often].astype(float), in_clean[often].astype(float)
    odds = np.log((a + 0.5) / (positive + 1)) - np.log((b + 0.5) / (negative + 1))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return set(often[best[z[best] >= 3.0]].tolist())


def _noisy_or(table, n: int, word, sentence, owner, toxic) -> tuple[np.ndarray, float]:
    """Weights of the features and the leak, by gradient steps on the likelihood."""
    f, s = _pairs(table, word, sentence)
    active, s = np.unique(s, return_inverse=True)
    owner = owner[active]
    weights = np.full(n, 2.0)
    leak = 0.05
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = BIAS + np.bincount(s, weights[f], len(active))
        u = np.bincount(owner, np.logaddexp(0, z), len(toxic)) - math.log1p(-leak)
        slope = (1 - toxic) - toxic * np.exp(-u) / -np.expm1(-np.maximum(u, 1e-9))
        pull = slope[owner] * 0.5 * (1 + np.tanh(z / 2))
        gradient = np.append(
            np.bincount(f, pull[s], n) + 0.05 * weights, slope.sum() * leak
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights -= 0.15 * move[:-1]
        leak = min(max(leak * math.exp(-0.05 * move[-1]), 1e-4), 0.45)
    return weights, leak


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
_FIELDS = [("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(_SPAN))]


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score``, ``predicted`` and ``offending`` (start, end, score of sentences).

    The model is bounded by its number of features, so it is shipped with the task.
    """
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.leak))

    def work():
        weights, leak = shipped.value
        own = Model(weights, leak)

        def batch(texts: list[str]) -> pa.Array:
            rows = [own.score(t) for t in texts]
            spans = [[dict(zip(("start", "end", "score"), x)) for x in r[1]] for r in rows]
            return structs(_FIELDS, [[r[0] for r in rows], [int(r[0] >= 0.5) for r in rows], spans])

        return batch

    column = per_text(
        work,
        "score double, predicted int, offending array<struct<start int, end int, score double>>",
    )
    return computed(df, column(F.col(text)))
