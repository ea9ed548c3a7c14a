"""Vectors for patterns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 256
Featurizer = Callable[[DataFrame], DataFrame]


def pattern_words(pattern: Column) -> Column:
    return F.when(pattern == "", F.array().cast("array<string>")).otherwise(F.split(pattern, " "))


def pattern_terms(words: Column) -> Column:
    """A pattern's tokens and its pairs of neighbouring tokens."""
    pairs = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w, i: F.concat(F.get(words, i), F.lit(" "), w),
    )
    return F.concat(words, pairs)


def symbol_features(patterns: DataFrame, size: int = FEATURES) -> DataFrame:
    """Add ``vec``: unit-length frequencies of the pattern's tokens and token pairs, by bucket.

    A term's bucket is the first 32 bits of its md5 modulo ``size``, which any system can
    repeat. The empty pattern gets the zero vector.
    """

    def bucket(term: str) -> int:
        return int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % size

    @F.arrow_udf("array<double>")
    def unit(batch: pa.Array) -> pa.Array:
        # A batch has few different terms, so each is hashed once.
        coded = batch.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(batch)), batch.value_lengths().to_numpy())
        within = np.flatnonzero(owner[1:] == owner[:-1])
        both = codes[within].astype(np.int64) * len(names) + codes[within + 1]
        pairs, at = np.unique(both, return_inverse=True)
        of_pair = [
            bucket(f"{names[p // len(names)]} {names[p % len(names)]}") for p in pairs.tolist()
        ]
        of_word = np.array([bucket(n) for n in names], np.int64)
        place = np.concatenate(
            [
                owner * size + of_word[codes],
                owner[within] * size + np.array(of_pair, np.int64)[at],
            ]
        )
        counts = np.bincount(place, minlength=len(batch) * size).astype(float).reshape(-1, size)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        counts /= np.where(norms > 0, norms, 1.0)
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * size
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))

    return patterns.withColumn("vec", unit(pattern_words(F.col("pattern"))))


def term_frequencies(patterns: DataFrame) -> DataFrame:
    """The same frequencies in long form: ``(pattern, term, tf)``."""
    terms = pattern_terms(pattern_words(F.col("pattern")))
    return (
        patterns.select("pattern")
        .distinct()
        .select("pattern", F.explode(terms).alias("term"))
        .groupBy("pattern", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def features(patterns: DataFrame, featurizer: Featurizer | None = None) -> DataFrame:
    """Vectors for distinct patterns, by the default or the caller's featurizer.

    A featurizer maps ``(pattern, ...)`` to the same rows with ``vec``; a sentence
    model fits in as an iterator ``pandas_udf`` that loads once per worker.
    """
    return (featurizer or symbol_features)(patterns)
