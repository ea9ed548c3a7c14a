"""Language identification of mixed-language texts.

A word's scores are the log-probabilities of its letter trigrams under each language.
The script of its first letter narrows the candidates: a language takes part if its training
texts use the script. Viterbi decoding over the words, with a penalty for switching,
labels spans; a document's language is the one with the most letters in its spans.

Null texts and texts without a letter are ``und`` with score 0. Without anything to learn
from all texts are ``und``. Rows are independent; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsig.session import broadcast_if_bounded

from .common import computed, per_text, structs

#: About so many documents of each language are learned from, drawn by a hash of their id,
#: each of at most so many characters.
SAMPLE_PER_LANGUAGE = 2000
SAMPLE_CHARS = 20_000
BUCKETS = 1 << 16
#: The model is languages x buckets numbers, and goes to every task.
MOST_LANGUAGES = 512
SWITCH = 6.0
#: A script belongs to a language if at least this share of its letters is of it.
SCRIPT_SHARE = 0.01
#: Characters that are scored at once.
CHUNK = 1 << 20
UNDETERMINED = "und"

# First and last code point of scripts; other letters share number 0.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
N_SCRIPTS = len(SCRIPTS) + 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its script's number."""
    letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = n
    return letter, script


@dataclass
class Letters:
    """The letters of texts: their trigram buckets and scripts, where words and texts begin."""

    bucket: np.ndarray
    script: np.ndarray
    word_start: np.ndarray
    word_text: np.ndarray
    char_at: np.ndarray
    text_start: np.ndarray


def letters(texts: list[str]) -> Letters:
    """Letters of texts with the same number of characters in lower case or out of it."""
    is_letter, scripts = _tables()
    # A border before, between and after the texts; case folding must not shift offsets.
    low = [t if len(s := t.lower()) != len(t) else s for t in texts]
    code = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(is_letter[code])
    known = np.where(is_letter[code], code, 0).astype(np.uint64)
    mixed = (
        known[at - 1] * np.uint64(0x9E3779B97F4A7C15)
        + known[at] * np.uint64(0xC2B2AE3D27D4EB4F)
        + known[at + 1] * np.uint64(0x165667B19E3779F9)
    )
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return Letters(
        (mixed >> np.uint64(48)).astype(np.int64),
        scripts[code[at]],
        first,
        np.searchsorted(text_start, at[first] - 1, side="right") - 1,
        at - 1,
        text_start,
    )


@dataclass
class Model:
    """Trigram scores ``(bucket, language)`` and the scripts of the languages; bounded."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray
    switch: float = SWITCH

    def word_scores(self, found: Letters) -> np.ndarray:
        """Scores ``(word, language)``; languages whose script it is not are out of reach."""
        scores = np.add.reduceat(self.weights[found.bucket], found.word_start, axis=0)
        fits = self.scripts[found.script[found.word_start]]
        fits = fits | ~fits.any(axis=1)[:, None]
        return np.where(fits, scores, -1e6)

    def labels(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best language of each word by Viterbi, all texts side by side."""
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        lengths = np.diff(np.append(starts, len(text)))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        n = scores.shape[1]
        back = np.empty(scores.shape, np.int32)
        best = scores[starts].copy()
        own = np.arange(n, dtype=np.int32)
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        for step in range(1, lengths[0]):
            k = active[step]
            rows = starts[:k] + step
            before = best[:k]
            top = before.argmax(axis=1)
            high = before[np.arange(k), top] - self.switch
            stay = before >= high[:, None]
            back[rows] = np.where(stay, own, top[:, None])
            best[:k] = np.maximum(before, high[:, None]) + scores[rows]
        out = np.empty(len(text), np.int32)
        current = best.argmax(axis=1).astype(np.int32)
        for step in range(lengths[0] - 1, -1, -1):
            k = active[step]
            rows = starts[:k] + step
            out[rows] = current[:k]
            if step:
                current[:k] = back[rows, current[:k]]
        return out

    def spans(self, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
        """Language, score and spans (start, end, lang) of each text."""
        nothing = (UNDETERMINED, 0.0, [])
        found = letters(texts)
        if not len(found.word_start) or not self.languages:
            return [nothing] * len(texts)
        label = self.labels(self.word_scores(found), found.word_text)
        sizes = np.diff(np.append(found.word_start, len(found.char_at)))
        n = len(self.languages)
        share = np.bincount(
            found.word_text * n + label, weights=sizes, minlength=len(texts) * n
        ).reshape(-1, n)
        new = np.flatnonzero(
            (np.diff(found.word_text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0)
        )
        last = np.append(new[1:], len(label)) - 1
        begins = found.char_at[found.word_start[new]]
        ends = found.char_at[found.word_start[last] + sizes[last] - 1] + 1
        of = found.word_text[new]
        shift = found.text_start[of]
        spans: list[list[dict]] = [[] for _ in texts]
        for t, a, b, lang in zip(
            of.tolist(), (begins - shift).tolist(), (ends - shift).tolist(), label[new].tolist()
        ):
            spans[t].append({"start": a, "end": b, "lang": self.languages[lang]})
        total, top = share.sum(axis=1), share.argmax(axis=1)
        return [
            (self.languages[top[i]], float(share[i, top[i]] / total[i]), spans[i]) if total[i] else nothing
            for i in range(len(texts))
        ]


def chunks(texts: list[str], chars: int = CHUNK) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(
    documents: DataFrame,
    learned: str | Column,
    per_language: int = SAMPLE_PER_LANGUAGE,
    chars: int = SAMPLE_CHARS,
    switch: float = SWITCH,
) -> Model:
    """A model of a bounded sample of ``(doc_id, text, lang)`` rows for which ``learned`` holds.

    Counts are added up per language and bucket, so what comes to the driver is bounded.
    """
    rule = F.expr(learned) if isinstance(learned, str) else learned
    known = documents.select("doc_id", "text", "lang").filter(
        rule & F.col("lang").isNotNull() & F.length("text").between(1, chars)
    )
    shares = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    shares = broadcast_if_bounded(shares)
    if shares.count() > MOST_LANGUAGES:
        raise ValueError(f"at most {MOST_LANGUAGES} languages can be told apart")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(t)
            for lang, texts in by_lang.items():
                total = buckets.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for part in chunks(texts):
                    found = letters(part)
                    total[:BUCKETS] += np.bincount(found.bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(found.script, minlength=N_SCRIPTS)
        for lang, total in buckets.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                names=["lang", "bucket", "n"],
            )

    # The sample is bounded, and so is the number of tasks that count it.
    sample = known.join(shares, "lang").filter(draw < F.col("share")).select("text", "lang").repartition(8)
    counts = (
        sample.mapInArrow(count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    languages = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    place = [column[lang] for lang in counts.column("lang").to_pylist()]
    table[counts.column("bucket").to_numpy(), place] = counts.column("n").to_numpy()
    seen, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS))
    fits = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, weights.astype(np.float32), fits, switch)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
_FIELDS = [("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]


def identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (its share of the letters) and ``spans``."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def work():
        own = shipped.value

        def batch(texts: list[str]) -> pa.Array:
            rows = [r for part in chunks(texts) for r in own.spans(part)]
            return structs(_FIELDS, [[r[i] for r in rows] for i in range(3)])

        return batch

    schema = "lang_pred string, score double, spans array<struct<start int, end int, lang string>>"
    return computed(df, per_text(work, schema)(F.col(text)))
