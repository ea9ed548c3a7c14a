"""Phrase collocations per language: level-wise candidates, counted by double-array tries.

Words are keys of 64 bits of (language, word), found for all words of some megabyte of text at
once; that no two words of the corpus share a key is checked on the table of words, else
another multiplier is taken, so keys are as good as words. Level by level a pass over the
texts counts fingerprints of those phrases whose parts of a word less are frequent: a phrase
is never more frequent than a part of it or than its fingerprint, so what reaches the least
count is a safe set of candidates. A fingerprint is a chain of one-to-one steps, so it and
its last word tell the one before, and candidates are spelled out without another pass. What is frequent is known in the tasks as a bit
map of bounded size; set bits by chance only let more phrases into the shuffle.

The candidates are dealt to blocks of some ten thousand by their first two words, each block
becomes a double-array trie over the digits of word codes, and tries are broadcast, as many
as a fixed size holds; beyond that size another pass counts the next ones. In a pass numpy
moves the states of all positions of a slice of text at once, word by word, and counts the
accepting states; the counts of all shards are summed by Spark. These counts are exact.

Null and empty texts have no words, a null language is ``und``, repeated rows count each, and
an empty table has no phrases. Ties in score go to the larger count, then to the phrase first
in byte order. Long texts are worked on in parts that end at a break between pieces, so the
memory follows the longest piece. Other columns of the input are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsig.session import materialize

from .common import column_schema, spans
from .rolling import bit_map, firsts, hashed, longs, marked, mixed, unmixed

#: Bytes of text that are worked on at once.
SLICE = 1 << 20
#: Candidates of a trie, and bytes of the tries that are broadcast together.
BLOCK, TRIE_BYTES = 40_000, 48 << 20
#: Phrases whose counts travel together.
PART = 2048
UNKNOWN = "und"
#: What a fingerprint is multiplied by for the next word.
STEP = 0xC2B2AE3D27D4EB4F

# Bytes that end a piece, and bytes that end a word.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"

CLASSES = np.zeros(256, np.uint8)
CLASSES[list(BLANKS)] = 1
CLASSES[list(BREAKS)] = 2


@dataclass
class Words:
    """The words of a slice: where they are, their keys, pieces and texts."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    pieces: np.ndarray
    rows: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        places = zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)
        return pa.array([self.data[s:e] for s, e in places], pa.binary()).cast(pa.string())


def words_of(texts: list[bytes], languages: list[str], seed: int) -> Words:
    """Words of some texts; those of different texts are in different pieces."""
    data = b"\n".join(texts).lower() + b"\n" * 9
    kinds = CLASSES[np.frombuffer(data, np.uint8)]
    word = np.zeros(len(kinds) + 1, bool)
    np.equal(kinds, 0, out=word[1:])
    change = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = change[0::2], change[1::2]
    keys = hashed(data, starts, ends - starts, seed)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    rows = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    of_language = {g: xxhash.xxh3_64_intdigest(g) for g in set(languages)}
    own = np.array([of_language[g] for g in languages], np.uint64)
    keys = mixed(keys + own[rows]) if len(rows) else keys
    return Words(data, starts, ends, keys, np.cumsum(kinds == 2, dtype=np.int32)[starts], rows)


def parts_of(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of at most ``most`` bytes where a break between pieces allows it."""
    breaks = [BREAKS[i : i + 1] for i in range(len(BREAKS))]
    start = 0
    while len(text) - start > most:
        end = max(text.rfind(b, start, start + most) for b in breaks)
        if end < 0:
            found = [text.find(b, start + most) for b in breaks]
            end = min((f for f in found if f >= 0), default=len(text) - 1)
        yield text[start : end + 1]
        start = end + 1
    if start < len(text):
        yield text[start:]


def slices(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """Texts and languages of a batch, about ``SLICE`` bytes at a time."""
    texts, languages, held = [], [], 0
    for a, b in spans(batch.column(0), SLICE):
        chunk = batch.slice(a, b - a)
        columns = chunk.column(0).cast(pa.binary()).to_pylist(), chunk.column(1).to_pylist()
        for text, language in zip(*columns, strict=True):
            for part in parts_of(text or b"", SLICE):
                texts.append(part)
                languages.append(UNKNOWN if language is None else language)
                held += len(part)
                if held >= SLICE:
                    yield texts, languages
                    texts, languages, held = [], [], 0
    if texts:
        yield texts, languages


def each_slice(df: DataFrame, text: str, language: str, seed: int, schema: str, work: Callable) -> DataFrame:
    """Rows that ``work()``, made once per task, returns for the words of each slice; at the end
    of a task it is called with None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches:
            for texts, languages in slices(batch):
                yield from compute(words_of(texts, languages, seed), languages)
        yield from compute(None, [])

    return df.select(F.col(text), F.col(language).cast("string")).mapInArrow(run, schema)


# ---- Level one: words ----


def word_counts(df: DataFrame, text: str, language: str, seed: int) -> DataFrame:
    schema = column_schema(key="bigint", lang="string", word="string", n="bigint")

    def work():
        def compute(words: Words | None, languages: list[str]) -> Iterator[pa.RecordBatch]:
            if words is None or not len(words.keys):
                return
            first, n = firsts(words.keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(words.keys[first].view(np.int64)),
                    pa.array(languages, pa.string()).take(pa.array(words.rows[first])),
                    words.strings(first),
                    pa.array(n),
                ],
                names=["key", "lang", "word", "n"],
            )

        return compute

    made = each_slice(df, text, language, seed, schema, work)
    return made.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def distinct_keys(words: DataFrame) -> bool:
    """Whether no two words share a key."""
    return words.groupBy("key").count().filter("count > 1").isEmpty()


# ---- Candidates ----


def longer(fingerprints: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of ``size`` words from those of one word less."""
    after = keys[size - 1 :]
    return mixed(fingerprints[: len(after)] * np.uint64(STEP) + after)


def shorter(fingerprints: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of all words but the last."""
    return (unmixed(fingerprints) - last) * np.uint64(pow(STEP, -1, 1 << 64))


def frequent(words: Words, maps: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``size`` words, and which of them may be frequent: one whose
    parts of a word less are marked, and, if there is a map of this size, is marked itself."""
    fingerprints, alive = words.keys, marked(maps[0], words.keys)
    for k in range(2, size + 1):
        fingerprints = longer(fingerprints, words.keys, k)
        inside = words.pieces[k - 1 :] == words.pieces[: len(words.pieces) - k + 1]
        alive = alive[:-1][: len(fingerprints)] & alive[1:][: len(fingerprints)] & inside
        if len(maps) >= k:
            alive = alive & marked(maps[k - 1], fingerprints)
    return fingerprints, alive


def frequent_phrases(df, text, language, seed, maps, size, least) -> DataFrame:
    """Fingerprint and last word of the phrases of ``size`` words that occur ``least`` times by
    these, and the fingerprint ``before`` of all their words but the last, stored."""
    held = df.sparkSession.sparkContext.broadcast(maps)

    def work():
        def compute(words: Words | None, languages: list[str]) -> Iterator[pa.RecordBatch]:
            if words is None or len(words.keys) < size:
                return
            fingerprints, alive = frequent(words, held.value, size)
            at = np.flatnonzero(alive)
            if not len(at):
                return
            first, n = firsts(fingerprints[at])
            at = at[first]
            last = words.keys[at + size - 1]
            yield pa.RecordBatch.from_arrays(
                [longs(fingerprints[at]), longs(last), pa.array(n)], names=["fp", "last", "n"]
            )

        return compute

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, last = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, longs(shorter(fp, last))], names=["fp", "last", "before"]
            )

    made = each_slice(df, text, language, seed, "fp bigint, last bigint, n bigint", work)
    found = made.groupBy("fp", "last").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return materialize(
        found.select("fp", "last").mapInArrow(before, "fp bigint, last bigint, before bigint")
    )


# ---- Double-array tries ----


class Trie:
    """Sequences of word keys in a double array over the digits (base 256) of word codes.

    A state's children are at ``base[state] + digit`` where ``check`` names the state.
    """

    def __init__(self, vocabulary: np.ndarray, base: np.ndarray, check: np.ndarray, accept: np.ndarray):
        self.vocabulary, self.base, self.check, self.accept = vocabulary, base, check, accept

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> Trie:
        """``accept`` holds the place of the sequence that ends in a state, else -1."""
        flat = np.concatenate([*sequences, np.zeros(0, np.uint64)])
        vocabulary, codes = np.unique(flat, return_inverse=True)
        width = digits_of(len(vocabulary))
        rows = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        firsts = np.cumsum([0, *(len(s) for s in sequences)])[:-1]
        depths = (np.arange(len(flat)) - firsts[rows]) * width
        longest = max((len(s) for s in sequences), default=0) * width
        digits = np.full((len(sequences), longest), -1, np.int64)
        for i in range(width):
            digits[rows, depths + i] = (codes >> (8 * (width - 1 - i))) & 255
        self = cls(vocabulary, *(np.zeros(0, np.int32),) * 3)
        self._place(digits)
        return self

    def _place(self, digits: np.ndarray) -> None:
        size = 2 * digits.size + 4096
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        # A child is never below 257, so no base is below one.
        free = np.ones(size, bool)
        free[:257] = False
        states = np.zeros(len(digits), np.int64)
        accept = np.full(len(digits), -1, np.int64)
        for depth in range(digits.shape[1]):
            on = np.flatnonzero(digits[:, depth] >= 0)
            edges, inverse = np.unique(states[on] * 256 + digits[on, depth], return_inverse=True)
            parents, own = edges >> 8, edges & 255
            heads, first, n = np.unique(parents, return_index=True, return_counts=True)
            cursor: dict[int, int] = {}
            for i in np.argsort(-n, kind="stable")[: int((n > 1).sum())]:
                children = own[first[i] : first[i] + n[i]]
                at = cursor.get(int(n[i]).bit_length(), 257)
                while True:
                    if at + 2048 > len(free):
                        more = len(free)
                        free = np.concatenate([free, np.ones(more, bool)])
                        base = np.concatenate([base, np.zeros(more, np.int64)])
                        check = np.concatenate([check, np.full(more, -1, np.int64)])
                    starts = np.flatnonzero(free[at : at + 512]) + at - children[0]
                    starts = starts[starts > 0]
                    fit = free[starts[:, None] + children].all(axis=1)
                    if fit.any():
                        base[heads[i]] = starts[fit.argmax()]
                        break
                    at += 512
                cursor[int(n[i]).bit_length()] = at
                free[base[heads[i]] + children] = False
            single = n == 1
            slots = np.flatnonzero(free)[: int(single.sum())]
            base[heads[single]] = slots - own[first[single]]
            free[slots] = False
            children = base[parents] + own
            check[children] = parents
            states[on] = children[inverse]
            ended = on[(digits[on, depth + 1 :] < 0).all(axis=1)]
            accept[ended] = states[ended]
        used = int(states.max(initial=0)) + 1 if len(digits) else 1
        used = max(used, int(np.flatnonzero(check >= 0).max(initial=0)) + 1) + 256
        # Arrays may be shorter than the reach of the last base.
        used = max(used, int(base.max(initial=0)) + 257)
        grown = used - len(base)
        if grown > 0:
            base, check = np.pad(base, (0, grown)), np.pad(check, (0, grown), constant_values=-1)
        self.base, self.check = base[:used].astype(np.int32), check[:used].astype(np.int32)
        self.accept = np.full(used, -1, np.int32)
        self.accept[accept] = np.arange(len(accept))

    def counts(self, keys: np.ndarray, pieces: np.ndarray, at: np.ndarray, longest: int, n: int) -> np.ndarray:
        """How often each of ``n`` sequences starts at one of the positions ``at``."""
        total = np.zeros(n, np.int64)
        width = digits_of(len(self.vocabulary))
        states, start = np.zeros(len(at), np.int64), at
        for k in range(longest):
            place = start + k
            inside = place < len(keys)
            start, states, place = start[inside], states[inside], place[inside]
            inside = pieces[place] == pieces[start]
            start, states, place = start[inside], states[inside], place[inside]
            codes = np.minimum(np.searchsorted(self.vocabulary, keys[place]), len(self.vocabulary) - 1)
            known = self.vocabulary[codes] == keys[place]
            start, states, codes = start[known], states[known], codes[known]
            for i in range(width):
                moved = self.base[states] + ((codes >> (8 * (width - 1 - i))) & 255)
                known = self.check[moved] == states
                start, states, codes = start[known], moved[known], codes[known]
            ended = self.accept[states]
            total += np.bincount(ended[ended >= 0], minlength=n)
            if not len(start):
                break
        return total

    def dumps(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, vocabulary=self.vocabulary, base=self.base, check=self.check, accept=self.accept)
        return to.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Trie:
        with np.load(io.BytesIO(data)) as held:
            return cls(*(held[n] for n in ("vocabulary", "base", "check", "accept")))


def digits_of(n: int) -> int:
    return max(1, math.ceil(max(n - 1, 1).bit_length() / 8))


def tries(candidates: DataFrame, blocks: int) -> DataFrame:
    """A trie per block: ``block``, ``trie`` and the candidates' keys in the order of counts."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            flat, at = keys.values.to_numpy().view(np.uint64), keys.offsets.to_numpy()[:-1]
            block = block_of(flat[at], flat[at + 1], blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), keys], names=["block", "keys"])

    def build(key, table):
        keys = table["keys"].combine_chunks()
        flat, cuts = keys.flatten().to_numpy().view(np.uint64), np.cumsum(keys.value_lengths())
        trie = Trie.of(np.split(flat, cuts[:-1]))
        one = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "trie": pa.array([trie.dumps()], pa.binary()),
                "phrases": one,
            }
        )

    dealt = candidates.mapInArrow(placed, "block int, keys array<bigint>")
    return dealt.groupBy("block").applyInArrow(
        build, "block int, trie binary, phrases array<array<bigint>>"
    )


def block_of(first: np.ndarray, second: np.ndarray, blocks: int) -> np.ndarray:
    """The block of what begins with two words."""
    return (mixed(first * np.uint64(STEP) + second) % np.uint64(blocks)).astype(np.int32)


def trie_counts(df, text, language, seed, held: list[tuple[int, int, bytes]], blocks, longest) -> DataFrame:
    """``block``, ``part`` and ``counts``: how often each of ``PART`` consecutive phrases of a
    block's trie occurs. A shard sends one vector for them, and Spark adds vectors. Counts are
    whole numbers below 2^53 and none is negative, so their L1 norm is their exact sum (the
    sum of ``Summarizer`` is a running mean times a weight, and rounds)."""
    given = df.sparkSession.sparkContext.broadcast(held)

    def work():
        own = {b: (n, Trie.loads(data)) for b, n, data in given.value}
        totals = {b: np.zeros(-(-n // PART) * PART, np.int64) for b, (n, _) in own.items()}

        def compute(words: Words | None, languages: list[str]) -> Iterator[pa.RecordBatch]:
            if words is None:
                for b, total in totals.items():
                    parts = total.reshape(-1, PART)
                    offsets = np.arange(len(parts) + 1, dtype=np.int32) * PART
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(parts), b), pa.int32()),
                            pa.array(np.arange(len(parts)), pa.int32()),
                            pa.ListArray.from_arrays(
                                pa.array(offsets), pa.array(total.astype(float))
                            ),
                        ],
                        names=["block", "part", "counts"],
                    )
            elif len(words.keys) > 1:
                dealt = block_of(words.keys[:-1], words.keys[1:], blocks)
                order = np.argsort(dealt)
                cuts = np.searchsorted(dealt[order], np.arange(blocks + 1))
                for b, (n, trie) in own.items():
                    at = order[cuts[b] : cuts[b + 1]]
                    totals[b][:n] += trie.counts(words.keys, words.pieces, at, longest, n)

        return compute

    schema = "block int, part int, counts array<double>"
    made = each_slice(df, text, language, seed, schema, work)
    vectors = made.select("block", "part", array_to_vector("counts").alias("counts"))
    return vectors.groupBy("block", "part").agg(
        vector_to_array(Summarizer.normL1(F.col("counts"))).alias("counts")
    )


def counted(df, text, language, seed, candidates: DataFrame, longest: int) -> DataFrame:
    """``keys`` and ``a``, the exact count, of each candidate."""
    blocks = max(1, math.ceil(candidates.count() / BLOCK))
    built = materialize(tries(candidates, blocks))
    sizes = built.select("block", F.length("trie").alias("bytes")).orderBy("block").collect()
    rounds: list[list[int]] = []
    held = TRIE_BYTES
    for row in sizes:
        if held + row["bytes"] > TRIE_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(row["block"])
        held += row["bytes"]
    total = None
    for own in rounds:
        part = built.filter(F.col("block").between(own[0], own[-1]))
        rows = part.select("block", F.size("phrases"), "trie").collect()
        given = [(r[0], r[1], bytes(r[2])) for r in rows]
        counts = materialize(trie_counts(df, text, language, seed, given, blocks, longest))
        total = counts if total is None else total.unionByName(counts)
    if total is None:
        return candidates.select("keys", F.lit(0).cast("bigint").alias("a"))
    # Phrases in the same parts as their counts.
    parts = F.sequence(F.lit(0), F.floor((F.size("phrases") - 1) / PART).cast("int"))
    phrases = built.select("block", "phrases", F.explode(parts).alias("part")).select(
        "block", "part", F.slice("phrases", F.col("part") * PART + 1, F.lit(PART)).alias("phrases")
    )
    both = F.arrays_zip("phrases", F.slice("counts", F.lit(1), F.size("phrases")).alias("n"))
    return phrases.join(total, ["block", "part"]).select(F.inline(both)).select(
        F.col("phrases").alias("keys"), F.col("n").cast("bigint").alias("a")
    )


# ---- Scores ----


def collocations(
    df: DataFrame,
    text: str,
    language: str,
    least: int = 30,
    longest: int = 4,
    scale: int = 2_000_000,
    covered: int = 80,
    top: int | None = 2000,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of phrases of two to
    ``longest`` words that occur ``least`` times and are not within a longer candidate that
    has ``covered`` hundredths of their occurrences; the ``top`` ones, or all."""
    if least < 1 or longest < 2:
        raise ValueError("phrases have two or more words and occur once or more")
    for seed in range(4):
        words = materialize(word_counts(df, text, language, seed))
        if distinct_keys(words):
            break
    else:
        raise ArithmeticError("words share their keys under every seed")
    common = words.filter(F.col("n") >= least)
    maps = [bit_map(common, "key")]
    # A fingerprint and its last word tell the one before, so levels spell each other out.
    spelled = common.select(F.col("key").alias("fp"), F.array("key").alias("keys"))
    candidates = None
    for size in range(2, longest + 1):
        level = frequent_phrases(df, text, language, seed, maps, size, least)
        maps.append(bit_map(level, "fp"))
        shorter_ones = spelled.withColumnRenamed("fp", "before")
        spelled = materialize(
            level.join(shorter_ones, "before").select("fp", F.concat("keys", F.array("last")).alias("keys"))
        )
        own = spelled.select("keys")
        candidates = own if candidates is None else candidates.unionByName(own)
    candidates = materialize(candidates.distinct())
    exact = counted(df, text, language, seed, candidates, longest).filter(F.col("a") >= least)
    return ranked(materialize(exact), words, least, scale, covered, top)


def ranked(exact: DataFrame, words: DataFrame, least, scale, covered, top) -> DataFrame:
    """Scores of counted phrases by their weakest cut, without those that a longer one covers."""
    parts = words.filter(F.col("n") >= least).select(F.array("key").alias("part"), F.col("n").alias("f"))
    parts = parts.unionByName(exact.select(F.col("keys").alias("part"), F.col("a").alias("f")))
    cut, size = F.col("cut"), F.size("keys")
    cuts = exact.select("keys", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select(
        "keys",
        "a",
        "cut",
        F.slice("keys", F.lit(1), cut).alias("first"),
        F.slice("keys", cut + 1, size - cut).alias("rest"),
    )
    for name, side in (("l", "first"), ("r", "rest")):
        cuts = cuts.join(parts.select(F.col("part").alias(side), F.col("f").alias(name)), side)
    wide = "cast({} as decimal(20,0))"
    score = f"({wide.format('a')} * {scale}) div ({wide.format('l')} + {wide.format('r')})"
    weakest = (
        cuts.withColumn("score", F.expr(score).cast("bigint"))
        .groupBy("keys", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    )
    sizes = F.explode(F.sequence(F.lit(2), size)).alias("size")
    places = F.explode(F.sequence(F.lit(1), size - F.col("size") + 1)).alias("at")
    inside = (
        exact.select("keys", "a", sizes)
        .filter(F.col("size") < size)
        .select("keys", "a", "size", places)
        .groupBy(F.slice("keys", F.col("at"), F.col("size")).alias("keys"))
        .agg(F.max("a").alias("longer"))
    )
    within = f"{wide.format('longer')} * 100 >= {wide.format('a')} * {covered}"
    kept = weakest.join(inside, "keys", "left").filter(~F.coalesce(F.expr(within), F.lit(False)))
    spelled = (
        kept.select("keys", F.posexplode("keys").alias("at", "key"))
        .join(words.select("key", "lang", "word"), "key")
        .groupBy("keys")
        .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("keys", "lang", F.array_join("w.word", " ").alias("phrase"))
    )
    sums = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    placed = kept.join(spelled, "keys").withColumn("rank", F.row_number().over(order))
    if top is not None:
        placed = placed.filter(F.col("rank") <= top)
    return placed.join(sums, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score"
    )
