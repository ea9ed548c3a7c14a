"""Repeated byte strings by a family of suffix arrays of logarithmic size.

Every string of ``length`` bytes has an anchor: of its grams of half that length the one whose
hash is least, the leftmost of equals. Equal strings have equal anchors at the same place, so
strings need to meet only under their anchor. Neighbouring strings that share an anchor are
one context, a stretch of at most one and a half lengths; equal contexts are kept once,
with their number. Only anchors that occur again matter: hashes are counted first,
and what repeats is known in the tasks as a bit map of bounded size (a bit set by chance only
brings a context more).

Contexts that share their anchor with others are dealt by it to buckets of about a thousand. In a bucket they arrive in
batches: a batch gets its suffix array (the starts of its strings, sorted by the bytes that
follow), is merge-scanned against the levels that exist, and strings found on either side are
marked on both; what is new becomes a level, and two levels of one rank merge into one of the
next. All strings are compared as bytes. An anchor with very many different contexts, as
the border of a passage that a third of all documents quote, is dealt to several buckets;
there each bucket returns a 128-bit digest of each of its different strings, and Spark
sums these over the buckets.

What is repeated in a context holds for each place where the context occurs, and spans go back
to their documents by id and digest of the text. Null and empty texts, and texts shorter
than ``length``, have no strings. A null id is an id like others; rows that repeat id and
text repeat each other's strings and both lose them. An empty table gives no rows. Columns of
any name may be there; results replace those of the same name. Long texts are worked on in
overlapping parts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsig.session import materialize

from .common import column_schema, spans
from .rolling import Powers, bit_map, longs, marked, mixed, place_keys

LENGTH = 200
#: Bytes of text that are worked on at once; a place in them fits the low bits of a key.
SLICE, PLACE_BITS = 1 << 20, 22
#: Contexts of a bucket; an anchor with more different ones is dealt to several buckets.
BUCKET = 1000
#: Contexts of a batch that gets a suffix array of its own.
BATCH = 256
#: Bytes of contexts that a task works through, bucket after bucket.
TASK_BYTES = 8 << 20


# ---- Anchors and contexts ----


class Contexts:
    """The contexts of some parts of texts: where they start, their strings, anchors, digests."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int, powers: Powers):
        data = b"".join(p for _, _, p in parts)
        self.data, self.length = data, length
        gram, n = length // 2, len(data)
        empty = np.zeros(0, np.int64)
        self.rows = self.starts = self.places = self.sizes = empty
        self.anchors = empty.astype(np.uint64)
        if n < length:
            return
        codes = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        up, down = powers.to(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up)])
        hashes = mixed((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        # Least over length - gram + 1 grams, by doubling.
        span, want = 1, length - gram + 1
        while 2 * span <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < want:
            least = np.minimum(least[: len(least) - want + span], least[want - span :])
        anchor = (least & low).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in parts])
        begins = np.cumsum(sizes) - sizes
        own = np.searchsorted(begins, np.arange(len(anchor)), "right") - 1
        inside = np.flatnonzero(np.arange(len(anchor)) + length <= (begins + sizes)[own])
        if not len(inside):
            return
        change = (np.diff(anchor[inside]) != 0) | (np.diff(own[inside]) != 0)
        first = np.concatenate([[0], np.flatnonzero(change) + 1])
        self.starts = inside[first]
        self.sizes = np.diff(np.append(first, len(inside)))
        self.anchors = hashes[anchor[self.starts]]
        part = own[self.starts]
        self.rows = np.array([r for r, _, _ in parts])[part]
        self.places = np.array([a for _, a, _ in parts])[part] + self.starts - begins[part]

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i] + self.length - 1]

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = b"".join(xxhash.xxh3_128_digest(self.text(i)) for i in at)
        pairs = np.frombuffer(made, "<i8").reshape(-1, 2)
        return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def parts_of(row: int, text: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Overlapping parts of a text that together hold each of its strings once."""
    for start in range(0, max(len(text) - length + 1, 0), SLICE):
        yield row, start, text[start : start + SLICE + length - 1]


def each_contexts(df: DataFrame, text: str, length: int, schema: str, work) -> DataFrame:
    """Rows that ``work(contexts, batch)`` returns for the contexts of each slice; the batch has
    the columns of ``df`` but the text."""
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in batches:
            texts, others = batch.column(text), batch.select(rest)
            for a, b in spans(texts, SLICE):
                parts = []
                for row, value in enumerate(texts.slice(a, b - a).cast(pa.binary()).to_pylist(), a):
                    for part in parts_of(row, value or b"", length):
                        parts.append(part)
                        if sum(len(p) for _, _, p in parts) >= SLICE:
                            yield from work(Contexts(parts, length, powers), others)
                            parts = []
                if parts:
                    yield from work(Contexts(parts, length, powers), others)

    return df.mapInArrow(run, schema)


def repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of the anchors of two or more contexts."""

    def work(found: Contexts, _) -> Iterator[pa.RecordBatch]:
        values, n = np.unique(found.anchors, return_counts=True)
        yield pa.RecordBatch.from_arrays([longs(values), longs(n)], names=["a", "n"])

    made = each_contexts(docs.select("_text"), "_text", length, "a bigint, n bigint", work)
    return made.groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").select("a")


def occurrences(docs: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """Contexts of marked anchors in the documents: id, digest of the text, place of the first
    string, number of strings, hash of the place in the corpus, anchor and digest."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def work(found: Contexts, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(marked(held.value, found.anchors))
        rows, places = found.rows[at], found.places[at]
        keys = place_keys(batch.column("_key").to_numpy()[rows], places)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id").take(pa.array(rows)),
                batch.column("_digest").take(pa.array(rows)),
                longs(places),
                longs(found.sizes[at]),
                longs(keys),
                longs(found.anchors[at]),
                *map(pa.array, found.digests(at)),
            ],
            names=["_id", "_digest", "place", "size", "key", "a", "c1", "c2"],
        )

    schema = column_schema(
        _id=docs.schema["_id"].dataType.simpleString(),
        _digest="bigint", place="bigint", size="bigint", key="bigint",
        a="bigint", c1="bigint", c2="bigint",
    )
    return each_contexts(docs, "_text", length, schema, work)


def context_texts(docs: DataFrame, length: int, bits: np.ndarray) -> DataFrame:
    """Bytes of the contexts whose place in the corpus, as a hash, is marked."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def work(found: Contexts, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = place_keys(batch.column("_key").to_numpy()[found.rows], found.places)
        at = np.flatnonzero(marked(held.value, keys))
        c1, c2 = found.digests(at)
        yield pa.RecordBatch.from_arrays(
            [longs(c1), longs(c2), pa.array([found.text(i) for i in at], pa.binary())],
            names=["c1", "c2", "bytes"],
        )

    schema = "c1 bigint, c2 bigint, bytes binary"
    return each_contexts(docs.select("_key", "_text"), "_text", length, schema, work)


# ---- The family of suffix arrays ----


class Level:
    """Different strings in order, how often each is held, and who holds one that is held once."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, who: np.ndarray, rank: int = 0):
        self.keys, self.weights, self.who, self.rank = keys, weights, who, rank

    def merged(self, other: Level) -> Level:
        """Both levels, which share no string, as one of the next rank."""
        at = np.searchsorted(self.keys, other.keys)
        return Level(
            np.insert(self.keys, at, other.keys),
            np.insert(self.weights, at, other.weights),
            np.insert(self.who, at, other.who),
            max(self.rank, other.rank) + 1,
        )


class Family:
    """Suffix arrays of the batches so far, on levels whose sizes grow geometrically."""

    def __init__(self, length: int):
        self.length, self.levels = length, []
        self.marks = np.zeros(0, bool)
        self.sizes: list[np.ndarray] = []

    def add(self, texts: list[bytes], weights: np.ndarray) -> None:
        """Contexts with the number of places where each occurs. Equal strings within the batch,
        and between the batch and the levels, are marked."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        sizes = np.diff(np.concatenate([[0], ends])) - self.length + 1
        starts = np.concatenate([np.arange(e - self.length + 1 - n, e - self.length + 1) for e, n in zip(ends, sizes)])
        keys = data[starts[:, None] + np.arange(self.length)].view(f"S{self.length}").ravel()
        base = len(self.marks)
        self.sizes.append(sizes)
        self.marks = np.concatenate([self.marks, np.zeros(len(keys), bool)])
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        own = np.add.reduceat(np.repeat(weights, sizes)[order], first)
        often = own[np.cumsum(new) - 1] > 1
        self.marks[base + order[often]] = True
        who = np.where(own == 1, base + order[first], -1)
        batch = Level(keys[first], own, who)
        for level in self.levels:
            batch = self._scan(level, batch)
        if len(batch.keys):
            self.levels.append(batch)
            while len(self.levels) > 1 and self.levels[-1].rank >= self.levels[-2].rank:
                last = self.levels.pop()
                self.levels.append(self.levels.pop().merged(last))

    def _scan(self, level: Level, batch: Level) -> Level:
        """Mark what both hold, add it to the level, and return the batch without it."""
        at = np.minimum(np.searchsorted(level.keys, batch.keys), len(level.keys) - 1)
        same = level.keys[at] == batch.keys
        for who in (level.who[at[same]], batch.who[same]):
            self.marks[who[who >= 0]] = True
        level.weights[at[same]] += batch.weights[same]
        level.who[at[same]] = -1
        return Level(batch.keys[~same], batch.weights[~same], batch.who[~same])

    def ranges(self) -> Iterator[tuple[int, int, int]]:
        """Context, first and last but one of each run of marked strings."""
        sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        begins = np.cumsum(sizes) - sizes
        at = np.flatnonzero(self.marks)
        if len(at):
            cut = (np.diff(at) != 1) | (np.diff(owner[at]) != 0)
            first = np.concatenate([[0], np.flatnonzero(cut) + 1])
            last = np.concatenate([np.flatnonzero(cut), [len(at) - 1]])
            own = owner[at[first]]
            yield from zip(own, at[first] - begins[own], at[last] + 1 - begins[own], strict=True)

    def strings(self) -> Iterator[tuple[bytes, int, int, int]]:
        """Digest, number, and context and place (or -1) of each different string."""
        sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)])
        ends = np.cumsum(sizes)
        for level in self.levels:
            raw = level.keys.view(np.uint8).reshape(-1, self.length)
            owner = np.searchsorted(ends, level.who, "right")
            for key, n, who, own in zip(raw, level.weights.tolist(), level.who.tolist(), owner.tolist()):
                place = who - (ends[own] - sizes[own]) if who >= 0 else -1
                yield xxhash.xxh3_128_digest(key.tobytes()), n, own if who >= 0 else -1, int(place)


FOUND = column_schema(
    c1="bigint", c2="bigint", begin="bigint", end="bigint", w1="bigint", w2="bigint", n="bigint"
)


def found_in_buckets(rows: DataFrame, length: int) -> DataFrame:
    """Per context runs of repeated strings (``begin``, ``end``); from split buckets also digests
    of different strings (``w1``, ``w2``, ``n``), with context and place if held once."""

    def result(family: Family, held: list, split: bool) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        made = [(*held[i], a, b, None, None, None) for i, a, b in family.ranges()]
        if split:
            for digest, n, own, place in family.strings():
                w = np.frombuffer(digest, "<i8").tolist()
                who = (*held[own], place, place + 1) if own >= 0 else (None,) * 4
                made.append((*who, *w, n))
        for a in range(0, len(made), 20_000):
            columns = zip(*made[a : a + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, family, held, split = None, None, [], False
        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if family is not None and ids[a] != bucket:
                    yield from result(family, held, split)
                    family = None
                if family is None:
                    family, held, bucket = Family(length), [], ids[a]
                    split = batch.column("split")[a].as_py()
                for i in range(a, b, BATCH):
                    part = batch.slice(i, min(BATCH, b - i))
                    held += zip(*(part.column(c).to_pylist() for c in ("c1", "c2")))
                    family.add(part.column("bytes").to_pylist(), part.column("n").to_numpy())
        if family is not None:
            yield from result(family, held, split)

    return rows.mapInArrow(run, FOUND)


def repeated_runs(contexts: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``c1``, ``c2``, ``begin`` and ``end``: runs of strings of a context that occur again.

    ``contexts`` is a stored table of different contexts (``a``, ``of``, the number of contexts
    under this anchor, ``c1``, ``c2``, ``n``, ``size``), ``texts`` has their ``bytes``.
    """
    shape = contexts.agg(F.count(F.lit(1)), F.sum(F.col("size") + length - 1)).first()
    buckets = max(1, math.ceil(shape[0] / BUCKET))
    split = F.col("of") > BUCKET
    salt = F.pmod("c1", F.ceil(F.col("of") / BUCKET))
    bucket = F.when(split, F.xxhash64("a", salt)).otherwise(F.pmod("a", F.lit(buckets)))
    dealt = contexts.select("c1", "c2", "n", bucket.alias("bucket"), split.alias("split"))
    least = contexts.sparkSession.sparkContext.defaultParallelism
    rows = (
        dealt.join(texts, ["c1", "c2"])
        .repartition(max(least, math.ceil((shape[1] or 0) / TASK_BYTES)), "bucket")
        .sortWithinPartitions("bucket")
    )
    found = materialize(found_in_buckets(rows, length))
    strings = found.filter("w1 is not null")
    again = strings.groupBy("w1", "w2").agg(F.sum("n").alias("total")).filter("total > 1")
    elsewhere = strings.filter("c1 is not null").join(again, ["w1", "w2"], "left_semi")
    names = ["c1", "c2", "begin", "end"]
    return found.filter("w1 is null").select(*names).unionByName(elsewhere.select(*names))


# ---- Documents ----


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``_id``, ``_digest`` and ``_spans`` (begin and end in bytes) of the documents that hold
    strings of ``length`` bytes that start elsewhere too.

    ``docs`` has ``_id``, ``_digest`` and ``_key`` (hashes of the text, and of id and text), ``_text``.
    """
    bits = bit_map(materialize(repeated_anchors(docs, length)), "a")
    occurring = materialize(occurrences(docs, length, bits))
    # The text of a context is taken from the place with the least hash.
    different = materialize(
        occurring.groupBy("c1", "c2").agg(
            F.count(F.lit(1)).alias("n"),
            F.first("a").alias("a"),
            F.first("size").alias("size"),
            F.min("key").alias("key"),
        )
    )
    of_anchor = different.groupBy("a").agg(F.count(F.lit(1)).alias("of"))
    # A context that is alone under its anchor can only equal itself: it repeats as often as
    # it occurs, and there is nothing to compare it with.
    told = materialize(different.join(of_anchor, "a"))
    lone = told.filter("of = 1 and n > 1").select(
        "c1", "c2", F.lit(0).cast("bigint").alias("begin"), F.col("size").alias("end")
    )
    several = told.filter("of > 1")
    texts = context_texts(docs, length, bit_map(several, "key")).dropDuplicates(["c1", "c2"])
    runs = materialize(lone.unionByName(repeated_runs(several, texts, length)))
    span = F.struct(
        (F.col("place") + F.col("begin")).alias("begin"),
        (F.col("place") + F.col("end") + (length - 1)).alias("end"),
    )
    return (
        occurring.join(runs, ["c1", "c2"])
        .groupBy("_id", "_digest")
        .agg(F.collect_list(span).alias("_spans"))
    )


REMOVED = column_schema(
    n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept="binary", kept_sha256="string"
)


def kept_bytes(text: bytes, found: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What spans of a text leave, and the number of maximal runs that they cover."""
    kept, at, runs, last = [], 0, 0, -1
    for begin, end in sorted(found):
        if begin > last:
            runs += 1
            kept.append(text[at:begin])
        at = last = max(last, end)
    kept.append(text[at:])
    return b"".join(kept), runs


def without_repeats(
    df: DataFrame, key: str, text: str = "text", length: int = LENGTH, keep: bool = True
) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (bytes, unless ``keep`` is
    false) and ``kept_sha256``: each text without the bytes of strings that start elsewhere."""
    if length < 2 or 3 * length > SLICE:
        raise ValueError(f"strings have 2 to {SLICE // 3} bytes")
    marked_rows = df.select(
        F.col(key).alias("_id"),
        F.xxhash64(text).alias("_digest"),
        F.xxhash64(key, text).alias("_key"),
        F.col(text).alias("_text"),
    )
    found = repeated_spans(marked_rows, length).select(
        F.col("_id").alias("_of"), F.col("_digest").alias("_hash"), "_spans"
    )
    fields = [f for f in REMOVED.split(", ") if keep or not f.startswith("kept binary")]
    names = [f.split()[0] for f in fields]

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ': ') for f in fields)}>")
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans_of in batches:
            for a, b in spans(texts, SLICE):
                rows = []
                chunk = texts.slice(a, b - a).cast(pa.binary()).to_pylist()
                for value, own in zip(chunk, spans_of.slice(a, b - a).to_pylist(), strict=True):
                    value = value or b""
                    kept, runs = kept_bytes(value, [(s["begin"], s["end"]) for s in own or ()])
                    digest = hashlib.sha256(kept).hexdigest()
                    row = [len(value), len(value) - len(kept), runs, kept, digest]
                    rows.append(row if keep else row[:3] + row[4:])
                kinds = [pa.int64()] * 3 + [pa.binary()] * keep + [pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]
                yield pa.StructArray.from_arrays(columns, names=names)

    joined = df.select(F.struct("*").alias("_row")).select(
        "_row", F.col(f"_row.`{key}`").alias("_k"), F.col(f"_row.`{text}`").alias("_t")
    )
    same = F.col("_k").eqNullSafe(F.col("_of")) & (F.xxhash64("_t") == F.col("_hash"))
    made = joined.join(found, same, "left").select(
        "_row", remove.asNondeterministic()(F.col("_t"), F.col("_spans")).alias("_made")
    )
    others = [c for c in df.columns if c not in names]
    return made.select(*[F.col(f"_row.`{c}`") for c in others], *[f"_made.{n}" for n in names])
