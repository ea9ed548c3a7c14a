"""Exact repeats of long passages by fixed-block anchors.

Each document's non-overlapping blocks of ``block`` words are the index; every rolling
window of as many words, of every document, probes it. A repeat of at least
``window >= 2 * block - 1`` words contains a whole block of either document, so no repeat
is missed. Probes are looked up in a bit map of bounded size, and what may be there meets
the blocks by hash, as the least and the greatest document of each hash; a hash with two
documents is a hit.

Hits are extended to maximal repeats: windows of ``window`` words whose own blocks were all
hit are taken in stretches that share their least rolling hash, so that equal passages fall
into equal stretches wherever they stand. A stretch is known by 128 bits of its bytes;
equal ones, as in the many copies of a passage, become one with their least document.
Where one least hash has several different stretches, at the ends of repeats, their windows
are compared one by one, by 128 bits of their bytes. A window is removed if its sequence
also starts in a document with a smaller id; runs of such windows are the maximal
repeats.

No group of rows is ever held in one task: all steps are sums, minima and joins by hash, whose
hot keys are combined before they are moved, or split. What is broadcast is bounded, and
nothing that is as many as documents, hashes or ranges of them comes to the driver.

Null and empty texts have no words. Documents without an id are neither judged nor held
against others. Rows that share an id do not remove each other's words; rows that also
share the text are judged alike. Columns of any name may be there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsig.session import materialize

from .common import column_schema, spans
from .rolling import Powers, bit_map, hashed, longs, marked, mixed, place_keys

WINDOW = 50
BLOCK = 25
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


class Passages:
    """The words of some texts, the hashes of their rolling blocks, and where texts begin."""

    def __init__(self, texts: list[bytes], block: int, powers: Powers):
        own = [b" ".join(t.split()) for t in texts]
        sizes = np.array([t.count(b" ") + 1 if t else 0 for t in own], np.int64)
        self.data = b" ".join(t for t in own if t) + b" " * 8
        n = int(sizes.sum())
        cut = np.flatnonzero(np.frombuffer(self.data, np.uint8) == 32)[:n]
        self.ends = cut
        self.starts = np.concatenate([[0], cut[:-1] + 1]) if n else cut
        #: Place of each text's first word, and the number of all words.
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        words = hashed(self.data, self.starts, self.ends - self.starts, 0)
        up, down = powers.to(n + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
        last = max(n - block + 1, 0)
        self.block = block
        self.rolling = mixed((total[block : block + last] - total[:last]) * down[:last])
        #: Text of each word.
        self.text = np.repeat(np.arange(len(texts)), sizes)
        # A rolling block lies in one text if its first and last word do.
        self.inside = self.text[:last] == self.text[block - 1 : block - 1 + last]

    def aligned(self) -> np.ndarray:
        """Places of the whole blocks of the texts."""
        at = np.arange(len(self.rolling))
        return at[self.inside & ((at - self.first[self.text[: len(at)]]) % self.block == 0)]

    def windows(self, hit: np.ndarray, window: int) -> np.ndarray:
        """Places of the windows all of whose own whole blocks are ``hit`` (of their places)."""
        n = len(self.text) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        own = self.aligned()
        missed = np.zeros(len(self.text) + 1, np.int64)
        missed[own[~hit]] = 1
        before = np.concatenate([[0], np.cumsum(missed)])
        at = np.arange(n)
        at = at[self.text[:n] == self.text[window - 1 :]]
        first = self.first[self.text[at]]
        place = at - first
        low = first + -(-place // self.block) * self.block
        high = first + (place + window) // self.block * self.block - self.block
        return at[before[high + 1] == before[low]]

    def stretches(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that share the place of their least rolling block, as first window,
        number of windows and that hash."""
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none, none.astype(np.uint64)
        span = window - self.block + 1
        seen = np.lib.stride_tricks.sliding_window_view(self.rolling, span)[at]
        anchor = at + seen.argmin(axis=1)
        cut = (np.diff(anchor) != 0) | (np.diff(at) != 1)
        begin = np.concatenate([[0], np.flatnonzero(cut) + 1])
        return at[begin], np.diff(np.append(begin, len(at))), self.rolling[anchor[begin]]

    def digests(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the bytes of runs of words."""
        begin, end = self.starts[first].tolist(), self.ends[first + words - 1].tolist()
        made = b"".join(
            xxhash.xxh3_128_digest(self.data[a:b]) for a, b in zip(begin, end, strict=True)
        )
        pairs = np.frombuffer(made, "<i8").reshape(-1, 2)
        return pairs[:, 0].copy(), pairs[:, 1].copy()


def each_passages(df: DataFrame, block: int, schema: str, work) -> DataFrame:
    """Rows that ``work(passages, batch)`` returns for each slice of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(0)
        for batch in batches:
            for a, b in spans(batch.column("_text"), SLICE):
                part = batch.slice(a, b - a)
                texts = [t or b"" for t in part.column("_text").cast(pa.binary()).to_pylist()]
                yield from work(Passages(texts, block, powers), part)

    return df.mapInArrow(run, schema)


def index_blocks(docs: DataFrame, block: int) -> DataFrame:
    """The different hashes ``h`` of the documents' whole blocks, stored."""

    def work(found: Passages, _) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [longs(np.unique(found.rolling[found.aligned()]))], names=["h"]
        )

    return materialize(each_passages(docs, block, "h bigint", work).distinct())


def hit_blocks(docs: DataFrame, block: int, blocks: DataFrame) -> DataFrame:
    """The hashes of blocks that are windows of another document, stored."""
    held = docs.sparkSession.sparkContext.broadcast(bit_map(blocks, "h"))

    def work(found: Passages, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(found.inside & marked(held.value, found.rolling))
        if not len(at):
            return
        doc = batch.column("_doc").to_numpy()[found.text[at]]
        hashes = found.rolling[at]
        order = np.argsort(hashes)
        hashes, doc = hashes[order], doc[order]
        begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        yield pa.RecordBatch.from_arrays(
            [
                longs(hashes[begin]),
                longs(np.minimum.reduceat(doc, begin)),
                longs(np.maximum.reduceat(doc, begin)),
            ],
            names=["h", "least", "most"],
        )

    probes = each_passages(docs, block, "h bigint, least bigint, most bigint", work)
    met = probes.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return materialize(met.filter("least < most").join(blocks, "h", "left_semi").select("h"))


def stretches(docs: DataFrame, window: int, block: int, hits: DataFrame) -> DataFrame:
    """Stretches of windows that may repeat: document, first window, number of windows, least
    hash, digest and a number for their place in the corpus, stored."""
    held = docs.sparkSession.sparkContext.broadcast(bit_map(hits, "h"))

    def work(found: Passages, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = marked(held.value, found.rolling[found.aligned()])
        first, n, anchor = found.stretches(found.windows(hit, window), window)
        rows = found.text[first]
        place = first - found.first[rows]
        key = place_keys(batch.column("_key").to_numpy()[rows], place)
        own = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_doc").take(own),
                batch.column("_digest").take(own),
                pa.array(place.astype(np.int32)),
                pa.array(n.astype(np.int32)),
                longs(anchor),
                longs(key),
                *map(longs, found.digests(first, n + window - 1)),
            ],
            names=["_doc", "_digest", "place", "n", "a", "key", "c1", "c2"],
        )

    schema = column_schema(
        _doc="bigint", _digest="bigint", place="int", n="int",
        a="bigint", key="bigint", c1="bigint", c2="bigint",
    )
    return materialize(each_passages(docs, block, schema, work))


def window_digests(docs: DataFrame, window: int, block: int, hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows of the ``wanted`` stretches: digest of the stretch, offset in it and digest of
    the window, stored."""
    spark = docs.sparkSession.sparkContext
    held = spark.broadcast((bit_map(hits, "h"), bit_map(wanted, "key")))

    def work(found: Passages, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = marked(held.value[0], found.rolling[found.aligned()])
        first, n, _ = found.stretches(found.windows(hit, window), window)
        rows = found.text[first]
        keys = place_keys(batch.column("_key").to_numpy()[rows], first - found.first[rows])
        at = marked(held.value[1], keys)
        first, n = first[at], n[at]
        c1, c2 = found.digests(first, n + window - 1)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(first, n) + offset
        w1, w2 = found.digests(start, np.full(len(start), window))
        yield pa.RecordBatch.from_arrays(
            [
                longs(np.repeat(c1, n)),
                longs(np.repeat(c2, n)),
                pa.array(offset.astype(np.int32)),
                longs(w1),
                longs(w2),
            ],
            names=["c1", "c2", "offset", "w1", "w2"],
        )

    schema = "c1 bigint, c2 bigint, offset int, w1 bigint, w2 bigint"
    rows = each_passages(docs, block, schema, work)
    return materialize(rows.join(wanted.select("c1", "c2"), ["c1", "c2"], "left_semi").distinct())


def removed_spans(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``_doc``, ``_digest`` and ``_spans`` (begin and end in words) of the documents that hold
    windows that also start in a document with a smaller id."""
    hits = hit_blocks(docs, block, index_blocks(docs, block))
    standing = stretches(docs, window, block, hits)
    different = materialize(
        standing.groupBy("c1", "c2").agg(
            F.min("_doc").alias("least"), F.first("a").alias("a"), F.min("key").alias("key")
        )
    )
    several = different.groupBy("a").agg(F.count(F.lit(1)).alias("of")).filter("of > 1")
    mixed_up = materialize(different.join(several, "a", "left_semi").select("c1", "c2", "key", "least"))
    windows = window_digests(docs, window, block, hits, mixed_up)
    of_window = (
        windows.join(mixed_up.select("c1", "c2", "least"), ["c1", "c2"])
        .groupBy("w1", "w2")
        .agg(F.min("least").alias("least"))
    )
    each = windows.join(of_window, ["w1", "w2"]).select("c1", "c2", "offset", "least")
    by_window = each.groupBy("c1", "c2").agg(
        F.collect_list(F.struct("offset", F.col("least").alias("first"))).alias("windows")
    )
    known = materialize(
        different.select("c1", "c2", "least").join(by_window, ["c1", "c2"], "left")
    )
    begin = F.col("place")
    later = F.transform(
        F.filter("windows", lambda w: w["first"] < F.col("_doc")),
        lambda w: F.struct((begin + w["offset"]).alias("begin"), (begin + w["offset"] + window).alias("end")),
    )
    whole = F.array(F.struct(begin.alias("begin"), (begin + F.col("n") + (window - 1)).alias("end")))
    return (
        standing.join(known, ["c1", "c2"])
        .filter("least < _doc or windows is not null")
        .select("_doc", "_digest", F.when(F.col("windows").isNull(), whole).otherwise(later).alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("_doc", "_digest")
        .agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    )


REMOVED = column_schema(n_words="bigint", n_removed="bigint", kept="string", kept_sha256="string")


def kept_words(text: bytes, found: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those that no span covers."""
    own = text.split()
    if not found:
        return len(own), own
    cover = np.zeros(len(own) + 1, np.int64)
    begin, end = np.array(found).T
    np.add.at(cover, begin, 1)
    np.add.at(cover, end, -1)
    return len(own), [own[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]


def without_repeats(
    df: DataFrame,
    key: str,
    text: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
    keep: bool = True,
) -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``kept`` (unless ``keep`` is false) and
    ``kept_sha256``; they replace columns of these names. ``key`` is a whole number."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    docs = df.select(
        F.col(key).cast("bigint").alias("_doc"),
        F.xxhash64(text).alias("_digest"),
        F.xxhash64(key, text).alias("_key"),
        F.col(text).alias("_text"),
    ).filter("_doc is not null and _text is not null")
    found = removed_spans(docs, window, block).select(
        F.col("_doc").alias("_of"), F.col("_digest").alias("_hash"), "_spans"
    )
    fields = [f for f in REMOVED.split(", ") if keep or f != "kept string"]
    names = [f.split()[0] for f in fields]

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ': ') for f in fields)}>")
    def remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, runs in batches:
            for a, b in spans(texts, SLICE):
                rows = []
                chunk = texts.slice(a, b - a).cast(pa.binary()).to_pylist()
                for value, own in zip(chunk, runs.slice(a, b - a).to_pylist(), strict=True):
                    n, left = kept_words(value or b"", [(s["begin"], s["end"]) for s in own or ()])
                    kept = b" ".join(left)
                    row = [n, n - len(left), kept, hashlib.sha256(kept).hexdigest()]
                    rows.append(row if keep else row[:2] + row[3:])
                kinds = [pa.int64()] * 2 + [pa.string()] * (1 + keep)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)]
                yield pa.StructArray.from_arrays(columns, names=names)

    rows = df.select(F.struct("*").alias("_row")).select(
        "_row", F.col(f"_row.`{key}`").cast("bigint").alias("_k"), F.col(f"_row.`{text}`").alias("_t")
    )
    same = (F.col("_k") == F.col("_of")) & (F.xxhash64("_t") == F.col("_hash"))
    made = rows.join(found, same, "left").select(
        "_row", remove.asNondeterministic()(F.col("_t"), F.col("_spans")).alias("_made")
    )
    others = [c for c in df.columns if c not in names]
    return made.select(*[F.col(f"_row.`{c}`") for c in others], *[f"_made.{n}" for n in names])


def deduplicated(
    df: DataFrame, key: str, text: str = "text", window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """``(key, n_words, n_removed, kept_sha256)`` per row of ``df``."""
    own = df.select(F.col(key), F.col(text).alias("_words"))
    return without_repeats(own, key, "_words", window, block, keep=False).drop("_words")
