"""Benchmark decontamination over a distributed positional inverted index.

The documents are indexed in blocks: for every term of the benchmark, the postings
(document, positions) of the block's documents, stored as a table with its document
lengths. Each window of an item is looked up by its rarest terms: their lists, shifted
by the terms' offsets, are intersected on the window's start. What is left is verified
word by word in the documents themselves, which gives exact phrases. A proximity match holds
as many different of these terms as a window asks for at shifts at most a slop apart; each
document and item gives one, that with the most terms, then the least shift.

The benchmark is worked on in blocks of bounded size, each held against all documents,
so what a task gets of it is bounded however large it is; an item longer than a block is
a block of its own.

Null and empty texts have no words; they are never hit. An item shorter than the window
is one window, an item without words none. Repeated item ids are one item with several
texts; an item without an id is looked for, but is no item that could be named or counted.
Documents are judged by their own text, also if they share an id or have none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, materialize
from .common import SLICE, spans

WINDOW = 13
#: Terms of a window whose lists are intersected.
RAREST = 3
#: Characters of benchmark text in a block.
BLOCK_CHARS = 4 << 20
#: Documents in a block of the index.
BLOCK_ROWS = 2000
#: Lookups that are broadcast; an entry is sixteen bytes.
ASKED_ROWS = 1 << 20
#: Documents with candidates are broadcast to the scan of the texts up to this size.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 4 << 20

# Fixed value: ASCII letters and digits and all else from U+0080 are word characters.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_LENGTHS = -1


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most a block, and of bounded text in their second column."""
    for batch in batches:
        for a, b in spans(batch.column(1), SLICE, BLOCK_ROWS):
            yield batch.slice(a, b - a)


class Tests:
    """Windows of a block of test items, as term numbers."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        for name, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            if ids:
                self.items.append((name, np.array(ids, np.int32)))
        self.window = window

    def windows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Item number, start and terms of each window."""
        for n, (_, ids) in enumerate(self.items):
            for start in range(max(len(ids) - self.window + 1, 1)):
                yield n, start, ids[start : start + self.window]


def test_blocks(benchmark: DataFrame, key: str, text: str, chars: int = BLOCK_CHARS):
    """The distinct items in blocks of about ``chars`` characters, one after the other."""
    items = benchmark.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // chars))
    if blocks > 1:
        items = materialize(items.withColumn("_block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks))))
    for block in range(blocks):
        part = items.filter(F.col("_block") == block) if blocks > 1 else items
        yield [(r.key, r.text) for r in part.select("key", "text").collect()]


def index(docs: DataFrame, key: str, text: str, terms: dict[bytes, int]) -> DataFrame:
    """Positional postings of the terms: ``(term, docs, positions, n)`` per block of documents,
    and under term ``-1`` the lengths of the documents in words."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shipped.value.get
        for batch in sliced(batches):
            ids, lengths, docs_of, places = [], [], [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                found = words(t)
                lengths.append(len(found))
                term = np.fromiter([get(w, -1) for w in found], np.int32, len(found))
                known = np.nonzero(term >= 0)[0]
                ids.append(term[known])
                docs_of.append(np.full(len(known), n, np.int32))
                places.append(known.astype(np.int32))
            term = np.concatenate(ids) if ids else np.array([], np.int32)
            order = np.argsort(term, kind="stable")
            keys = batch.column(0)
            cuts = np.concatenate(
                [[0], np.nonzero(np.diff(term[order]))[0] + 1, [len(order)]]
            ) if len(order) else np.array([0])
            offsets = pa.array(cuts.astype(np.int32))
            doc = keys.take(pa.array(np.concatenate(docs_of)[order])) if len(order) else keys[:0]
            place = np.concatenate(places)[order] if len(order) else np.array([], np.int32)
            heads = term[order][cuts[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array([_LENGTHS], pa.int32()), pa.array(heads, pa.int32())]),
                    pa.concat_arrays(
                        [
                            pa.ListArray.from_arrays([0, batch.num_rows], keys),
                            pa.ListArray.from_arrays(offsets, doc),
                        ]
                    ),
                    pa.concat_arrays(
                        [
                            pa.ListArray.from_arrays(
                                [0, batch.num_rows], pa.array(lengths, pa.int32())
                            ),
                            pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
                        ]
                    ),
                    pa.array(np.concatenate([[0], np.diff(cuts)]), pa.int32()),
                ],
                names=["term", "docs", "positions", "n"],
            )

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(key, text).mapInArrow(
        run, f"term int, docs array<{kind}>, positions array<int>, n int"
    )


def lookups(tests: Tests, frequency: dict[int, int], rarest: int = RAREST) -> list[tuple]:
    """``(term, item, offset, asked)``: the places of the rarest terms of all windows of an
    item, and how many of them any of its windows needs. A window with a term that occurs
    nowhere asks for nothing."""
    asked: dict[int, int] = {}
    places: set[tuple[int, int, int]] = set()
    for n, start, ids in tests.windows():
        terms = ids.tolist()
        if not all(t in frequency for t in terms):
            continue
        by_rarity = sorted(range(len(terms)), key=lambda o: (frequency[terms[o]], terms[o], o))
        chosen = by_rarity[:rarest]
        places.update((terms[o], n, start + o) for o in chosen)
        asked[n] = min(asked.get(n, len(chosen)), len(chosen))
    return [(t, n, o, asked[n]) for t, n, o in sorted(places)]


def shifted(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """``(doc, item, asked, offset, shift)``: occurrences of asked terms. ``shift`` is the position
    that the item's first word would have, negative if only a later part is held."""
    at = F.explode(F.arrays_zip("docs", "positions")).alias("p")
    return (
        postings.join(asked, "term")
        .select("item", "asked", "offset", at)
        .select(
            F.col("p.docs").alias("doc"),
            "item",
            "asked",
            "offset",
            (F.col("p.positions") - F.col("offset")).alias("shift"),
        )
    )


def placed(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """``(doc, item, shift, n)``: where a document may hold part of an item, as the lists of the
    asked terms, shifted by their offsets, meet there."""
    return (
        shifted(postings, asked)
        .groupBy("doc", "item", "asked", "shift")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= F.col("asked"))
        .drop("asked")
    )


def close_by(postings: DataFrame, asked: DataFrame, slop: int) -> DataFrame:
    """``(doc, item, n, shift)``: the most different offsets with shifts from ``shift`` to ``slop``
    above it, of documents that hold as many as asked.

    Shifts are dealt to buckets of ``slop + 1``. A stretch begins in one bucket and ends in it
    or the next, so a bucket gets its own rows and those of the next; what it holds is
    bounded by the slop and the terms of an item.
    """
    own = F.floor(F.col("shift") / (slop + 1)).cast("int")
    rows = (
        shifted(postings, asked)
        .distinct()
        .withColumn("bucket", F.explode(F.array(own, own - 1)))
        .groupBy("doc", "item", "asked", "bucket")
        .agg(F.collect_list(F.struct("shift", "offset")).alias("held"))
        .filter(F.size(F.array_distinct("held.offset")) >= F.col("asked"))
    )
    starts = F.array_distinct(F.transform("held", lambda h: h["shift"]))
    inside = lambda s: F.filter("held", lambda h: h["shift"].between(s, s + slop))
    counted = F.transform(
        F.filter(starts, lambda s: F.floor(s / (slop + 1)) == F.col("bucket")),
        lambda s: F.struct(
            F.size(F.array_distinct(F.transform(inside(s), lambda h: h["offset"]))).alias("n"),
            (-s).alias("back"),
        ),
    )
    best = rows.select("doc", "item", "asked", F.array_max(counted).alias("best"))
    return (
        best.filter(F.col("best.n") >= F.col("asked"))
        .groupBy("doc", "item")
        .agg(F.max("best").alias("best"))
        .select("doc", "item", "best.n", (-F.col("best.back")).alias("shift"))
    )


def asked_terms(spark, asked: list[tuple]) -> DataFrame:
    """The lookups of a block as a table; broadcast up to a checked number of rows."""
    table = spark.createDataFrame(asked, "term int, item int, offset int, asked int")
    return F.broadcast(table) if len(asked) <= ASKED_ROWS else table


_RANGE = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def runs(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of true of at least a length, as start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def verified(found: DataFrame, key: str, text: str, tests: Tests) -> DataFrame:
    """``(key, ranges, items)`` of documents ``(key, text, places)``: word ranges covered by an
    exact window, and the items with one."""
    shipped = found.sparkSession.sparkContext.broadcast(
        (tests.terms, [(None if n is None else str(n), ids) for n, ids in tests.items], tests.window)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, window = shipped.value
        for batch in sliced(batches):
            ranges, names = [], []
            for t, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = words(t)
                doc = np.fromiter([terms.get(w, -1) for w in found], np.int32, len(found))
                own, hit = [], set()
                for place in places:
                    name, ids = items[place["item"]]
                    a = max(place["shift"], 0)
                    b = min(place["shift"] + len(ids), len(doc))
                    if b <= a:
                        continue
                    same = doc[a:b] == ids[a - place["shift"] : b - place["shift"]]
                    for s, e in runs(same, min(window, len(ids))):
                        own.append({"start": a + s, "end": a + e})
                        if name is not None:
                            hit.add(name)
                ranges.append(own)
                names.append(sorted(hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ranges, pa.list_(_RANGE)), pa.array(names, pa.list_(pa.string()))],
                names=["doc", "ranges", "items"],
            )

    kind = dict(found.dtypes)[key]
    return found.select(key, text, "places").mapInArrow(
        run, f"doc {kind}, ranges array<struct<start int, end int>>, items array<string>"
    )


def _matches(docs, key, text, items, window, rarest):
    """Lengths of all documents, and verified matches with one block of items."""
    spark = docs.sparkSession
    tests = Tests(items, window)
    postings = materialize(index(docs, key, text, tests.terms))
    counts = postings.filter(F.col("term") >= 0).groupBy("term").agg(F.sum("n").alias("n")).collect()
    asked = lookups(tests, {r.term: r.n for r in counts}, rarest)
    places = placed(postings, asked_terms(spark, asked))
    grouped = places.groupBy("doc").agg(F.collect_list(F.struct("item", "shift")).alias("places"))
    few = broadcast_if_bounded(grouped, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = texts.join(few, F.col("_key").eqNullSafe(F.col("doc"))).select("_key", "_text", "places")
    hits = verified(found, "_key", "_text", tests).filter(F.size("ranges") > 0)
    lengths = postings.filter(F.col("term") < 0).select(
        F.explode(F.arrays_zip("docs", "positions")).alias("p")
    )
    return lengths.select(F.col("p.docs").alias("doc"), F.col("p.positions").alias("n_words")), hits


def proximity_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str,
    item_key: str,
    slop: int,
    text: str = "text",
    rarest: int = RAREST,
) -> DataFrame:
    """``(doc, item, n, shift)``: documents that hold the rarest terms of an item's windows in
    about its order and distances, ``n`` different ones at shifts of at most ``slop`` apart.
    Items that share an id are one; items without one are left out."""
    parts = []
    for items in test_blocks(benchmark, item_key, text):
        tests = Tests(items)
        postings = materialize(index(docs, key, text, tests.terms))
        counts = postings.filter(F.col("term") >= 0).groupBy("term").agg(F.sum("n").alias("n"))
        asked = lookups(tests, {r.term: r.n for r in counts.collect()}, rarest)
        named = [(n, str(name)) for n, (name, _) in enumerate(tests.items) if name is not None]
        names = docs.sparkSession.createDataFrame(named, "item int, name string")
        near = close_by(postings, asked_terms(docs.sparkSession, asked), slop).join(
            F.broadcast(names) if len(named) <= ASKED_ROWS else names, "item"
        )
        parts.append(near.select("doc", F.col("name").alias("item"), "n", "shift"))
    best = F.max(F.struct("n", (-F.col("shift")).alias("back"))).alias("best")
    return (
        functools.reduce(DataFrame.unionByName, parts)
        .groupBy("doc", "item")
        .agg(best)
        .select("doc", "item", "best.n", (-F.col("best.back")).alias("shift"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str,
    item_key: str,
    text: str = "text",
    window: int = WINDOW,
    rarest: int = RAREST,
) -> DataFrame:
    """``(key, n_words, ranges, items)`` per document row: its length in words, the word ranges
    that windows of items cover (unmerged) and the items they are of; and ``digest``, the hash
    of its text. Hits are kept by key and digest, so a row gets those of its own text."""
    row = F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("digest"))
    docs, made = docs.select(row.alias("_row"), F.col(text).alias("_words")), key
    key, text_of = "_row", "_words"
    lengths, parts = None, []
    for items in test_blocks(benchmark, item_key, text):
        # The lengths are the same whatever the block.
        lengths, hits = _matches(docs, key, text_of, items, window, rarest)
        parts.append(hits)
    hits = (
        functools.reduce(DataFrame.unionByName, parts)
        .groupBy(F.col("doc").alias("_doc"))
        .agg(
            F.flatten(F.collect_set("ranges")).alias("ranges"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
    )
    return lengths.join(hits, F.col("doc").eqNullSafe(F.col("_doc")), "left").select(
        F.col("doc.key").alias(made),
        F.col("doc.digest").alias("digest"),
        F.col("n_words").cast("bigint").alias("n_words"),
        "ranges",
        "items",
    )


def covered(ranges: str = "ranges"):
    """Number of words in the union of ranges."""
    ordered = F.array_sort(F.col(ranges))
    step = lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], s["to"]))).alias("n"),
        F.greatest(s["to"], r["end"]).alias("to"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.coalesce(F.aggregate(ordered, start, step, lambda s: s["n"]), F.lit(0)).cast("bigint")
