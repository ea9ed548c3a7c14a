"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

Each fingerprint's 64 bits form 32 segments of two; a segment's bit count is written in
unary (00, 01, 11), so the Manhattan distance of two count vectors is the number of
differing unary bits, and it never exceeds the bit distance. The segments are dealt to
``max_distance // 2 + 1`` bands: if the vectors are within ``max_distance``, some band is
within one. So a fingerprint lives in one grid cell per band and also visits the cells
one count up; each pair in reach meets in a cell, is held against the Manhattan bound
and then verified on the bits themselves.

A cell does not emit its pairs. It emits edges from the parts it finds connected, at
most one per visitor, and components are joined over all cells. Equal fingerprints are
one vertex. Cells with more than ``CELL_ROWS`` residents and visitors are cut into blocks, and a task
compares two blocks.

Texts without a word have fingerprint zero and are linked like any other. Null ids have
a fingerprint and get their group's smallest id (null if the group has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.density import connected_components
from ..session import materialize
from .common import per_text

SEED = 42
CELL_ROWS = 4096
#: Pairs held in memory before they are reduced to edges.
PAIRS = 1 << 20

_ODD = 0x5555555555555555
# Bits of each byte value, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())],
            np.uint64,
            len(starts),
        )
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    value = 0
    for place in range(8):
        counts = np.bincount(octets[:, place], minlength=256) @ _BITS
        for bit in np.nonzero(2 * counts > len(hashes))[0]:
            value |= 1 << (8 * place + int(bit))
    return value


def fingerprint_column(shingle: int = 3):
    """A column function from texts to fingerprints, as signed 64-bit numbers."""

    def work():
        def batch(texts: list[str]) -> pa.Array:
            values = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            return pa.StructArray.from_arrays([pa.array(values.view(np.int64))], names=["fp"])

        return batch

    return per_text(work, "fp bigint")


def unary(prints: np.ndarray) -> np.ndarray:
    """Segment bit counts in unary."""
    odd = np.uint64(_ODD)
    high = (prints >> np.uint64(1)) & odd
    return ((prints & odd) | high) | ((prints & odd & high) << np.uint64(1))


def band_masks(max_distance: int) -> list[int]:
    """Segments dealt evenly to the bands, as bit masks."""
    bands = max_distance // 2 + 1
    cuts = [32 * i // bands for i in range(bands + 1)]
    return [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(cuts, cuts[1:])]


def _places(max_distance: int):
    """Cells of fingerprints: ``(band, cell, guest, fp)``, residents and visitors."""
    masks = band_masks(max_distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            counts = unary(prints)
            for band, mask in enumerate(masks):
                cells, who = [counts & np.uint64(mask)], [prints]
                for segment in range(32):
                    if not mask >> 2 * segment & 1:
                        continue
                    low, high = np.uint64(1 << 2 * segment), np.uint64(2 << 2 * segment)
                    up = (counts & high) == 0
                    step = np.where((counts[up] & low) == 0, low, high)
                    cells.append((counts[up] & np.uint64(mask)) | step)
                    who.append(prints[up])
                n = len(prints)
                cell, fp = np.concatenate(cells), np.concatenate(who)
                for a in range(0, len(cell), 1 << 18):
                    part = slice(a, a + (1 << 18))
                    guest = np.arange(a, a + len(cell[part])) >= n
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(guest), band, np.int32)),
                            pa.array(cell[part].view(np.int64)),
                            pa.array(guest),
                            pa.array(fp[part].view(np.int64)),
                        ],
                        names=["band", "cell", "guest", "fp"],
                    )

    return run


def _split_cells(places: DataFrame) -> DataFrame:
    """``places`` with ``pair``: a cell with many rows is dealt to blocks. A resident meets the
    residents of every block and all visitors; residents and visitors of a cell with ``r``
    and ``v`` blocks meet in the ``r x v`` pairs of theirs, so no group has more than a
    block of each, however many visitors a cell has. A cell without residents links nothing."""
    mine = F.sum(F.when(~F.col("guest"), 1).otherwise(0))
    sizes = places.groupBy("band", "cell").agg(mine.alias("own"), F.count(F.lit(1)).alias("rows"))
    sizes = sizes.filter(F.col("rows") > CELL_ROWS).select(
        "band",
        "cell",
        F.ceil(F.col("own") / CELL_ROWS).cast("bigint").alias("residents"),
        F.greatest(F.ceil((F.col("rows") - F.col("own")) / CELL_ROWS), F.lit(1)).cast("bigint").alias("visitors"),
    )
    r, v = F.col("residents"), F.col("visitors")
    block = F.pmod(F.xxhash64("fp"), F.when(F.col("guest"), v).otherwise(r))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # Pairs of residents come first, then, behind ``r * r``, pairs with blocks of visitors.
    home = F.transform(every(r), lambda o: F.least(F.col("block"), o) * r + F.greatest(F.col("block"), o))
    abroad = F.transform(every(v), lambda o: r * r + F.col("block") * v + o)
    guest = F.transform(every(r), lambda o: r * r + o * v + F.col("block"))
    meets = F.when(F.col("guest"), guest).otherwise(F.concat(home, abroad))
    alone = (r == 1) & (v == 1)
    return (
        places.join(sizes, ["band", "cell"], "left")
        .withColumn("residents", F.coalesce("residents", F.lit(1)))
        .withColumn("visitors", F.coalesce("visitors", F.lit(1)))
        .filter("residents > 0")
        .withColumn("block", block)
        .withColumn("pairs", F.when(alone, F.array(F.lit(0).cast("bigint"))).otherwise(meets))
        .select("band", "cell", "guest", "fp", F.explode("pairs").alias("pair"))
    )


def spanning(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect exactly what the given edges connect."""
    names, flat = np.unique(np.concatenate([source, target]), return_inverse=True)
    a, b = flat[: len(source)], flat[len(source) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.nonzero(label != np.arange(len(names)))[0]
    return names[label[moved]], names[moved]


def _links(max_distance: int):
    """Edges within cells, of rows sorted by cell with the residents first.

    Cells are compared all at once: step ``d`` holds row ``i`` against row ``i + d`` where
    both are of one cell and ``i`` is a resident.
    """

    def compare(cell: np.ndarray, guest: np.ndarray, prints: np.ndarray):
        start = np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)])
        group = np.cumsum(start) - 1
        end = np.append(np.nonzero(start)[0], len(cell))[1:][group]
        counts = unary(prints)
        at, left, right, held = np.nonzero(~guest)[0], [], [], 0
        step = 1
        at = at[at + step < end[at]]
        while len(at):
            other = at + step
            near = np.bitwise_count(counts[at] ^ counts[other]) <= max_distance
            a, b = at[near], other[near]
            sure = np.bitwise_count(prints[a] ^ prints[b]) <= max_distance
            a, b = a[sure], b[sure]
            left.append(prints[a])
            right.append(prints[b])
            held += len(a)
            if held > PAIRS:
                l, r = spanning(np.concatenate(left), np.concatenate(right))
                left, right, held = [l], [r], 0
            step += 1
            at = at[at + step < end[at]]
        if not left:
            return np.array([], np.uint64), np.array([], np.uint64)
        return spanning(np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.stack(
                    [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], 1
                )
                guest = batch.column(3).to_numpy(zero_copy_only=False)
                prints = batch.column(4).to_numpy().view(np.uint64)
                if rest is not None:
                    keys = np.concatenate([rest[0], keys])
                    guest = np.concatenate([rest[1], guest])
                    prints = np.concatenate([rest[2], prints])
                # The last cell may go on in the next batch.
                same = (keys != keys[-1]).any(axis=1)
                cut = int(np.nonzero(same)[0][-1]) + 1 if same.any() else 0
                rest = (keys[cut:], guest[cut:], prints[cut:])
                keys, guest, prints = keys[:cut], guest[:cut], prints[:cut]
            elif rest is not None:
                keys, guest, prints = rest
            else:
                continue
            if len(keys):
                a, b = compare(keys, guest, prints)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"]
                )

    return run


def _with_end(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def links(prints: DataFrame, max_distance: int) -> DataFrame:
    """``(src, dst)`` edges that connect what bit distances of at most ``max_distance``
    connect, of distinct fingerprints ``fp``."""
    places = prints.select("fp").mapInArrow(
        _places(max_distance), "band int, cell bigint, guest boolean, fp bigint"
    )
    keys = ["band", "cell", "pair"]
    return (
        _split_cells(places)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "guest", "fp")
        .select(*keys, "guest", "fp")
        .mapInArrow(_links(max_distance), "src bigint, dst bigint")
    )


def _groups(prints: DataFrame, key: str, max_distance: int) -> DataFrame:
    """``(fp, _part, _low)`` of stored prints: each fingerprint's group, named by one of its
    fingerprints, and the fingerprint's smallest key."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("_low")))
    edges = materialize(links(distinct, max_distance).distinct())
    touched = edges.select("src").union(edges.select("dst")).distinct()
    parts = connected_components(touched.withColumnRenamed("src", "site"), edges)
    return distinct.join(parts.withColumnRenamed("site", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("_part"), "_low"
    )


def near_duplicates(
    df: DataFrame, key: str, text: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """``(key, fp, component_id)`` per row: the fingerprint and the smallest key reachable."""
    made = fingerprint_column(shingle)(F.col(text))
    prints = materialize(df.select(F.col(key), made.alias("_made")).select(key, "_made.fp"))
    placed = _groups(prints, key, max_distance)
    lowest = placed.groupBy("_part").agg(F.min("_low").alias("component_id"))
    by_print = placed.select("fp", "_part").join(lowest, "_part").select("fp", "component_id")
    return prints.join(by_print, "fp").select(key, "fp", "component_id")


def representatives(
    df: DataFrame, key: str, text: str = "text", shingle: int = 3, max_distance: int = 3
) -> DataFrame:
    """The rows of ``df`` that stay: one row per group, that of its smallest key, and of the
    least digest of the text among rows of that key.

    Rows that repeat key and text are copies, one of them stays. A key that leads several groups
    keeps a row in each. A row with a null key stays if its group has no other key."""
    made = fingerprint_column(shingle)(F.col(text))
    prints = materialize(
        df.select(F.col(key), F.xxhash64(F.col(text)).alias("_digest"), made.alias("_made")).select(
            key, "_digest", "_made.fp"
        )
    )
    parts = _groups(prints, key, max_distance).select("fp", "_part")
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_digest").alias("digest"))
    # Reduced by fingerprint first, so a group of very many copies is few rows in the join.
    first = prints.groupBy("fp").agg(F.min(row).alias("_row"))
    stays = (
        first.join(parts, "fp")
        .groupBy("_part")
        .agg(F.min("_row").alias("_row"))
        .select(F.col("_row.key").alias("_stays"), F.col("_row.digest").alias("_text_digest"))
    )
    digest = F.xxhash64(F.col(text))
    rows = df.select(F.struct("*").alias("_whole"), F.col(key).alias("_key"), digest.alias("_digest"))
    met = F.col("_key").eqNullSafe(F.col("_stays")) & (F.col("_digest") == F.col("_text_digest"))
    one = Window.partitionBy("_key", "_digest").orderBy("_digest")
    return (
        rows.join(stays, met, "left_semi")
        .withColumn("_row", F.row_number().over(one))
        .filter("_row = 1")
        .select("_whole.*")
    )
