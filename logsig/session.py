"""Session-level helpers: materialised tables, bounded broadcasts, dense numbering."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
SPREAD_BYTES = 1 << 30
NUMBERING_BUCKETS = 256
DIRECT_NUMBERING = 500_000
# Positions in a bit map (as Spark makes them), and the most of them that are broadcast: 32 MB.
BITMAP_BITS = 1 << 15
BITMAPS = 8192


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared checkpoint folder.

    A folder of our own is set only for a local master, where the driver's disk
    is the executors' disk; elsewhere a missing setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="logsig-checkpoint-")
    sc.setCheckpointDir(folder)


class _Scopes(threading.local):
    """Folders given out inside the open ``temporary_tables`` scopes of a thread."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all tables that were stored inside.

    What was computed from them must be written elsewhere by then.
    """
    _scopes.open.append([])
    try:
        yield
    finally:
        for folder in _scopes.open.pop():
            delete_table(spark, folder)


def delete_table(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name on the storage all executors share."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint and survives lost executors; as a Parquet
    table it also has a known size, is read column by column, and is computed once
    however often it is used. It stays until the ``temporary_tables`` scope around it ends,
    or the folder is cleaned.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a plain table scan, the bytes of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Deal a small scan out to all cores before heavy per-row work.

    A small file is often a single row group, hence a single task. Scans beyond
    ``SPREAD_BYTES`` have splits enough and stay as they are, unshuffled.
    """
    if estimated_bytes(df) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def broadcast_if_bounded(
    df: DataFrame,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    stored: bool = False,
) -> DataFrame:
    """Hint a broadcast only after checking rows and bytes; larger sides get shuffled
    (and adaptive execution splits a hot key).

    The side is materialised first unless it is ``stored`` already, so the count
    reads file footers, the bytes are those of its files, and the join does not
    compute it again.
    """
    table = df if stored else materialize(df)
    return F.broadcast(table) if is_bounded(table, max_rows, max_bytes) else table


def is_bounded(
    table: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether a stored table may be broadcast."""
    return estimated_bytes(table) <= max_bytes and table.count() <= max_rows


def sequential_ids(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    start: int = 0,
    stored: bool = False,
    direct: int = DIRECT_NUMBERING,
) -> DataFrame:
    """Number rows ``start``, ``start + 1``, ... by ``order`` without sorting all in one task.

    Up to ``direct`` rows are simply ranked. Whole numbers that differ and lie close together,
    as the places of lines in files do, are counted in bit maps, and no row is shuffled. Others
    fall into consecutive
    buckets of the first order column, a number or a text, by its quantiles; a bucket's rows are ranked on their own and
    shifted by the sizes of the buckets before it. The rows are materialised first
    unless they are ``stored`` already, as they are needed several times; rows of a stored
    table and of files count as such.
    """
    df = df if stored else materialize(df)
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *_seen(df, order)).first()
    if seen["rows"] <= direct:
        ranked = df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        before = _positions_before(df, order[0], seen.asDict())
        ranked = _bucketed_ids(df, order, name) if before is None else _placed_ids(df, order[0], name, before)
    return ranked.withColumn(name, F.col(name).cast("bigint") + start)


def _bitmap(position: str) -> Column:
    """The bit map a position falls in; ``_bit`` is its place there."""
    return F.shiftright(position, BITMAP_BITS.bit_length() - 1)


def _bit(position: str) -> Column:
    return F.col(position).bitwiseAND(F.lit(BITMAP_BITS - 1))


def _seen(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """How many positions there are, and bit maps that hold them, if one whole number orders."""
    if len(order) > 1 or dict(df.dtypes)[order[0]] != "bigint":
        return []
    maps = F.approx_count_distinct(_bitmap(order[0]))
    return [F.count(order[0]).alias("positions"), maps.alias("maps")]


def _positions_before(df: DataFrame, lead: str, seen: dict[str, int]) -> DataFrame | None:
    """``(_map, _bits, _before)``: the positions taken, as bit maps, and how many come before each;
    None unless all are different whole numbers that few bit maps hold."""
    count = seen["rows"]
    if seen.get("positions") != count or seen["maps"] > BITMAPS:
        return None
    maps = df.groupBy(_bitmap(lead).alias("_map")).agg(F.bitmap_construct_agg(_bit(lead)).alias("_bits"))
    maps = materialize(maps.withColumn("_held", F.bitmap_count("_bits")))
    held = maps.agg(F.count(F.lit(1)).alias("maps"), F.sum("_held").alias("n")).first()
    if held["n"] < count or held["maps"] > 2 * BITMAPS:
        return None
    # One row per bit map, so this is a short sort.
    before = F.sum("_held").over(Window.orderBy("_map").rowsBetween(Window.unboundedPreceding, -1))
    return maps.select("_map", "_bits", F.coalesce(before, F.lit(0)).alias("_before"))


def _placed_ids(df: DataFrame, lead: str, name: str, before: DataFrame) -> DataFrame:
    """Rows numbered by the positions before theirs: whole maps, whole bytes, bits."""
    at = _bit(lead).cast("int")
    whole = F.shiftright(at, 3)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), whole + 1, F.lit(1))), 16, 10).cast("int")
    lower = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7))) - 1)
    place = F.col("_before") + F.bitmap_count(F.substring(F.col("_bits"), F.lit(1), whole)) + F.bit_count(lower)
    return (
        df.withColumn("_map", _bitmap(lead))
        .join(F.broadcast(before), "_map")
        .select(*df.columns, place.alias(name))
    )


def _text_number(df: DataFrame, lead: str) -> Column:
    """A number that grows with a text: the six bytes behind what all texts begin with."""
    ends = df.agg(F.min(lead), F.max(lead)).first()
    low, high = ((e or "").encode() for e in ends)
    same = os.path.commonprefix([low, high])
    after = F.hex(F.substring(F.encode(F.col(lead), "UTF-8"), len(same) + 1, 6))
    return F.conv(F.rpad(after, 12, "0"), 16, 10)


def _bucketed_ids(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    lead = order[0]
    number = F.col(lead)
    if dict(df.dtypes)[lead] == "string":
        number = _text_number(df, lead)
    df = df.withColumn("_lead", number.cast("double"))
    # First appearances crowd at the front, so the buckets follow quantiles.
    cuts = [i / NUMBERING_BUCKETS for i in range(1, NUMBERING_BUCKETS)]
    bounds = sorted(set(df.approxQuantile("_lead", cuts, 0.25 / NUMBERING_BUCKETS)))
    passed = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_lead"))
    df = df.withColumn("_bucket", F.size(passed)).drop("_lead")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    shifts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        df.join(shifts, "_bucket")
        .withColumn(name, F.col("_shift") + inside - 1)
        .drop("_bucket", "_shift")
    )
