"""A clustered log that knows its patterns and where their lines are.

Lines carry the id of their pattern (its md5) instead of its text. Beside them lie, one part
per append: a dictionary of the patterns of each cluster, the number of lines of each
pattern in each range of positions, and a sketch of the different patterns. A needle is
looked for in the dictionary alone; lines are picked by id, which files answer by their
dictionaries and bloom filters; how many lines match, and in which ranges a page lies, is
a sum over the counts, so a deep page opens the files that hold it. An append reads
nothing of what is there but counts.

An append that failed before its counts were written is not read, and the next one takes
its place. Appends must not run at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract_fields, join_fields, select_fields_unified, shallow_reconstruct
from ..session import broadcast_if_bounded, materialize
from ..sources.logs import FILE_SPAN, _existing
from .clusters import LOW_VARIATION, UNIFORM
from .query import page_of_total, validate_page

#: Positions of a range whose lines are counted together.
RANGE = 1 << 24
#: Sums that reach the driver at once while a page is located.
SEEK_RANGES = 4096
#: Binary logarithm of a sketch's buckets, and its relative error at three deviations.
SKETCH_BITS = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


@dataclass(frozen=True)
class IndexedLog:
    """``lines`` (cluster, pos, raw_log, pattern_id, ...), ``patterns`` (cluster, pattern_id,
    pattern, n), ``counts`` (cluster, pattern_id, range, n) and ``sketches`` (lines, sketch)."""

    lines: DataFrame
    patterns: DataFrame
    counts: DataFrame
    sketches: DataFrame


def pattern_id(pattern: Column) -> Column:
    return F.md5(pattern)


def append_indexed(clustered: DataFrame, path: str, stored: bool = False) -> None:
    """Append ``(pos, raw_log, pattern, cluster, ...)`` lines behind what is there.

    They are read twice, so they are materialised first unless they are ``stored`` already."""
    spark = clustered.sparkSession
    clustered = clustered if stored else materialize(clustered)
    number, start = _next_append(spark, path)
    own = lambda part: f"{path}/{part}/append={number}"
    dictionary = clustered.groupBy("cluster", "pattern").agg(F.count(F.lit(1)).alias("n"))
    dictionary = dictionary.withColumn("pattern_id", pattern_id(F.col("pattern")))
    dictionary.write.mode("overwrite").parquet(own("patterns"))
    lines = clustered.withColumn("pattern_id", pattern_id(F.col("pattern"))).withColumn(
        "pos", F.col("pos") + start
    )
    (
        lines.drop("pattern")
        .hint("rebalance", "cluster")
        .sortWithinPartitions("cluster", "pos")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#pattern_id", "true")
        .partitionBy("cluster")
        .parquet(own("lines"))
    )
    stored = spark.read.parquet(own("patterns"))
    stored.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        F.hll_sketch_agg("pattern", SKETCH_BITS).alias("sketch"),
    ).write.mode("overwrite").parquet(own("sketches"))
    # Last: from here on the append is there.
    at = F.floor(F.col("pos") / RANGE).cast("bigint").alias("range")
    counted = spark.read.schema(lines.drop("pattern").schema).parquet(own("lines"))
    counted.groupBy("cluster", "pattern_id", at).agg(F.count(F.lit(1)).alias("n")).write.mode(
        "overwrite"
    ).parquet(own("counts"))


def _next_append(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number of the next append, and its first position."""
    counts = _existing(spark, f"{path}/counts")
    if counts is None:
        return 0, 0
    last = counts.agg(F.max("append"), F.max("range")).first()
    if last[0] is None:
        return 0, 0
    end = 0 if last[1] is None else (last[1] + 1) * RANGE
    return last[0] + 1, -(-end // FILE_SPAN) * FILE_SPAN


def read_indexed(spark: SparkSession, path: str) -> IndexedLog:
    complete = F.col("append") < _next_append(spark, path)[0]
    return IndexedLog(
        *[
            spark.read.parquet(f"{path}/{part}").filter(complete)
            for part in ("lines", "patterns", "counts", "sketches")
        ]
    )


def matching_patterns(log: IndexedLog, cluster: int, needle: str) -> DataFrame:
    """Ids of a cluster's patterns that hold the text, ignoring case."""
    found = log.patterns.filter(
        (F.col("cluster") == cluster)
        & F.contains(F.lower(F.col("pattern")), F.lit(needle.lower()))
    )
    return broadcast_if_bounded(found.select("pattern_id").distinct())


def matching_lines(log: IndexedLog, cluster: int, needle: str) -> DataFrame:
    """Lines of a cluster whose pattern holds the text; no pattern text of a line is read."""
    ids = matching_patterns(log, cluster, needle)
    return log.lines.filter(F.col("cluster") == cluster).join(ids, "pattern_id", "left_semi")


def match_counts(log: IndexedLog, cluster: int, needle: str) -> DataFrame:
    """``(range, n)`` of the matching lines, stored."""
    ids = matching_patterns(log, cluster, needle)
    own = log.counts.filter(F.col("cluster") == cluster).join(ids, "pattern_id", "left_semi")
    return materialize(own.groupBy("range").agg(F.sum("n").alias("n")))


def _range_of(sizes: DataFrame, nth: int) -> tuple[int, int]:
    """The range that holds a match by its number from zero, and the matches before that range."""
    low, high = sizes.agg(F.min("range"), F.max("range") + 1).first()
    before = 0
    while True:
        width = (high - low - 1) // SEEK_RANGES + 1
        inside = sizes.filter((F.col("range") >= low) & (F.col("range") < high))
        step = F.floor((F.col("range") - low) / width).cast("bigint").alias("step")
        for number, n in sorted(inside.groupBy(step).agg(F.sum("n")).collect()):
            if before + n > nth:
                low, high = low + number * width, min(high, low + (number + 1) * width)
                break
            before += n
        if width == 1:
            return low, before


def indexed_page(log: IndexedLog, cluster: int, needle: str, limit: int, offset: int = 0):
    """The lines of a page with their pattern, and its metadata, as ``log_query`` has them."""
    validate_page(limit, offset)
    sizes = match_counts(log, cluster, needle)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_matches"))
    held = total.first()[0]
    lines = matching_lines(log, cluster, needle).select("pos", "raw_log", "pattern_id")
    if offset >= held:
        lines = lines.filter(F.lit(False))
    else:
        first, before = _range_of(sizes, offset)
        last, _ = _range_of(sizes, min(offset + limit, held) - 1)
        inside = (F.col("pos") >= first * RANGE) & (F.col("pos") < (last + 1) * RANGE)
        lines = lines.filter(inside).orderBy("pos").offset(offset - before).limit(limit)
    # A page is as many rows as the limit allows. It is stored before the join, as what is
    # ordered below a join would pass for ordered above it.
    found = F.broadcast(materialize(lines))
    texts = log.patterns.filter(F.col("cluster") == cluster).select("pattern_id", "pattern")
    page = texts.distinct().join(found, "pattern_id").orderBy("pos")
    return page, page_of_total(total, limit, offset)


def indexed_query(
    log: IndexedLog, cluster: int, needle: str, limit: int, offset: int = 0, shallow: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``log_query`` over an indexed log."""
    lines, meta = indexed_page(log, cluster, needle, limit, offset)
    raw = F.col("raw_log")
    text = shallow_reconstruct(raw, F.col("pattern")) if shallow else raw
    return lines.select("pos", text.alias("text")), meta.select(
        "*",
        F.lit(cluster).alias("cluster_id"),
        F.lit(needle).alias("pattern_filter"),
        F.lit(shallow).alias("shallow_mode"),
    )


def indexed_filter(
    log: IndexedLog,
    cluster: int,
    needle: str,
    indices: Sequence[int] = (),
    limit: int = 100,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """``log_filter`` over an indexed log."""
    validate_page(limit, offset, indices)
    lines, meta = indexed_page(log, cluster, needle, limit, offset)
    text = join_fields(select_fields_unified(extract_fields(F.col("raw_log"), F.col("pattern")), indices))
    return lines.select("pos", text.alias("text")), meta.select(
        "*",
        F.lit(cluster).alias("cluster_id"),
        F.lit(needle).alias("pattern_filter"),
        F.array(*[F.lit(i) for i in indices]).cast("array<int>").alias("field_indices"),
    )


def uniqueness_estimate(log: IndexedLog, low: float = LOW_VARIATION, uniform: float = UNIFORM) -> DataFrame:
    """``pattern_uniqueness`` from the appends' sketches, with the relative error that the number
    of patterns rarely exceeds; no line and no pattern is read."""
    merged = log.sketches.agg(
        F.sum("lines").alias("lines"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_patterns"),
    )
    ratio = F.col("distinct_patterns") / F.col("lines")
    return merged.select(
        "lines",
        "distinct_patterns",
        F.when(F.col("lines") > 0, ratio).alias("uniqueness"),
        F.coalesce(ratio < low, F.lit(False)).alias("low_variation"),
        F.coalesce(ratio < uniform, F.lit(False)).alias("uniform"),
        F.lit(SKETCH_ERROR).alias("error"),
    )
