"""Querying the clustered-log table: filter, page, reconstruct, extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract_fields, join_fields, select_fields_unified, shallow_reconstruct

MAX_LIMIT = 1000
DEFAULT_LIMIT = 100
# Rows a page may skip by a plain top-n; deeper pages are located by counting.
DIRECT_OFFSET = 20_000
SEEK_RANGES = 4096


# What is said about page arguments.
LIMIT_TOO_SMALL = "Limit must be greater than 0"
OFFSET_NEGATIVE = "Offset must be non-negative"
LIMIT_TOO_LARGE = f"Limit cannot exceed {MAX_LIMIT} to prevent performance issues"
INDEX_NEGATIVE = "All field indices must be non-negative"


def validate_page(limit: int, offset: int = 0, indices: Sequence[int] = ()) -> None:
    if limit <= 0:
        raise ValueError(LIMIT_TOO_SMALL)
    if offset < 0:
        raise ValueError(OFFSET_NEGATIVE)
    if limit > MAX_LIMIT:
        raise ValueError(LIMIT_TOO_LARGE)
    if any(i < 0 for i in indices):
        raise ValueError(INDEX_NEGATIVE)


def page_problem(limit: Column, offset: Column) -> Column:
    """What ``validate_page`` says about arguments kept in a table; null if nothing."""
    return (
        F.when(limit <= 0, LIMIT_TOO_SMALL)
        .when(offset < 0, OFFSET_NEGATIVE)
        .when(limit > MAX_LIMIT, LIMIT_TOO_LARGE)
    )


def filter_cluster_pattern(clustered: DataFrame, cluster: int, needle: str) -> DataFrame:
    """Rows of a cluster whose pattern holds the text, ignoring case."""
    return clustered.filter(
        (F.col("cluster") == cluster)
        & F.contains(F.lower(F.col("pattern")), F.lit(needle.lower()))
    )


def _seek(
    rows: DataFrame, offset: int, direct_offset: int, ranges: int
) -> tuple[DataFrame, int]:
    """Narrow ``rows`` to where a deep page starts, and what is left to skip.

    Counts rows per range of positions (at most ``ranges`` numbers reach the
    driver) and repeats inside the range that holds the offset.
    """
    if offset <= direct_offset:
        return rows, offset
    low, high = rows.agg(F.min("pos"), F.max("pos") + 1).first()
    while low is not None and offset > direct_offset and high - low > 1:
        width = (high - low - 1) // ranges + 1
        inside = rows.filter((F.col("pos") >= low) & (F.col("pos") < high))
        sizes = (
            inside.groupBy(F.floor((F.col("pos") - low) / width).cast("bigint").alias("range"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for number, count in sorted(sizes):
            if count > offset:
                low, high = low + number * width, min(high, low + (number + 1) * width)
                break
            offset -= count
        else:
            return rows.filter(F.lit(False)), 0
    return rows.filter(F.col("pos") >= low) if low is not None else rows, offset


def page(
    rows: DataFrame,
    limit: int,
    offset: int = 0,
    direct_offset: int = DIRECT_OFFSET,
    ranges: int = SEEK_RANGES,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in line order."""
    validate_page(limit, offset)
    rows, skip = _seek(rows, offset, direct_offset, ranges)
    return rows.orderBy("pos").offset(skip).limit(limit)


def page_meta(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row describing a page of ``rows``."""
    return page_of_total(rows.agg(F.count(F.lit(1)).alias("total_matches")), limit, offset)


def page_of_total(counted: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row describing a page of as many rows as the only row of ``counted`` says."""
    total = F.col("total_matches")
    left = F.greatest(total - offset, F.lit(0))
    return counted.select(
        F.lit(offset).cast("bigint").alias("current_offset"),
        F.least(left, F.lit(limit)).cast("bigint").alias("returned_count"),
        F.lit(limit).cast("bigint").alias("requested_limit"),
        (F.lit(offset + limit) >= total).alias("isEnd"),
        "total_matches",
    )


def log_query(
    clustered: DataFrame,
    cluster: int,
    needle: str,
    limit: int,
    offset: int = 0,
    shallow: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """A page of a cluster's lines, raw or reconstructed, with its metadata."""
    validate_page(limit, offset)
    matches = filter_cluster_pattern(clustered, cluster, needle)
    lines = page(matches.select("pos", "raw_log", "pattern"), limit, offset)
    raw, pattern = F.col("raw_log"), F.col("pattern")
    text = shallow_reconstruct(raw, pattern) if shallow else raw
    meta = page_meta(matches, limit, offset).select(
        "*",
        F.lit(cluster).alias("cluster_id"),
        F.lit(needle).alias("pattern_filter"),
        F.lit(shallow).alias("shallow_mode"),
    )
    return lines.select("pos", text.alias("text")), meta


def log_filter(
    clustered: DataFrame,
    cluster: int,
    needle: str,
    indices: Sequence[int] = (),
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Chosen fields of a page of lines, tab-separated, with its metadata.

    Only the page's own lines are taken apart. Without indices every line of
    the page comes out empty.
    """
    validate_page(limit, offset, indices)
    matches = filter_cluster_pattern(clustered, cluster, needle)
    lines = page(matches.select("pos", "raw_log", "pattern"), limit, offset)
    fields = extract_fields(F.col("raw_log"), F.col("pattern"))
    text = join_fields(select_fields_unified(fields, indices))
    meta = page_meta(matches, limit, offset).select(
        "*",
        F.lit(cluster).alias("cluster_id"),
        F.lit(needle).alias("pattern_filter"),
        F.array(*[F.lit(i) for i in indices]).cast("array<int>").alias("field_indices"),
    )
    return lines.select("pos", text.alias("text")), meta
