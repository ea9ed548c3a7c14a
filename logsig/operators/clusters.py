"""Aggregations over lines that carry a cluster label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signature_hash
from ..session import materialize
from ..sources.logs import OUTLIER

LOW_VARIATION = 0.05
UNIFORM = 0.01
# Lines that a signature shows.
SAMPLE_LINES = 2


def not_outlier(cluster: Column) -> Column:
    return cluster != OUTLIER


def pattern_uniqueness(signed: DataFrame) -> DataFrame:
    """How many patterns the lines share, with the two warning flags."""
    per_pattern = signed.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    ratio = F.col("distinct_patterns") / F.col("lines")
    return per_pattern.agg(
        F.count(F.lit(1)).alias("distinct_patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")
    ).select(
        "lines",
        "distinct_patterns",
        F.when(F.col("lines") > 0, ratio).alias("uniqueness"),
        F.coalesce(ratio < LOW_VARIATION, F.lit(False)).alias("low_variation"),
        F.coalesce(ratio < UNIFORM, F.lit(False)).alias("uniform"),
    )


def cluster_distribution(
    rows: DataFrame, cluster: str = "cluster_id", first: str | None = None
) -> DataFrame:
    """Rows per cluster by id, with the least value of a column ``first`` if asked."""
    more = [F.min(first).alias(f"first_{first}")] if first else []
    return rows.groupBy(cluster).agg(*more, F.count(F.lit(1)).alias("size")).orderBy(cluster)


def cluster_sizes(
    rows: DataFrame, cluster: str = "cluster_id", weight: str | None = None
) -> DataFrame:
    """``(cluster, size)`` as rows, for any number of clusters."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return rows.groupBy(cluster).agg(size.alias("size"))


def cluster_stats(
    rows: DataFrame,
    cluster: str = "cluster_id",
    data_type: str = "raw",
    aggression_level: str = "high",
    weight: str | None = None,
) -> DataFrame:
    """One row of training statistics; sizes are a map keyed by label, as the statistics file
    has them (``cluster_sizes`` gives them as rows).

    ``weight`` names a column of row multiplicities.
    """
    sizes = cluster_sizes(rows, cluster, weight)
    outliers = F.coalesce(F.sum(F.when(F.col(cluster) == OUTLIER, F.col("size"))), F.lit(0))
    approach = "less aggressive" if aggression_level == "preprocessed" else "aggressive"
    return sizes.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_logs"),
        F.count_if(not_outlier(F.col(cluster))).alias("num_clusters"),
        outliers.alias("num_outliers"),
        (outliers / F.sum("size") * 100).alias("outlier_percentage"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct(F.col(cluster).cast("string"), F.col("size")))
            )
        ).alias("cluster_sizes"),
        F.lit(data_type).alias("data_type"),
        F.lit(aggression_level).alias("aggression_level"),
        F.lit(approach).alias("clustering_approach"),
    )


def first_lines(
    rows: DataFrame, n: int = SAMPLE_LINES, cluster: str = "cluster_id", order: Sequence[str] = ("pos",)
) -> DataFrame:
    """The first ``n`` lines of every cluster, ranked.

    The rank filter is pushed below the shuffle (a window group limit), so a task
    sends at most ``n`` rows per cluster however large the cluster is.
    """
    by_order = Window.partitionBy(cluster).orderBy(*order)
    return (
        rows.select(cluster, *order, "raw_log")
        .withColumn("rank", F.row_number().over(by_order))
        .filter(F.col("rank") <= n)
    )


def cluster_samples(
    rows: DataFrame, n: int = SAMPLE_LINES, cluster: str = "cluster_id", order: Sequence[str] = ("pos",)
) -> DataFrame:
    """The first ``n`` lines of every cluster as an ordered list."""
    ranked = first_lines(rows, n, cluster, order)
    listed = F.array_sort(F.collect_list(F.struct("rank", "raw_log")))
    return ranked.groupBy(cluster).agg(
        F.transform(listed, lambda r: r["raw_log"]).alias("sample_logs")
    )


def earliest(order: Sequence[str]) -> Column:
    """Least position in a group; a single numeric column stays hash-aggregable."""
    if len(order) == 1:
        return F.struct(F.min(order[0]).alias(order[0]))
    return F.min(F.struct(*order))


def pattern_counts(
    rows: DataFrame, cluster: str = "cluster_id", order: Sequence[str] = ("pos",)
) -> DataFrame:
    """Rows per cluster and pattern with the pattern's first position."""
    return (
        rows.filter(not_outlier(F.col(cluster)))
        .groupBy(cluster, "pattern")
        .agg(F.count(F.lit(1)).alias("n"), earliest(order).alias("first"))
    )


def topk_patterns(counts: DataFrame, top: int = 3, cluster: str = "cluster_id") -> DataFrame:
    """The most frequent patterns per cluster; ties go to the earlier one."""
    by_rank = Window.partitionBy(cluster).orderBy(F.col("n").desc(), F.col("first"))
    return counts.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)


def cluster_signatures(
    rows: DataFrame,
    top: int = 3,
    samples: int = SAMPLE_LINES,
    cluster: str = "cluster_id",
    order: Sequence[str] = ("pos",),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Per cluster: hash, top patterns, size, first lines, order of appearance.

    The lines are aggregated once; ``counts`` saves even that where the numbers of
    ``pattern_counts`` are known already.
    """
    if counts is None:
        counts = materialize(pattern_counts(rows, cluster, order))
    listed = F.array_sort(F.collect_list(F.struct("rank", "pattern")))
    tops = (
        topk_patterns(counts, top, cluster)
        .groupBy(cluster)
        .agg(F.transform(listed, lambda r: r["pattern"]).alias("patterns"))
    )
    sizes = counts.groupBy(cluster).agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    lines = cluster_samples(rows.filter(not_outlier(F.col(cluster))), samples, cluster, order)
    return (
        tops.join(sizes, cluster)
        .join(lines, cluster)
        .select(
            cluster,
            signature_hash(F.col("patterns")).alias("signature_hash"),
            "patterns",
            "size",
            "sample_logs",
            *[F.col(f"first.{c}").alias(f"first_{c}") for c in order],
        )
    )
