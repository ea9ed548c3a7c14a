"""Stable ids: clusters keep their number across data sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text_preview
from ..session import DIRECT_NUMBERING, broadcast_if_bounded, materialize, sequential_ids
from ..sources.logs import OUTLIER

PREVIEW_LENGTH = 150
NO_SAMPLE = "No sample available"


def _first_columns(signatures: DataFrame) -> list[str]:
    return [c for c in signatures.columns if c.startswith("first_")]


def stable_ids(
    signatures: DataFrame,
    cluster: str = "cluster_id",
    stored: bool = False,
    direct: int = DIRECT_NUMBERING,
) -> DataFrame:
    """Number the clusters 0, 1, 2, ... by their first appearance."""
    order = _first_columns(signatures)
    keys = signatures.select(cluster, *order)
    numbered = sequential_ids(keys, order, "stable_id", stored=stored, direct=direct)
    return numbered.select(cluster, "stable_id")


def build_registry(signatures: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """The registry of a training run, with each cluster's temporary label."""
    signatures = materialize(signatures)
    return signatures.join(stable_ids(signatures, cluster, stored=True), cluster).select(
        "stable_id",
        "signature_hash",
        "patterns",
        F.col("size").alias("training_size"),
        F.lit(None).cast("bigint").alias("inference_size"),
        "sample_logs",
        F.lit(None).cast("boolean").alias("is_new_pattern"),
        cluster,
    )


def next_stable_id(registry: DataFrame) -> int:
    """The id the next new cluster gets."""
    return registry.agg(F.coalesce(F.max("stable_id"), F.lit(-1)) + 1).first()[0]


def map_signatures(
    signatures: DataFrame,
    registry: DataFrame,
    cluster: str = "cluster_id",
    next_id: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Give new clusters the stable id of a known signature, or a new one.

    New ids start at ``next_id``, the one a stored registry names, but never at one in use.

    Returns ``(cluster, stable_id, is_new_pattern)`` and the extended registry.
    Clusters sharing an unknown hash share the id the first of them gets.
    """
    mapping, added = new_signatures(signatures, registry, cluster, next_id)
    return mapping, registry.select(*added.columns).unionByName(added)


def new_signatures(
    signatures: DataFrame,
    registry: DataFrame,
    cluster: str = "cluster_id",
    next_id: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mapping of ``map_signatures``, and the rows the registry gets.

    Of the registry, a table, only hashes and ids are read, once; it is not copied.
    """
    order = _first_columns(signatures)
    signatures = materialize(signatures)
    known = materialize(
        registry.groupBy("signature_hash").agg(F.max("stable_id").alias("known_id"))
    )
    matched = signatures.join(known, "signature_hash", "left")
    info = F.struct("patterns", "size", "sample_logs")
    unseen = (
        matched.filter(F.col("known_id").isNull())
        .groupBy("signature_hash")
        .agg(
            F.min(F.struct(*order)).alias("first"), F.min_by(info, F.struct(*order)).alias("info")
        )
        .select("signature_hash", *[F.col(f"first.{c}").alias(c) for c in order], "info.*")
    )
    last = known.agg(F.coalesce(F.max("known_id"), F.lit(-1))).first()[0]
    start = max(next_id or 0, last + 1)
    numbered = sequential_ids(unseen, order, "new_id", start)
    mapping = matched.join(numbered.select("signature_hash", "new_id"), "signature_hash", "left")
    added = numbered.select(
        F.col("new_id").alias("stable_id"),
        "signature_hash",
        "patterns",
        F.lit(0).cast("bigint").alias("training_size"),
        F.col("size").alias("inference_size"),
        "sample_logs",
        F.lit(True).alias("is_new_pattern"),
    )
    return (
        mapping.select(
            cluster,
            F.coalesce("known_id", "new_id").alias("stable_id"),
            F.col("known_id").isNull().alias("is_new_pattern"),
        ),
        added,
    )


def apply_mapping(rows: DataFrame, mapping: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Add ``stable_id``: outliers stay outliers, unmapped labels get null."""
    ids = broadcast_if_bounded(mapping.select(cluster, F.col("stable_id").alias("_mapped")))
    return (
        rows.join(ids, cluster, "left")
        .withColumn(
            "stable_id",
            F.when(F.col(cluster) == OUTLIER, F.lit(OUTLIER)).otherwise(F.col("_mapped")),
        )
        .drop("_mapped")
    )


def registry_summary(registry: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """One row of totals over the registry."""
    fresh = F.coalesce(F.col("is_new_pattern"), F.lit(False))
    totals = registry.agg(
        F.count(F.lit(1)).alias("total_stable_ids"),
        F.count_if(F.col("is_new_pattern").isNull()).alias("training_clusters"),
        F.count_if(fresh).alias("new_patterns_discovered"),
        (F.coalesce(F.max("stable_id"), F.lit(-1)) + 1).alias("next_available_id"),
    )
    present = centroids is not None and not centroids.isEmpty()
    return totals.withColumns(
        {"has_centroids": F.lit(present), "distance_based_enabled": F.lit(present)}
    )


def log_schema(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What can be queried: one row per cluster, and one row of totals."""
    first_line = F.get("sample_logs", F.lit(0))
    clusters = registry.select(
        F.col("stable_id").alias("cluster"),
        F.col("patterns").alias("pattern_signatures"),
        F.coalesce("training_size", F.lit(0)).alias("training_size"),
        F.coalesce(text_preview(first_line, PREVIEW_LENGTH), F.lit(NO_SAMPLE)).alias(
            "sample_preview"
        ),
    )
    totals = registry.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.coalesce(F.sum("training_size"), F.lit(0)).alias("total_training_logs"),
        (F.coalesce(F.max("stable_id"), F.lit(-1)) + 1).alias("next_available_id"),
        F.lit("1.0").alias("schema_version"),
    )
    return clusters, totals


__all__: Sequence[str] = [
    "apply_mapping",
    "build_registry",
    "log_schema",
    "map_signatures",
    "next_stable_id",
    "registry_summary",
    "stable_ids",
]
