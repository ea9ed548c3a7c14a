"""Training: lines in, labels and a model out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clusters import (
    SAMPLE_LINES,
    UNIFORM,
    cluster_signatures,
    cluster_stats,
    earliest,
    not_outlier,
)
from ..operators.density import Density, density_cluster, density_parameters
from ..operators.features import Featurizer, features
from ..operators.registry import build_registry
from ..operators.vectors import SAMPLES_PER_CLUSTER, cluster_geometry
from ..session import broadcast_if_bounded, materialize, sequential_ids, spread
from ..sources.logs import OUTLIER, annotate
from ..sources.model import Model, REGISTRY_SCHEMA, Thresholds

TRAINING_PRESET = "moderate"


@dataclass(frozen=True)
class Training:
    lines: DataFrame
    stats: DataFrame
    model: Model


def pattern_table(signed: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Distinct patterns with their number of lines and order of appearance.

    All later steps work on this table; the copies of a pattern are combined
    before the shuffle.
    """
    counted = signed.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("weight"), earliest(order).alias("_first")
    )
    spread = counted.select(
        "pattern", "weight", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order]
    )
    return sequential_ids(spread, [f"first_{c}" for c in order], "point_id")


def label_patterns(
    patterns: DataFrame,
    parameters: Density,
    featurizer: Featurizer | None = None,
    uniform: bool = False,
) -> DataFrame:
    """``(pattern, point_id, weight, vec, cluster_id)`` per distinct pattern.

    With ``uniform``, nearly uniform data is one cluster by definition. The share of distinct
    patterns falls as a log grows, so that is a choice of the caller.
    """
    # A featurizer may be dear: it sees each pattern once.
    vectors = materialize(features(spread(patterns), featurizer))
    if uniform and _nearly_uniform(patterns):
        return vectors.withColumn("cluster_id", F.lit(0).cast("bigint"))
    labels = density_cluster(vectors.select("point_id", "vec", "weight"), parameters)
    return vectors.join(labels.select("point_id", "cluster_id"), "point_id")


def _nearly_uniform(patterns: DataFrame) -> bool:
    totals = patterns.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("lines")).first()
    return totals["n"] < UNIFORM * (totals["lines"] or 0)


def label_lines(signed: DataFrame, labels: DataFrame, stored: bool = False) -> DataFrame:
    """Lines with their pattern's label; few patterns are broadcast, many joined."""
    ids = broadcast_if_bounded(labels.select("pattern", "cluster_id"), stored=stored)
    return signed.join(ids, "pattern")


def sample_lines(
    raw_lines: DataFrame,
    placed: DataFrame,
    labels: DataFrame,
    order: Sequence[str] = ("pos",),
    n: int = SAMPLE_LINES,
) -> DataFrame:
    """The lines that stand where the first ``n`` lines of a cluster do, signed and labelled.

    ``placed`` has the place and pattern of every line, stored. The places are found there, so
    of the lines themselves only those few are signed.
    """
    found = label_lines(placed, labels.filter(not_outlier(F.col("cluster_id"))))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    first = found.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    places = broadcast_if_bounded(first.select(*[F.col(c).alias(f"_{c}") for c in order]).distinct())
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]
    # Stored, or the join with the labels would ask every line for its pattern first.
    few = materialize(raw_lines.join(places, same, "left_semi"))
    return label_lines(annotate(few), labels, stored=True)


def _sample_rows(labels: DataFrame, seed: int) -> DataFrame:
    """Up to ten rows per cluster, each of its lines equally likely.

    Equal lines share a vector, so drawing lines means drawing copies of patterns.
    With independent exponential times per line the first ten arrivals are a
    uniform draw, and the arrivals of a pattern's ``n`` copies are partial sums of
    ``E_j / (n - j + 1)``; only its first ten can be among them.
    """

    def waiting(j: Column) -> Column:
        name = F.concat_ws(":", F.lit(str(seed)), F.col("point_id").cast("string"), j.cast("string"))
        noise = F.conv(F.left(F.md5(name), F.lit(12)), 16, 10).cast("bigint") + 1
        return -F.log(noise / float((1 << 48) + 1)) / (F.col("weight") - j + 1)

    def arrival(j: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), j), F.lit(0.0), lambda t, i: t + waiting(i))

    copies = F.sequence(F.lit(1), F.least("weight", F.lit(SAMPLES_PER_CLUSTER)).cast("int"))
    return labels.filter(F.col("cluster_id") != OUTLIER).select(
        "cluster_id", "vec", "point_id", F.explode(F.transform(copies, arrival)).alias("arrival")
    )


def build_model(
    labels: DataFrame, lines: DataFrame, order: Sequence[str] = ("pos",), seed: int = 17
) -> Model:
    """Registry, centroids and sample vectors of labelled patterns and lines.

    Of the lines only the first of each cluster matter, so they may be all there are.
    """
    counts = labels.filter(F.col("cluster_id") != OUTLIER).select(
        "cluster_id",
        "pattern",
        F.col("weight").alias("n"),
        F.struct(*[F.col(f"first_{c}").alias(c) for c in order]).alias("first"),
    )
    signatures = cluster_signatures(lines, order=order, counts=counts)
    registry = materialize(build_registry(signatures))
    ids = broadcast_if_bounded(registry.select("cluster_id", "stable_id"), stored=True)
    shape = cluster_geometry(labels, "cluster_id", "vec", "weight").join(ids, "cluster_id")
    centroids = shape.select(
        "stable_id", F.col("centroid").alias("vec"), "size", "avg_intra_distance", "centroid_norm"
    )
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("arrival", "point_id"))
    samples = (
        _sample_rows(labels, seed)
        .withColumn("idx", rank - 1)
        .filter(F.col("idx") < SAMPLES_PER_CLUSTER)
        .join(ids, "cluster_id")
        .select("stable_id", "idx", "vec")
    )
    columns = [c.split()[0] for c in REGISTRY_SCHEMA.split(", ")]
    return Model(registry.select(*columns), centroids, samples, Thresholds())


def train(
    raw_lines: DataFrame,
    preset: str = TRAINING_PRESET,
    featurizer: Featurizer | None = None,
    order: Sequence[str] = ("pos",),
    uniform: bool = False,
) -> Training:
    """Sign, cluster and register lines given as ``(pos, raw_log)``; with ``uniform``, nearly
    uniform ones are one cluster."""
    signed = annotate(raw_lines)
    # Every line is signed once; what is stored is narrow.
    placed = materialize(signed.select(*order, "pattern"))
    patterns = materialize(pattern_table(placed, order))
    labels = materialize(
        label_patterns(patterns, density_parameters(preset), featurizer, uniform)
    )
    lines = label_lines(signed, labels, stored=True)
    stats = cluster_stats(
        labels, data_type="preprocessed", aggression_level=preset, weight="weight"
    )
    first = sample_lines(raw_lines, placed, labels, order)
    return Training(lines, stats, build_model(labels, first, order))


__all__ = ["Training", "build_model", "label_lines", "label_patterns", "pattern_table", "sample_lines", "train"]
