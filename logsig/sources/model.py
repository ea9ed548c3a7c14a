"""The trained model as tables: registry, centroids, samples, thresholds."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """When a vector belongs to its nearest cluster. Fixed default values."""

    primary_distance: float = 0.25
    secondary_distance: float = 0.4
    knn_k: int = 5
    knn_confidence: float = 0.6


@dataclass(frozen=True)
class Model:
    registry: DataFrame
    centroids: DataFrame
    samples: DataFrame
    thresholds: Thresholds = Thresholds()
    # The id a stored registry names for its next new cluster; else one above the last.
    next_id: int | None = None


REGISTRY_SCHEMA = (
    "stable_id bigint, signature_hash string, patterns array<string>, training_size bigint, "
    "inference_size bigint, sample_logs array<string>, is_new_pattern boolean"
)

_INFO = (
    "struct<signature_hash:string,patterns:array<string>,training_size:bigint,"
    "inference_size:bigint,sample_logs:array<string>,is_new_pattern:boolean>"
)
_STATS = "struct<size:bigint,avg_intra_distance:double,centroid_norm:double>"
_LIMITS = (
    "struct<primary_distance_threshold:double,secondary_distance_threshold:double,"
    "knn_k:int,knn_confidence_threshold:double>"
)
_SETTINGS = (
    "primary_distance double, secondary_distance double, knn_k int, knn_confidence double, "
    "next_id bigint"
)
_DOCUMENT = (
    "struct<signature_to_stable_id:map<string,bigint>,"
    f"stable_id_to_info:map<string,{_INFO}>,next_stable_id:bigint,"
    f"cluster_stats:map<string,{_STATS}>,distance_thresholds:{_LIMITS}>"
)


def read_registry_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A registry kept as one JSON document, as three tables.

    Returns the registry, the per-cluster statistics, and one row with the next
    free id and the thresholds. Malformed JSON is an error.
    """
    document = spark.read.text(path, wholetext=True).select(
        F.from_json("value", _DOCUMENT, {"mode": "FAILFAST"}).alias("doc")
    )
    infos = document.select(F.explode("doc.stable_id_to_info").alias("id", "info"))
    registry = infos.select(F.col("id").cast("bigint").alias("stable_id"), "info.*")
    stats = document.select(F.explode("doc.cluster_stats").alias("id", "stats")).select(
        F.col("id").cast("bigint").alias("stable_id"), "stats.*"
    )
    settings = document.select("doc.next_stable_id", "doc.distance_thresholds.*")
    return registry, stats, settings


def stored_model(
    spark: SparkSession, path: str, centroids: DataFrame, samples: DataFrame
) -> Model:
    """A model that goes on from a registry document: its clusters, thresholds and next id.

    The document holds no vectors, so centroids and samples come as tables. Thresholds it
    lacks keep their defaults.
    """
    registry, _, settings = read_registry_json(spark, path)
    row = settings.first()
    given = {
        "primary_distance": row["primary_distance_threshold"],
        "secondary_distance": row["secondary_distance_threshold"],
        "knn_k": row["knn_k"],
        "knn_confidence": row["knn_confidence_threshold"],
    }
    known = {name: value for name, value in given.items() if value is not None}
    return Model(registry, centroids, samples, Thresholds(**known), row["next_stable_id"])


def save_model(model: Model, path: str) -> None:
    """Write the model to a new folder, the thresholds last.

    A folder without thresholds is an unfinished save; versions are never
    overwritten in place, so readers of an older one stay undisturbed.
    """
    for name in ("registry", "centroids", "samples"):
        getattr(model, name).write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = model.registry.sparkSession
    row = (*asdict(model.thresholds).values(), model.next_id)
    spark.createDataFrame([row], _SETTINGS).write.mode("errorifexists").json(f"{path}/thresholds")


def load_model(spark: SparkSession, path: str) -> Model:
    settings = spark.read.schema(_SETTINGS).json(f"{path}/thresholds").first().asDict()
    next_id = settings.pop("next_id")
    tables = [spark.read.parquet(f"{path}/{n}") for n in ("registry", "centroids", "samples")]
    return Model(*tables, Thresholds(**settings), next_id)


def save_stats(stats: DataFrame, path: str) -> None:
    """Persist the one-row training statistics as JSON."""
    stats.write.mode("errorifexists").json(path)
