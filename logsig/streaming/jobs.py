"""Streams over growing log folders.

Signatures are stateless and run on the stream itself. Assignment and registry
updates run per micro-batch: every batch writes its own directory, so a batch that
is replayed after a failure replaces its output instead of doubling it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import pattern_signature, strip
from ..operators.clusters import cluster_signatures
from ..operators.features import Featurizer
from ..operators.registry import new_signatures
from ..plans.infer import assign_lines
from ..session import materialize, sequential_ids, temporary_tables
from ..sources.logs import _existing, _lines, _path_key, clustered_rows, in_file_order
from ..sources.model import Model


# Files of one micro-batch, so that a backlog is worked off in steps.
FILES_PER_BATCH = 1000
# Beside the partitions of a streamed table; readers of the table pass it over.
FILE_COUNTS = "_files"


def log_stream(
    spark: SparkSession, path: str, glob: str = "*.log", files: int = FILES_PER_BATCH
) -> DataFrame:
    """New log files as a stream of ``(value, _metadata)``, so many files at a time."""
    reader = spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", files)
    return reader.text(path).select("value", "_metadata")


def stream_signatures(stream: DataFrame) -> DataFrame:
    """A streaming ``(source_file, raw_log, pattern)``, blank lines dropped."""
    lines = stream.select(
        F.col("_metadata.file_name").alias("source_file"), strip(F.col("value")).alias("raw_log")
    )
    return lines.filter(F.col("raw_log") != "").withColumn(
        "pattern", pattern_signature(F.col("raw_log"))
    )


def stream_assign(
    spark: SparkSession,
    path: str,
    model: Model,
    out: str,
    checkpoint_dir: str,
    featurizer: Featurizer | None = None,
    glob: str = "*.log",
    files: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Assign every new log file's lines and append them to the clustered table.

    The table is partitioned by ``batch_id`` and ``cluster``; read it as one with
    ``spark.read.parquet(out)``. ``pos`` orders its lines as a batch job does: by micro-batch,
    then by the files' paths, then by line. How many files each batch had is kept beside the
    table, so a batch starts behind the ones before it and a replay where it did.
    """
    frozen = Model(
        model.registry,
        materialize(model.centroids),
        materialize(model.samples),
        model.thresholds,
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # What the batch stores on its way goes when its rows are written.
        with temporary_tables(spark):
            read = materialize(_lines(batch, _path_key().alias("source_path")))
            paths = read.select("source_path").distinct()
            files = materialize(
                sequential_ids(paths, ["source_path"], "file_no", _files_before(spark, out, batch_id))
            )
            lines = in_file_order(read, files)
            rows = clustered_rows(assign_lines(lines, frozen, featurizer))
            (
                rows.hint("rebalance", "cluster")
                .sortWithinPartitions("cluster", "pos")
                .write.mode("overwrite")
                .partitionBy("cluster")
                .parquet(f"{out}/batch_id={batch_id}")
            )
            files.agg(F.count(F.lit(1)).alias("files")).write.mode("overwrite").parquet(
                f"{out}/{FILE_COUNTS}/batch_id={batch_id}"
            )

    return (
        log_stream(spark, path, glob, files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def _files_before(spark: SparkSession, out: str, batch_id: int) -> int:
    """Files of the batches before this one; one small row each."""
    counts = _existing(spark, f"{out}/{FILE_COUNTS}")
    if counts is None:
        return 0
    before = counts.filter(F.col("batch_id") < batch_id)
    return before.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def stream_new_signatures(
    labelled: DataFrame, registry: DataFrame, store: str, checkpoint_dir: str
) -> StreamingQuery:
    """Extend the registry with the unseen signatures of each micro-batch.

    ``labelled`` streams ``(pos, raw_log, pattern, cluster_id)``. A batch writes the rows it
    adds, as its own version under ``store/registry``, and the mapping it used; version -1 is
    the registry given. All versions together are the registry.
    """
    spark = registry.sparkSession
    path = f"{store}/registry"
    registry.write.mode("overwrite").parquet(f"{path}/version=-1")

    def extend(batch: DataFrame, batch_id: int) -> None:
        with temporary_tables(spark):
            known = spark.read.parquet(path).filter(F.col("version") < batch_id).drop("version")
            mapping, added = new_signatures(cluster_signatures(materialize(batch)), known)
            added.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
            mapping.write.mode("overwrite").parquet(f"{store}/mapping/batch_id={batch_id}")

    return (
        labelled.writeStream.foreachBatch(extend)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
