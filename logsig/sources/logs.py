"""Log files in, clustered-log tables out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_blank, pattern_signature, strip
from ..session import broadcast_if_bounded, materialize, sequential_ids

OUTLIER = -1
OUTLIER_PATTERN = "outlier"


def line_position() -> Column:
    """File-order key of a row, without a sort or a shuffle.

    The byte offset of the row's split plus its rank in the task. A split of full
    length is alone in its task and no line is shorter than a byte, so the keys
    of one file never run into the next split's.
    """
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + rank


#: Bytes of one file's positions: files and appends follow each other in steps of it.
FILE_SPAN = 1 << 40


def file_numbers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(source_path, file_no)`` of the files of a folder in the order of their paths.

    Spark lists them; no file is opened and no name comes to the driver.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    names = reader.load(path).select(F.col("path").alias("source_path"))
    return sequential_ids(names, ["source_path"], "file_no")


def in_file_order(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with ``source_path`` and ``pos`` within the file: ``pos`` becomes one number that
    orders the lines of all files, by file and then by place."""
    placed = rows.join(broadcast_if_bounded(files), "source_path")
    return placed.withColumn("pos", F.col("file_no") * FILE_SPAN + F.col("pos")).drop(
        "file_no", "source_path"
    )


def _decoded(value: Column) -> Column:
    """Bytes that are no UTF-8 are dropped, as a lenient reader does."""
    return F.when(F.is_valid_utf8(value), value).otherwise(
        F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
    )


def _path_key() -> Column:
    """A file's path as the file listing spells it."""
    return F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/"))


def _lines(raw: DataFrame, *more: Column) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_name").alias("source_file"),
        line_position().alias("pos"),
        strip(_decoded(F.col("value"))).alias("raw_log"),
        *more,
    ).filter(F.col("raw_log") != "")


def read_log_file(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a log file as ``(source_file, pos, raw_log)``.

    A folder is read too, as one log: its files follow each other by their paths."""
    return _all_lines(spark, path, None)


def read_log_directory(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Lines of all log files in a folder; ``pos`` orders them by file, then by line."""
    return _all_lines(spark, path, glob)


def _all_lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    files = materialize(file_numbers(spark, path, glob))
    if files.isEmpty():
        raise FileNotFoundError(f"No {glob or 'log'} files found in {path}")
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return in_file_order(_lines(reader.text(path), _path_key().alias("source_path")), files)


def annotate(lines: DataFrame) -> DataFrame:
    """Add every line's ``pattern``."""
    return lines.withColumn("pattern", pattern_signature(F.col("raw_log")))


def signature_batch(lines: DataFrame) -> DataFrame:
    """Strip, drop blanks and annotate lines that come from any table."""
    stripped = lines.filter(~is_blank(F.col("raw_log"))).withColumn(
        "raw_log", strip(F.col("raw_log"))
    )
    return annotate(stripped)


def save_patterns(signed: DataFrame, path: str) -> None:
    """One pattern per line, as text."""
    signed.select("pattern").write.mode("errorifexists").text(path)


def clustered_rows(assigned: DataFrame, cluster: str = "stable_id") -> DataFrame:
    """Assigned lines in the shape of the clustered-log table.

    Lines that have their pattern already are not signed again."""
    signed = assigned if "pattern" in assigned.columns else annotate(assigned)
    return signed.withColumn("cluster", F.col(cluster).cast("int")).withColumn(
        "pattern",
        F.when(F.col("cluster") == OUTLIER, F.lit(OUTLIER_PATTERN)).otherwise(F.col("pattern")),
    )


def append_clustered(clustered: DataFrame, path: str) -> None:
    """Append to the Parquet table, one directory per cluster.

    What is appended comes after what is there: its ``pos`` goes on from the table's last
    (read from the files' statistics). Rebalancing by cluster first gives few files per
    cluster and splits a cluster that is too big for one task.
    """
    if "pos" in clustered.columns:
        clustered = clustered.withColumn("pos", F.col("pos") + _next_position(clustered, path))
    (
        clustered.hint("rebalance", "cluster")
        .sortWithinPartitions("cluster", "pos")
        .write.mode("append")
        .partitionBy("cluster")
        .parquet(path)
    )


def _next_position(rows: DataFrame, path: str) -> int:
    """First free position of a table, at the start of a new file's span."""
    stored = _existing(rows.sparkSession, path)
    last = stored.agg(F.max("pos")).first()[0] if stored is not None and "pos" in stored.columns else None
    return 0 if last is None else (last // FILE_SPAN + 1) * FILE_SPAN


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The table; ``pos`` orders its lines by append, file and line."""
    return spark.read.parquet(path)


# A null marker no line contains, so that an empty pattern stays an empty text.
_CSV = {"header": True, "quote": '"', "escape": '"', "nullValue": "\0", "emptyValue": ""}


def append_clustered_csv(clustered: DataFrame, path: str) -> None:
    """Append ``cluster,raw_log,pattern`` as CSV files, quotes doubled.

    Each append is a folder of its own, numbered, whose files hold the lines in order.
    """
    spark = clustered.sparkSession
    try:
        number = spark.read.text(path).agg(F.max("append")).first()[0]
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
            raise
        number = None
    number = 0 if number is None else int(number) + 1
    if "pos" in clustered.columns:
        parts = spark.sparkContext.defaultParallelism
        clustered = clustered.repartitionByRange(parts, "pos").sortWithinPartitions("pos")
    rows = clustered.select("cluster", "raw_log", "pattern")
    rows.write.options(quoteAll=True, **_CSV).csv(f"{path}/append={number:09d}")


def read_clustered_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan clustered-log CSV by the names in its header, extra columns aside; rows without an
    integer cluster are skipped. ``pos`` orders the lines by append, file and line."""
    reader = spark.read.options(ignoreLeadingWhiteSpace=False, recursiveFileLookup=True, **_CSV)
    # Spark matches columns by place, so the header of the files says what stands where.
    names = reader.csv(path).columns
    lacking = {"cluster", "raw_log", "pattern"} - set(names)
    if lacking:
        raise ValueError(f"The header lacks {', '.join(sorted(lacking))}")
    raw = reader.csv(path, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=False)
    rows = raw.select(
        strip(F.col("cluster")).try_cast("int").alias("cluster"),
        "raw_log",
        "pattern",
        F.col("_metadata.file_name").alias("source_file"),
        line_position().alias("pos"),
        _path_key().alias("source_path"),
    ).filter(
        F.col("cluster").isNotNull() & F.col("raw_log").isNotNull() & F.col("pattern").isNotNull()
    )
    return in_file_order(rows, file_numbers(spark, path))
