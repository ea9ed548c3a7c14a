"""Sources, sinks and streams, fed with files Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clusters import cluster_signatures, cluster_stats
from ..operators.features import symbol_features
from ..operators.registry import build_registry
from ..operators.vectors import cluster_geometry, cluster_sample_vectors
from ..plans.infer import assign_lines
from ..session import estimated_bytes, materialize, sequential_ids, shared_folder
from ..sources import (
    Model,
    Thresholds,
    annotate,
    append_clustered,
    append_clustered_csv,
    clustered_rows,
    load_model,
    read_clustered,
    read_clustered_csv,
    read_log_directory,
    read_log_file,
    read_registry_json,
    save_model,
    save_patterns,
    save_stats,
)
from ..sources.logs import FILE_SPAN, file_numbers
from ..streaming import stream_assign, stream_new_signatures
from . import sql
from .clustering import REGISTRY_SQL, two_sets
from .corpora import doc_lines, embeddings, labelled_docs, page_lines, table
from .registry import query
from .training import NEAR, token_counts, token_vector

_LINES = f"""WITH raw AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
  lines AS (SELECT trim(line, {sql.WS}) AS raw_log FROM raw WHERE trim(line, {sql.WS}) <> '')"""
_COUNTED = f"{_LINES} SELECT raw_log, count(*) AS lines FROM lines GROUP BY raw_log"


def _write_logs(spark, folder, by_source: bool = False) -> str:
    """All documents as log files, one folder per source if asked."""
    path = shared_folder(spark)
    docs = table(spark, folder, "documents")
    if by_source:
        docs.select("source", "text").write.partitionBy("source").text(path)
    else:
        docs.select("text").write.text(path)
    return path


def _counted(lines):
    return lines.groupBy("raw_log").agg(F.count(F.lit(1)).alias("lines"))


@query("src_log_file", _COUNTED)
def log_file(spark, folder):
    return _counted(read_log_file(spark, _write_logs(spark, folder)))


_PLACED = f"""WITH {sql.DOC_LINES} SELECT row_number() OVER (ORDER BY pos) - 1 AS place, raw_log
  FROM doc_lines"""


# Stored bytes of documents whose lines make a file.
FILE_BYTES = 32 << 20


def _write_ordered(spark, folder, parts: int = 5) -> str:
    """The document lines as several files whose names follow the lines' order; more than
    ``parts`` if there is much to write."""
    path = shared_folder(spark)
    parts = max(parts, estimated_bytes(table(spark, folder, "documents")) // FILE_BYTES)
    # Documents go to the files in order before they are split, so lines are not shuffled.
    rows = doc_lines(spark, folder, parts).select("pos", "raw_log")
    ordered = rows.sortWithinPartitions("pos")
    ordered.select(F.regexp_replace("raw_log", "[\\r\\n]+", " ").alias("value")).write.text(path)
    return path


@query("src_log_dir", _PLACED)
def log_directory(spark, folder):
    """All lines of several files in one order: by file, then by line."""
    lines = read_log_directory(spark, _write_ordered(spark, folder), "part-*.txt")
    return sequential_ids(lines.select("pos", "raw_log"), ["pos"], "place").drop("pos")


@query(
    "union_files",
    f"""WITH raw AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT source, count(*) AS lines FROM raw WHERE trim(line, {sql.WS}) <> '' GROUP BY source""",
)
def union_of_files(spark, folder):
    """Lines per folder of files, told apart by the file each line is from."""
    path = _write_logs(spark, folder, by_source=True)
    counts = (
        read_log_directory(spark, path, "part-*.txt")
        .groupBy(F.floor(F.col("pos") / FILE_SPAN).alias("file_no"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )
    source = F.regexp_extract("source_path", "/source=([^/]+)/", 1).alias("source")
    return (
        counts.join(file_numbers(spark, path, "part-*.txt"), "file_no")
        .groupBy(source)
        .agg(F.sum("lines").alias("lines"))
    )


@query("sort_files", _PLACED.replace("ORDER BY pos", "ORDER BY n, pos").replace(
    "FROM doc_lines", "FROM (SELECT *, n FROM doc_lines, (VALUES (0), (1)) v(n))"
))
def lines_of_files(spark, folder):
    """A table appended to twice gives all lines in the order of appends, files and lines."""
    path, logs = shared_folder(spark), _write_ordered(spark, folder)
    lines = read_log_directory(spark, logs, "part-*.txt").withColumn("cluster", F.lit(1))
    append_clustered(lines.select("cluster", "pos", "raw_log"), path)
    append_clustered(lines.select("cluster", "pos", "raw_log"), path)
    rows = read_clustered(spark, path).select("pos", "raw_log")
    return sequential_ids(rows, ["pos"], "place", stored=True).drop("pos")


_SIGNED = f"WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}"
_CLUSTERED = f"""{_SIGNED}, clustered AS (
  SELECT CASE WHEN cluster = 0 THEN -1 ELSE cluster END AS cluster, raw_log,
    CASE WHEN cluster = 0 THEN 'outlier' ELSE pattern END AS pattern FROM signed)"""
_CLUSTERED_COUNTS = f"""{_CLUSTERED} SELECT cluster, raw_log, pattern, count(*) AS lines
  FROM clustered GROUP BY ALL"""


def _assigned(spark, folder):
    return clustered_rows(labelled_docs(spark, folder), "cluster_id")


def _table_counts(rows):
    return rows.groupBy(F.col("cluster").cast("int"), "raw_log", "pattern").agg(
        F.count(F.lit(1)).alias("lines")
    )


@query("src_clustered_csv", _CLUSTERED_COUNTS)
def clustered_csv(spark, folder):
    path = shared_folder(spark)
    append_clustered_csv(_assigned(spark, folder), path)
    return _table_counts(read_clustered_csv(spark, path))


@query(
    "clustered_csv_order",
    _PLACED.replace("ORDER BY pos", "ORDER BY n, pos").replace(
        "FROM doc_lines", "FROM (SELECT *, n FROM doc_lines, (VALUES (0), (1)) v(n))"
    ),
)
def clustered_csv_order(spark, folder):
    """CSV files appended to twice, read back in order."""
    path = shared_folder(spark)
    rows = _assigned(spark, folder)
    append_clustered_csv(rows, path)
    append_clustered_csv(rows, path)
    lines = read_clustered_csv(spark, path).select("pos", "raw_log")
    return sequential_ids(lines, ["pos"], "place", stored=True).drop("pos")


@query(
    "sink_clustered_append",
    _CLUSTERED_COUNTS.replace("count(*) AS lines", "2 * count(*) AS lines"),
)
def clustered_append(spark, folder):
    """Appending twice doubles the rows: the table has no key."""
    path = shared_folder(spark)
    rows = _assigned(spark, folder).select("cluster", "pos", "raw_log", "pattern")
    append_clustered(rows, path)
    append_clustered(rows, path)
    return _table_counts(read_clustered(spark, path))


@query(
    "sink_preprocessed",
    f"{_SIGNED} SELECT pattern, count(*) AS lines FROM signed GROUP BY pattern",
)
def preprocessed(spark, folder):
    path = shared_folder(spark)
    save_patterns(annotate(doc_lines(spark, folder)), path)
    saved = spark.read.text(path).withColumnRenamed("value", "pattern")
    return saved.groupBy("pattern").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "src_registry_json",
    f"""{REGISTRY_SQL} SELECT CAST(stable_id AS BIGINT) AS stable_id, signature_hash,
      array_to_string(patterns, '|') AS patterns, size AS training_size,
      array_to_string(sample_logs, '|') AS sample_logs,
      (SELECT count(*) FROM registry) AS next_stable_id FROM registry""",
)
def registry_json(spark, folder):
    """A registry document written from the labelled lines and read back."""
    registry = build_registry(cluster_signatures(labelled_docs(spark, folder)))
    info = F.struct("signature_hash", "patterns", "training_size", "sample_logs")
    entries = F.collect_list(F.struct(F.col("stable_id").cast("string"), info))
    document = registry.agg(
        F.map_from_entries(entries).alias("stable_id_to_info"),
        F.count(F.lit(1)).alias("next_stable_id"),
    )
    path = shared_folder(spark)
    document.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    read, _, settings = read_registry_json(spark, path)
    next_id = settings.first()["next_stable_id"]
    return read.select(
        "stable_id",
        "signature_hash",
        F.array_join("patterns", "|").alias("patterns"),
        "training_size",
        F.array_join("sample_logs", "|").alias("sample_logs"),
        F.lit(next_id).alias("next_stable_id"),
    )


@query(
    "sink_registry",
    """WITH d AS (SELECT label, i, avg(x) AS x FROM (SELECT label,
        unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i
        FROM embeddings) GROUP BY ALL),
      n AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)
    SELECT CAST(label AS INTEGER) AS stable_id, size, least(size, 10) AS samples,
      round(sqrt(sum(x * x)), 6) AS centroid_norm, CAST(0.25 AS DOUBLE) AS primary_distance
    FROM d JOIN n USING (label) GROUP BY ALL""",
)
def saved_model(spark, folder):
    vectors = embeddings(spark, folder)
    centroids = cluster_geometry(vectors).select(
        F.col("label").alias("stable_id"), F.col("centroid").alias("vec"), "size", "centroid_norm"
    )
    samples = cluster_sample_vectors(vectors, "row_id").select(
        F.col("label").alias("stable_id"), "idx", "vec"
    )
    path = shared_folder(spark)
    save_model(Model(centroids.drop("vec"), centroids, samples, Thresholds()), path)
    model = load_model(spark, path)
    counts = model.samples.groupBy("stable_id").agg(F.count(F.lit(1)).alias("samples"))
    return model.centroids.join(counts, "stable_id").select(
        "stable_id",
        "size",
        "samples",
        F.round("centroid_norm", 6).alias("centroid_norm"),
        F.lit(model.thresholds.primary_distance).alias("primary_distance"),
    )


@query(
    "sink_stats",
    f"""{_CLUSTERED} SELECT count(*) AS total_logs, count(DISTINCT cluster) - 1 AS num_clusters,
      count(*) FILTER (cluster = -1) AS num_outliers FROM clustered""",
)
def saved_stats(spark, folder):
    path = shared_folder(spark)
    save_stats(cluster_stats(labelled_docs(spark, folder)), path)
    return spark.read.json(path).select("total_logs", "num_clusters", "num_outliers")


def _source_model(spark, folder, featurizer=symbol_features, limits=Thresholds()) -> Model:
    """Document sources as clusters of their lines' vectors."""
    # Signed once: the vectors are computed twice below, from the patterns.
    signed = materialize(labelled_docs(spark, folder).select("pos", "pattern", "cluster_id"))
    rows = featurizer(signed).withColumnRenamed("cluster_id", "label")
    centroids = cluster_geometry(rows).select(
        F.col("label").alias("stable_id"), F.col("centroid").alias("vec")
    )
    samples = cluster_sample_vectors(rows, "pos", seed=None).select(
        F.col("label").alias("stable_id"), "idx", "vec"
    )
    return Model(centroids, materialize(centroids), materialize(samples), limits)


def _log_files(spark, folder) -> str:
    """The page lines as log files."""
    path = shared_folder(spark)
    flat = F.regexp_replace("raw_log", "[\\r\\n]+", " ")
    page_lines(spark, folder).select(flat.alias("value")).write.text(path)
    return path


def _streamed(spark, folder, model: Model, featurizer=None):
    out = shared_folder(spark)
    logs = _log_files(spark, folder)
    stream_assign(
        spark, logs, model, out, shared_folder(spark), featurizer, glob="part-*.txt"
    ).awaitTermination()
    return (
        spark.read.parquet(out)
        .groupBy(F.col("cluster").cast("int").alias("cluster"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def _batched(spark, folder, model: Model, featurizer=None):
    logs = read_log_directory(spark, _log_files(spark, folder), "part-*.txt")
    rows = clustered_rows(assign_lines(logs, model, featurizer))
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("lines"))


_BY_SOURCE = f"""WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}, {sql.PAGE_LINES},
  {sql.signed('page_lines', 'page_signed')},
  known AS MATERIALIZED (SELECT pattern, {sql.default_vector('pattern')} AS vec
    FROM (SELECT DISTINCT pattern FROM signed WHERE cluster <> 0)),
  dims AS (SELECT cluster, i, sum(weight * x) / sum(weight) AS x FROM (
      SELECT cluster, weight, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM (
        SELECT cluster, pattern, count(*) AS weight FROM signed WHERE cluster <> 0 GROUP BY ALL)
      JOIN known USING (pattern)) GROUP BY cluster, i),
  sources AS MATERIALIZED (SELECT cluster AS stable_id, list(x ORDER BY i) AS center
    FROM dims GROUP BY cluster),
  firsts AS MATERIALIZED (SELECT cluster AS stable_id, vec, row_number() OVER (
      PARTITION BY cluster ORDER BY pos) - 1 AS idx
    FROM signed JOIN known USING (pattern) WHERE cluster <> 0 QUALIFY idx < 10),
  fresh AS MATERIALIZED (SELECT pattern, count(*) AS lines,
    {sql.default_vector('pattern')} AS vec FROM page_signed GROUP BY pattern),
  {sql.matched('fresh', 'sources', 'firsts', Thresholds())}
  SELECT CAST(stable_id AS INTEGER) AS cluster, CAST(sum(lines) AS BIGINT) AS lines
  FROM matched GROUP BY ALL"""


@query("stream_assign", _BY_SOURCE)
def streamed(spark, folder):
    """Lines per cluster after the stream has taken in all files."""
    return _streamed(spark, folder, _source_model(spark, folder))


@query("batch_assign", _BY_SOURCE)
def batched(spark, folder):
    """The same files through batch inference."""
    return _batched(spark, folder, _source_model(spark, folder))


@query(
    "stream_order",
    f"""WITH {sql.DOC_LINES} SELECT row_number() OVER (ORDER BY pos) - 1 AS place, raw_log
    FROM doc_lines WHERE cluster = 3""",
)
def stream_order(spark, folder):
    """The lines of several files in the order of the streamed table."""
    logs, out = shared_folder(spark), shared_folder(spark)
    rows = doc_lines(spark, folder).filter(F.col("cluster") == 3).select("pos", "raw_log")
    ordered = rows.repartitionByRange(4, "pos").sortWithinPartitions("pos")
    ordered.select(F.col("raw_log").alias("value")).write.text(logs)
    none = spark.createDataFrame([], "stable_id bigint, idx bigint, vec array<double>")
    model = Model(none, none, none, Thresholds())
    stream_assign(
        spark, logs, model, out, shared_folder(spark), glob="part-*.txt"
    ).awaitTermination()
    lines = read_clustered(spark, out).select("pos", "raw_log")
    return sequential_ids(lines, ["pos"], "place").select("place", "raw_log")


_PER_SOURCE = f"""WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}, {sql.PAGE_LINES},
  {sql.signed('page_lines', 'page_signed')},
  counted AS (SELECT cluster, pattern, count(*) AS weight FROM signed WHERE cluster <> 0
    GROUP BY ALL),
  known AS (SELECT cluster, weight, {token_vector('pattern')} AS vec FROM counted),
  dims AS (SELECT cluster, i, sum(weight * x) / sum(weight) AS x FROM (SELECT cluster, weight,
      unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM known) GROUP BY cluster, i),
  centers AS MATERIALIZED (SELECT cluster, list(x ORDER BY i) AS center FROM dims GROUP BY cluster),
  fresh AS (SELECT pattern, count(*) AS lines, {token_vector('pattern')} AS vec
    FROM page_signed GROUP BY pattern),
  compared AS (SELECT pattern, lines, cluster, CASE WHEN list_dot_product(vec, vec) = 0 THEN 1
      ELSE 1 - list_cosine_similarity(vec, center) END AS distance
    FROM fresh CROSS JOIN centers),
  nearest AS (SELECT * FROM compared QUALIFY row_number() OVER (
    PARTITION BY pattern ORDER BY round(distance, 9), cluster) = 1)
  SELECT CAST(CASE WHEN distance < {NEAR.primary_distance} THEN cluster ELSE -1 END AS INTEGER)
    AS cluster, CAST(sum(lines) AS BIGINT) AS lines FROM nearest GROUP BY 1"""


@query("stream_assign_tokens", _PER_SOURCE)
def token_stream(spark, folder):
    """The stream with vectors SQL can repeat."""
    return _streamed(spark, folder, _source_model(spark, folder, token_counts, NEAR), token_counts)


@query("batch_assign_tokens", _PER_SOURCE)
def token_batch(spark, folder):
    return _batched(spark, folder, _source_model(spark, folder, token_counts, NEAR), token_counts)


@query(
    "stream_new_signatures",
    f"""{two_sets('SELECT * FROM labelled')}
    SELECT CAST(row_number() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS stable_id, signature_hash,
      size AS training_size, CAST(NULL AS BIGINT) AS inference_size FROM t_signatures
    UNION ALL SELECT CAST(new_id AS BIGINT), signature_hash, 0,
      (SELECT arg_min(size, f.first_pos) FROM f_signatures f
       WHERE f.signature_hash = numbered.signature_hash) FROM numbered""",
)
def streamed_signatures(spark, folder):
    """The registry after streaming in all labelled lines, even documents known."""
    lines = labelled_docs(spark, folder)
    known = lines.filter(F.floor(F.col("pos") / (1 << 32)) % 2 == 0)
    path, store = shared_folder(spark), shared_folder(spark)
    lines.write.parquet(path)
    stream = stream_new_signatures(
        spark.readStream.schema(lines.schema).parquet(path),
        build_registry(cluster_signatures(known)).drop("cluster_id"),
        store,
        shared_folder(spark),
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{store}/registry").select(
        "stable_id", "signature_hash", "training_size", "inference_size"
    )

