"""The clustered-log query operators over whole corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import cluster_signatures
from ..operators.indexed import (
    append_indexed,
    indexed_filter,
    indexed_query,
    match_counts,
    matching_lines,
    read_indexed,
    uniqueness_estimate,
)
from ..operators.query import (
    filter_cluster_pattern,
    log_filter,
    log_query,
    page,
    page_meta,
    page_problem,
)
from ..operators.registry import build_registry, log_schema
from ..session import materialize, shared_folder
from ..sources import annotate, append_clustered, read_clustered, read_log_directory
from . import sql
from .clustering import REGISTRY_SQL
from .corpora import clustered_docs, doc_lines, labelled_docs, table
from .registry import query

_SIGNED = f"WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}"
CLUSTER, NEEDLE, LIMIT, OFFSET = 3, ", .", 50, 20
_MATCH = f"cluster = {CLUSTER} AND contains(lower(pattern), '{NEEDLE}')"
_PAGE = f"ORDER BY pos LIMIT {LIMIT} OFFSET {OFFSET}"


@query(
    "filter_cluster_pattern",
    f"{_SIGNED} SELECT pos, raw_log, pattern FROM signed WHERE {_MATCH}",
)
def filtered(spark, folder):
    rows = filter_cluster_pattern(clustered_docs(spark, folder), CLUSTER, NEEDLE)
    return rows.select("pos", "raw_log", "pattern")


@query("log_query", f"{_SIGNED} SELECT pos, raw_log AS text FROM signed WHERE {_MATCH} {_PAGE}")
def query_page(spark, folder):
    return log_query(clustered_docs(spark, folder), CLUSTER, NEEDLE, LIMIT, OFFSET)[0]


@query(
    "log_query_shallow",
    f"""{_SIGNED}, page AS (SELECT * FROM signed WHERE {_MATCH} {_PAGE})
    SELECT pos, {sql.reconstruction('raw_log', 'pattern')} AS text FROM page""",
)
def shallow_page(spark, folder):
    return log_query(clustered_docs(spark, folder), CLUSTER, NEEDLE, LIMIT, OFFSET, True)[0]


@query(
    "log_filter",
    f"""{_SIGNED}, page AS (SELECT * FROM signed WHERE {_MATCH} ORDER BY pos LIMIT 100),
    walked AS (SELECT pos, {sql.fields('raw_log', 'pattern')} AS w FROM page)
    SELECT pos, coalesce(array_to_string(list_filter([w[1].text, w[3].text, w[2].text],
      lambda t: t IS NOT NULL), chr(9)), '') AS text FROM walked""",
)
def filter_page(spark, folder):
    return log_filter(clustered_docs(spark, folder), CLUSTER, NEEDLE, [0, 2, 1])[0]


@query(
    "page_meta",
    f"""{_SIGNED}, n AS (SELECT count(*) AS total FROM signed WHERE {_MATCH})
    SELECT CAST({OFFSET} AS BIGINT) AS current_offset,
      CAST(least({LIMIT}, greatest(total - {OFFSET}, 0)) AS BIGINT) AS returned_count,
      CAST({LIMIT} AS BIGINT) AS requested_limit, {OFFSET + LIMIT} >= total AS "isEnd",
      total AS total_matches, {CLUSTER} AS cluster_id, '{NEEDLE}' AS pattern_filter,
      false AS shallow_mode FROM n""",
)
def query_meta(spark, folder):
    return log_query(clustered_docs(spark, folder), CLUSTER, NEEDLE, LIMIT, OFFSET)[1]


@query(
    "validate_page_args",
    """WITH pages AS (SELECT conv_id, turn, turn - 1 AS start, length(text) AS size
      FROM conversations)
    SELECT conv_id, turn, CASE WHEN size <= 0 THEN 'Limit must be greater than 0'
      WHEN start < 0 THEN 'Offset must be non-negative'
      WHEN size > 1000 THEN 'Limit cannot exceed 1000 to prevent performance issues'
      ELSE 'ok' END AS verdict FROM pages""",
)
def page_arguments(spark, folder):
    """The argument check applied to page requests kept as a table."""
    requests = table(spark, folder, "conversations")
    problem = page_problem(F.char_length("text"), F.col("turn") - 1)
    return requests.select("conv_id", "turn", F.coalesce(problem, F.lit("ok")).alias("verdict"))


_TWICE = f"""{_SIGNED}, twice AS (SELECT row_number() OVER (ORDER BY n, pos) AS place, raw_log,
    pattern FROM signed, (VALUES (0), (1)) v(n) WHERE {_MATCH})"""


def _appended_files(spark, folder):
    """Log files read as a folder and appended twice to the partitioned table."""
    logs, path = shared_folder(spark), shared_folder(spark)
    rows = doc_lines(spark, folder).filter(F.col("cluster") == CLUSTER).select("pos", "raw_log")
    ordered = rows.repartitionByRange(4, "pos").sortWithinPartitions("pos")
    ordered.select(F.col("raw_log").alias("value")).write.text(logs)
    lines = annotate(read_log_directory(spark, logs, "part-*.txt"))
    for _ in range(2):
        append_clustered(lines.withColumn("cluster", F.lit(CLUSTER)), path)
    return read_clustered(spark, path)


def _all_pages(pages):
    """Pages of a table one after the other, with their number."""
    return reduce(
        DataFrame.unionByName,
        [p.select(F.lit(n).alias("page"), "text") for n, p in enumerate(pages)],
    )


@query(
    "log_query_files",
    f"""{_TWICE} SELECT CAST((place - 1) // 40 AS INTEGER) AS page, raw_log AS text FROM twice
    WHERE place <= 200""",
)
def query_over_files(spark, folder):
    """Pages over several files and two appends follow append, file and line."""
    table_ = _appended_files(spark, folder)
    return _all_pages(log_query(table_, CLUSTER, NEEDLE, 40, 40 * n)[0] for n in range(5))


@query(
    "log_filter_files",
    f"""{_TWICE}, walked AS (SELECT place, {sql.fields('raw_log', 'pattern')} AS w FROM twice
      WHERE place <= 200)
    SELECT CAST((place - 1) // 40 AS INTEGER) AS page,
      coalesce(array_to_string(list_filter([w[1].text, w[2].text],
        lambda t: t IS NOT NULL), chr(9)), '') AS text FROM walked""",
)
def filter_over_files(spark, folder):
    table_ = _appended_files(spark, folder)
    return _all_pages(log_filter(table_, CLUSTER, NEEDLE, [0, 1], 40, 40 * n)[0] for n in range(5))


def _indexed(spark, folder, appends: int = 2):
    """All document lines in an indexed log."""
    path = shared_folder(spark)
    lines = materialize(clustered_docs(spark, folder).select("pos", "raw_log", "pattern", "cluster"))
    for _ in range(appends):
        append_indexed(lines, path, stored=True)
    return read_indexed(spark, path)


@query(
    "filter_cluster_pattern_indexed",
    f"{_SIGNED} SELECT pos, raw_log FROM signed WHERE {_MATCH}",
)
def indexed_matches(spark, folder):
    """The needle is matched on the dictionary, lines are picked by pattern id."""
    return matching_lines(_indexed(spark, folder, 1), CLUSTER, NEEDLE).select("pos", "raw_log")


@query(
    "log_query_indexed",
    f"""{_TWICE} SELECT CAST((place - 1) // 40 AS INTEGER) AS page, raw_log AS text FROM twice
    WHERE place <= 200""",
)
def query_indexed(spark, folder):
    """Pages over two appends, located by stored counts."""
    log = _indexed(spark, folder)
    return _all_pages(indexed_query(log, CLUSTER, NEEDLE, 40, 40 * n)[0] for n in range(5))


@query(
    "log_filter_indexed",
    f"""{_TWICE}, walked AS (SELECT place, {sql.fields('raw_log', 'pattern')} AS w FROM twice
      WHERE place <= 80)
    SELECT CAST((place - 1) // 40 AS INTEGER) AS page,
      coalesce(array_to_string(list_filter([w[1].text, w[2].text],
        lambda t: t IS NOT NULL), chr(9)), '') AS text FROM walked""",
)
def filter_indexed(spark, folder):
    log = _indexed(spark, folder)
    return _all_pages(indexed_filter(log, CLUSTER, NEEDLE, [0, 1], 40, 40 * n)[0] for n in range(2))


@query(
    "page_meta_indexed",
    f"""{_TWICE}, n AS (SELECT count(*) AS total FROM twice)
    SELECT total - 5 AS current_offset, CAST(5 AS BIGINT) AS returned_count, true AS "isEnd",
      total AS total_matches, CAST(5 AS BIGINT) AS lines FROM n""",
)
def meta_indexed(spark, folder):
    """The last page: its lines and metadata come from the counts."""
    log = _indexed(spark, folder)
    total = match_counts(log, CLUSTER, NEEDLE).agg(F.sum("n")).first()[0]
    lines, meta = indexed_query(log, CLUSTER, NEEDLE, LIMIT, total - 5)
    return meta.select("current_offset", "returned_count", "isEnd", "total_matches").withColumn(
        "lines", F.lit(lines.count()).cast("bigint")
    )


@query(
    "pattern_uniqueness_sketch",
    f"""{_SIGNED}, n AS (SELECT 2 * count(*) AS lines, count(DISTINCT pattern) AS patterns FROM signed)
    SELECT CAST(lines AS BIGINT) AS lines, true AS near, patterns / lines < 0.05 AS low_variation FROM n""",
)
def sketched_uniqueness(spark, folder):
    """Merged sketches of two appends against the exact number of patterns."""
    log = _indexed(spark, folder)
    exact = F.lit(log.patterns.agg(F.count_distinct("pattern")).first()[0])
    near = F.abs(F.col("distinct_patterns") - exact) <= F.col("error") * exact
    return uniqueness_estimate(log).select("lines", near.alias("near"), "low_variation")


@query(
    "log_query_deep",
    f"""{_SIGNED} SELECT pos, raw_log FROM signed WHERE cluster <> {CLUSTER}
    ORDER BY pos LIMIT {LIMIT} OFFSET 700""",
)
def deep_page(spark, folder):
    """A page found by counting ranges of positions, as pages far into a table are."""
    rows = clustered_docs(spark, folder).filter(F.col("cluster") != CLUSTER)
    return page(rows.select("pos", "raw_log"), LIMIT, 700, direct_offset=10, ranges=16)


@query(
    "page_past_end",
    f"""{_SIGNED}, n AS (SELECT count(*) AS total FROM signed WHERE cluster = {CLUSTER})
    SELECT total + 5 AS current_offset, CAST(0 AS BIGINT) AS returned_count, true AS "isEnd",
      CAST(0 AS BIGINT) AS lines FROM n""",
)
def past_end(spark, folder):
    rows = clustered_docs(spark, folder).filter(F.col("cluster") == CLUSTER)
    offset = rows.count() + 5
    lines = page(rows, 10, offset).count()
    meta = page_meta(rows, 10, offset).select("current_offset", "returned_count", "isEnd")
    return meta.withColumn("lines", F.lit(lines).cast("bigint"))


@query(
    "log_query_table",
    f"{_SIGNED} SELECT pos, raw_log AS text FROM signed WHERE {_MATCH} {_PAGE}",
)
def stored_page(spark, folder):
    """The page from the partitioned table inference writes: one cluster is read."""
    path = shared_folder(spark)
    append_clustered(clustered_docs(spark, folder), path)
    return log_query(read_clustered(spark, path), CLUSTER, NEEDLE, LIMIT, OFFSET)[0]


@query(
    "log_schema",
    f"""{REGISTRY_SQL} SELECT stable_id AS cluster, array_to_string(patterns, '|')
      AS pattern_signatures, size AS training_size,
      CASE WHEN length(sample_logs[1]) > 150 THEN left(sample_logs[1], 150) || '...'
           ELSE sample_logs[1] END AS sample_preview FROM registry""",
)
def schema_clusters(spark, folder):
    registry = build_registry(cluster_signatures(labelled_docs(spark, folder)))
    return log_schema(registry)[0].withColumn(
        "pattern_signatures", F.array_join("pattern_signatures", "|")
    )


@query(
    "log_schema_totals",
    f"""{REGISTRY_SQL} SELECT count(*) AS total_clusters,
      CAST(sum(size) AS BIGINT) AS total_training_logs, max(stable_id) + 1 AS next_available_id,
      '1.0' AS schema_version FROM registry""",
)
def schema_totals(spark, folder):
    registry = build_registry(cluster_signatures(labelled_docs(spark, folder)))
    return log_schema(registry)[1]
