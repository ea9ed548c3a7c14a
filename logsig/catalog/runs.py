"""Run-log analytics; run logs are derived from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.runlog import (
    call_results,
    insight_streak,
    read_run_logs,
    run_summary,
    stop_reason,
    tool_call_counts,
    tool_usage,
)
from ..session import materialize, sequential_ids, shared_folder
from .corpora import table
from .registry import query

# One run per turn: its lines alternate between a call and its result.
_USAGE = """WITH lines AS (
    SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM conversations),
  usage AS (SELECT conv_id || '-' || turn AS session, idx % 4 // 2 + 1 AS iteration, idx,
    CASE WHEN idx % 2 = 0 THEN 'tool_call' ELSE 'tool_result' END AS type,
    CASE WHEN idx % 2 = 0 THEN role || '_' || length(line) % 5 END AS tool_name,
    'call_' || idx // 2 AS call_id,
    CASE WHEN idx % 2 = 1 THEN line END AS content FROM lines)"""


def _write_run_logs(spark, folder) -> str:
    """Write every turn as a nested run log; nothing is grouped."""

    def record(line, i):
        call = i % 2 == 0
        ident = F.concat(F.lit("call_"), F.floor(i / 2).cast("string"))
        return F.struct(
            F.lit("2025-01-01T00:00:00.5").alias("timestamp"),
            F.when(call, "tool_call").otherwise("tool_result").alias("type"),
            F.when(
                call,
                F.concat("role", F.lit("_"), (F.char_length(line) % 5).cast("string")),
            ).alias("tool_name"),
            F.when(call, ident).alias("tool_id"),
            F.when(call, F.struct(F.char_length(line).alias("size"))).alias("arguments"),
            F.when(~call, ident).alias("tool_call_id"),
            F.when(~call, line).alias("content"),
            i.alias("line"),
        )

    records = F.transform(F.split("text", "\n"), record)

    def iteration(n: int):
        own = F.filter("records", lambda r: F.floor(r["line"] % 4 / 2) + 1 == n)
        return F.struct(
            F.lit(n).alias("iteration"), F.lit(1.5).alias("duration"), own.alias("tool_usage")
        )

    runs = (
        table(spark, folder, "conversations")
        .withColumn("records", records)
        .select(
            F.concat(
                F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")
            ).alias("start_time"),
            F.array(iteration(1), iteration(2)).alias("iterations"),
            F.struct(F.col("turn").alias("insights_discovered")).alias("final_state"),
            F.col("role").alias("termination_reason"),
            (F.col("role") == "user").alias("success"),
            F.char_length("text").cast("double").alias("total_duration"),
        )
    )
    path = shared_folder(spark)
    runs.write.json(path)
    return path


def _run_logs(spark, folder):
    """Run logs read back, many JSON documents in a file, one per line."""
    return materialize(read_run_logs(spark, _write_run_logs(spark, folder), multiline=False))


def _of_sessions(rows, runs):
    """``rows`` with the session whose run they are of."""
    sessions = runs.select("run_id", F.col("start_time").alias("session"))
    return rows.join(sessions, "run_id")


@query(
    "src_run_log",
    """SELECT conv_id || '-' || turn AS start_time, CAST(2 AS INTEGER) AS iterations,
      role AS termination_reason, role = 'user' AS success,
      CAST(length(text) AS DOUBLE) AS total_duration FROM conversations""",
)
def run_logs(spark, folder):
    rows = read_run_logs(spark, _write_run_logs(spark, folder), multiline=False)
    return rows.select(
        "start_time",
        F.size("iterations").alias("iterations"),
        "termination_reason",
        "success",
        "total_duration",
    )


@query(
    "tool_usage_flatten",
    f"""{_USAGE} SELECT session, CAST(iteration AS BIGINT) AS iteration, type, tool_name, call_id,
      content, count(*) AS n FROM usage GROUP BY ALL""",
)
def flattened(spark, folder):
    runs = _run_logs(spark, folder)
    usage = _of_sessions(tool_usage(runs), runs)
    return usage.groupBy(
        "session", "iteration", "type", "tool_name", "call_id", "content"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tool_call_results",
    f"""{_USAGE} SELECT c.session, c.call_id, c.tool_name, r.content,
      CASE WHEN length(r.content) > 200 THEN left(r.content, 200) || '...' ELSE r.content END
        AS preview
    FROM usage c LEFT JOIN usage r ON c.session = r.session AND c.call_id = r.call_id
      AND r.type = 'tool_result' WHERE c.type = 'tool_call'""",
)
def results(spark, folder):
    runs = _run_logs(spark, folder)
    rows = _of_sessions(call_results(tool_usage(runs)), runs)
    return rows.select(
        "session", "call_id", "tool_name", "content", "preview"
    )


_CALLS = f"""{_USAGE} SELECT tool_name, count(*) AS calls,
    CAST(grouping(tool_name) AS INTEGER) AS is_total FROM usage WHERE type = 'tool_call'
    GROUP BY ROLLUP (tool_name)"""


@query("tool_call_counts", _CALLS)
def call_counts(spark, folder):
    return tool_call_counts(tool_usage(_run_logs(spark, folder))).withColumn(
        "is_total", F.col("is_total").cast("int")
    )


@query(
    "sort_tools",
    f"""{_USAGE}, counts AS (SELECT tool_name, count(*) AS calls FROM usage
      WHERE type = 'tool_call' GROUP BY tool_name)
    SELECT tool_name, calls, row_number() OVER (ORDER BY tool_name) AS place FROM counts""",
)
def sorted_tools(spark, folder):
    usage = tool_usage(_run_logs(spark, folder)).filter("type = 'tool_call'")
    counts = usage.groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))
    placed = sequential_ids(counts, ["tool_name"], "place")
    return placed.withColumn("place", F.col("place") + 1)


@query(
    "run_summary",
    """SELECT conv_id || '-' || turn AS run_id, CAST(length(text) AS DOUBLE) AS total_duration,
      CAST(2 AS INTEGER) AS total_iterations, role AS termination_reason,
      role = 'user' AS success, turn AS insights_discovered,
      CAST(0 AS BIGINT) AS clusters_analyzed FROM conversations""",
)
def summaries(spark, folder):
    return run_summary(_run_logs(spark, folder)).select(
        F.col("start_time").alias("run_id"),
        "total_duration",
        "total_iterations",
        "termination_reason",
        "success",
        "insights_discovered",
        "clusters_analyzed",
    )


@query(
    "insight_streak",
    """WITH f AS (SELECT conv_id, turn, row_number() OVER w AS n,
        contains(lower(text), 'cluster') AS cluster,
        regexp_matches(lower(text), 'insight|pattern|discovered|found|entity|relation') AS insight
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT conv_id, turn, n, CAST(sum(CAST(cluster AS INTEGER)) OVER w AS BIGINT)
        AS clusters_analyzed, CAST(sum(CAST(insight AS INTEGER)) OVER w AS BIGINT)
        AS insights_discovered,
        n - coalesce(max(CASE WHEN insight THEN n END) OVER w, 0) AS consecutive_no_insights
      FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, clusters_analyzed, insights_discovered, consecutive_no_insights,
      clusters_analyzed >= 5 AND insights_discovered > 0 AND consecutive_no_insights >= 3
        AS saturated FROM r""",
)
def streaks(spark, folder):
    return insight_streak(table(spark, folder, "conversations")).drop(
        "entities_created", "relations_created"
    )


@query(
    "insight_streak_documents",
    """WITH f AS (SELECT source, doc_id, row_number() OVER w AS n,
        contains(lower(text), 'cluster') AS cluster,
        regexp_matches(lower(text), 'insight|pattern|discovered|found|entity|relation') AS insight
      FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    r AS (SELECT source, doc_id, n, CAST(sum(CAST(cluster AS INTEGER)) OVER w AS BIGINT)
        AS clusters_analyzed, CAST(sum(CAST(insight AS INTEGER)) OVER w AS BIGINT)
        AS insights_discovered,
        n - coalesce(max(CASE WHEN insight THEN n END) OVER w, 0) AS consecutive_no_insights
      FROM f WINDOW w AS (PARTITION BY source ORDER BY doc_id))
    SELECT source, doc_id, clusters_analyzed, insights_discovered, consecutive_no_insights,
      clusters_analyzed >= 2 AND insights_discovered > 0 AND consecutive_no_insights >= 3
        AS saturated FROM r""",
)
def document_streaks(spark, folder):
    """The same over document sources, cut into chunks of few rows."""
    docs = table(spark, folder, "documents").select("source", "doc_id", "text")
    return insight_streak(docs, "source", "doc_id", min_clusters=2, chunk=50).drop(
        "entities_created", "relations_created"
    )


@query(
    "stop_reasons",
    """WITH s AS (SELECT conv_id, turn, turn * 9 AS iterations, turn AS clusters,
        length(text) % 5 AS insights, turn % 4 AS quiet, length(text) % 8 AS errors
      FROM conversations)
    SELECT conv_id, turn, CASE WHEN iterations >= 50 THEN 'Maximum iteration limit reached'
      WHEN clusters >= 5 AND insights > 0 AND quiet >= 3
        THEN 'No new insights discovered in recent iterations'
      WHEN errors >= 5 THEN 'Too many consecutive errors encountered' END AS reason FROM s""",
)
def stop_reasons(spark, folder):
    """The stop rules over states taken from the turns."""
    turn, size = F.col("turn"), F.char_length("text")
    reason = stop_reason(turn * 9, turn, size % 5, turn % 4, size % 8)
    return table(spark, folder, "conversations").select("conv_id", "turn", reason.alias("reason"))
