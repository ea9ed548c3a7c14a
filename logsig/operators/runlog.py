"""Analytics over the nested run logs an analysis agent leaves behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keyword_flags, text_preview
from ..sources.logs import line_position

_USAGE = (
    "struct<timestamp:string,type:string,tool_name:string,tool_id:string,arguments:string,"
    "tool_call_id:string,content:string>"
)
_STATE = (
    "struct<iteration_count:bigint,clusters_analyzed:bigint,insights_discovered:bigint,"
    "entities_created:bigint,relations_created:bigint,consecutive_no_insights:bigint,"
    "consecutive_errors:bigint,last_termination_check:bigint,start_time:string>"
)
RUN_LOG_SCHEMA = (
    "start_time string, iterations array<struct<iteration:bigint,timestamp:string,"
    f"duration:double,response_summary:string,tool_usage:array<{_USAGE}>,agent_state:{_STATE}>>, "
    f"final_state {_STATE}, termination_reason string, success boolean, end_time string, "
    "total_duration double, error string"
)

# The words that count as progress, and when progress has ended.
PROGRESS_WORDS = {
    "cluster": ["cluster"],
    "insight": ["insight", "pattern", "discovered", "found", "entity", "relation"],
    "entities": ["create_entities"],
    "relations": ["create_relations"],
}
MIN_CLUSTERS = 5
PATIENCE = 3
MAX_ITERATIONS = 50
MAX_ERRORS = 5
STOP_REASONS = {
    "iterations": "Maximum iteration limit reached",
    "saturation": "No new insights discovered in recent iterations",
    "errors": "Too many consecutive errors encountered",
}
SUMMARY_LENGTH = 200
# Turns of one conversation that one task may have to put in order.
CHUNK_TURNS = 100_000


def read_run_logs(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per run; tool arguments stay JSON text as they have no fixed shape.

    ``multiline`` reads one document per file, else one per line. A run is named by its
    file's path and its place in it, so runs of one file or of files with one name differ.
    """
    raw = spark.read.schema(RUN_LOG_SCHEMA).json(path, multiLine=multiline)
    place = line_position().cast("string")
    return raw.select(F.concat_ws("#", "_metadata.file_path", place).alias("run_id"), "*")


def tool_usage(run_log: DataFrame) -> DataFrame:
    """Calls and results, one row each, in the order they were logged."""
    steps = run_log.select("run_id", F.explode("iterations").alias("step"))
    records = steps.select(
        "run_id", "step.iteration", F.posexplode("step.tool_usage").alias("idx", "record")
    )
    return records.select(
        "run_id",
        "iteration",
        "idx",
        F.to_timestamp("record.timestamp").alias("timestamp"),
        "record.type",
        "record.tool_name",
        F.coalesce("record.tool_id", "record.tool_call_id").alias("call_id"),
        "record.arguments",
        "record.content",
    )


def call_results(usage: DataFrame) -> DataFrame:
    """Every call with its result, if one was logged."""
    calls = usage.filter(F.col("type") == "tool_call").drop("type", "content")
    results = usage.filter(F.col("type") == "tool_result").select(
        "run_id",
        "call_id",
        F.col("timestamp").alias("result_timestamp"),
        "content",
        text_preview(F.col("content"), SUMMARY_LENGTH).alias("preview"),
    )
    return calls.join(results, ["run_id", "call_id"], "left")


def tool_call_counts(usage: DataFrame) -> DataFrame:
    """Calls per tool in name order; the row without a name is the total."""
    calls = usage.filter(F.col("type") == "tool_call")
    return (
        calls.rollup("tool_name")
        .agg(F.count(F.lit(1)).alias("calls"), F.grouping("tool_name").alias("is_total"))
        .orderBy("is_total", "tool_name")
    )


def run_summary(run_log: DataFrame) -> DataFrame:
    """One row per run: times, iterations, why it ended, final counters."""

    def counter(name: str):
        return F.coalesce(F.col(f"final_state.{name}"), F.lit(0)).alias(name)

    return run_log.select(
        "run_id",
        "start_time",
        "end_time",
        F.coalesce("total_duration", F.lit(0.0)).alias("total_duration"),
        F.coalesce(F.size("iterations"), F.lit(0)).alias("total_iterations"),
        "termination_reason",
        F.coalesce("success", F.lit(False)).alias("success"),
        counter("clusters_analyzed"),
        counter("insights_discovered"),
        counter("entities_created"),
        counter("relations_created"),
        "error",
    )


def stop_reason(
    iterations: Column,
    clusters: Column,
    insights: Column,
    quiet: Column,
    errors: Column,
    max_iterations: int = MAX_ITERATIONS,
    min_clusters: int = MIN_CLUSTERS,
    patience: int = PATIENCE,
    max_errors: int = MAX_ERRORS,
) -> Column:
    """Why a run must stop at a state, null if it may go on: the iteration limit comes first,
    then saturation, then errors. Missing counters count as zero."""
    n = lambda c: F.coalesce(c, F.lit(0))
    saturated = (n(clusters) >= min_clusters) & (n(insights) > 0) & (n(quiet) >= patience)
    return (
        F.when(n(iterations) >= max_iterations, STOP_REASONS["iterations"])
        .when(saturated, STOP_REASONS["saturation"])
        .when(n(errors) >= max_errors, STOP_REASONS["errors"])
    )


def insight_streak(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    text: str = "text",
    min_clusters: int = MIN_CLUSTERS,
    patience: int = PATIENCE,
    chunk: int = CHUNK_TURNS,
) -> DataFrame:
    """Running progress counters, the current run of turns without an insight, and
    whether the agent may stop there.

    Long conversations are cut into chunks of consecutive turns: counters run
    inside a chunk, and each chunk starts from the totals of those before it.
    """
    flags = turns.select(key, order, *keyword_flags(F.col(text), PROGRESS_WORDS)).withColumn(
        "_chunk", F.floor(F.col(order) / chunk)
    )
    names: Sequence[str] = list(PROGRESS_WORDS)
    run = Window.partitionBy(key, "_chunk").orderBy(order)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = flags.withColumn("_n", F.row_number().over(run)).select(
        "*",
        *[F.sum(F.col(c).cast("bigint")).over(so_far).alias(f"_{c}") for c in names],
        F.max(F.when(F.col("insight"), F.col("_n"))).over(so_far).alias("_last"),
    )
    ends = counted.groupBy(key, "_chunk").agg(
        F.max("_n").alias("_n"),
        F.max("_last").alias("_last"),
        *[F.max(f"_{c}").alias(f"_{c}") for c in names],
    )
    before = (
        Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = ends.select(
        key,
        "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        "_last",
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}0") for c in names],
    ).withColumn("_last0", F.max(F.col("_n0") + F.col("_last")).over(before)).drop("_last")
    whole = counted.join(shifts, [key, "_chunk"])
    last = F.coalesce(F.col("_n0") + F.col("_last"), F.col("_last0"), F.lit(0))
    totals = {c: F.col(f"_{c}") + F.col(f"_{c}0") for c in names}
    result = whole.select(
        key,
        order,
        totals["cluster"].alias("clusters_analyzed"),
        totals["insight"].alias("insights_discovered"),
        totals["entities"].alias("entities_created"),
        totals["relations"].alias("relations_created"),
        (F.col("_n0") + F.col("_n") - last).alias("consecutive_no_insights"),
    )
    return result.withColumn(
        "saturated",
        (F.col("clusters_analyzed") >= min_clusters)
        & (F.col("insights_discovered") > 0)
        & (F.col("consecutive_no_insights") >= patience),
    )
