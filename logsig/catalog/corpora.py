"""Lines, vectors and graphs read from, or derived from, the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strip
from ..operators.graph import Graph, graph_from_lists
from ..session import spread
from ..sources import annotate

LINES_PER_TEXT = 1 << 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _split(rows: DataFrame, key: str, text: str, separator: str, ranges: int = 0) -> DataFrame:
    """Non-blank stripped parts of a text column with their position; in so many ranges of it,
    if asked."""
    dealt = rows.repartitionByRange(ranges, key) if ranges else spread(rows)
    parts = dealt.select("*", F.posexplode(F.split(text, separator)).alias("n", "line")).drop(text)
    return parts.select(
        (F.col(key) * LINES_PER_TEXT + F.col("n")).alias("pos"),
        "*",
        strip(F.col("line")).alias("raw_log"),
    ).drop("n", "line").filter(F.col("raw_log") != "")


def doc_lines(spark: SparkSession, folder: str, ranges: int = 0) -> DataFrame:
    """Document lines; the source stands in for a cluster label."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    return _split(docs, "doc_id", "text", "\n", ranges).withColumn(
        "cluster", F.substring("source", 4, 9).cast("int")
    )


def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Page paragraphs, rich in quotes and angle brackets."""
    return _split(table(spark, folder, "pages").select("page_id", "html"), "page_id", "html", "</p>")


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events written out the way a service would log them."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    return spread(table(spark, folder, "events")).select(
        F.col("event_id").alias("pos"),
        "event_type",
        F.concat(
            F.lit("["),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit("] "),
            F.col("event_type"),
            F.lit(": user="),
            F.col("user_id").cast("string"),
            F.lit(" value="),
            cents.cast("string"),
            F.lit(" "),
            F.col("props"),
        ).alias("raw_log"),
    )


def clustered_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The clustered-log table of the document lines."""
    return annotate(doc_lines(spark, folder)).select("pos", "cluster", "raw_log", "pattern")


def labelled_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines as training rows; the first source plays the outliers."""
    return clustered_docs(spark, folder).select(
        "pos",
        "raw_log",
        "pattern",
        F.when(F.col("cluster") == 0, F.lit(-1)).otherwise(F.col("cluster")).alias("cluster_id"),
    )


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"), "label"
    )


def business_graph(spark: SparkSession, folder: str) -> Graph:
    """Suppliers and customers in nations in regions."""

    def cents(column: str):
        return F.concat(
            F.lit("balance "), F.round(F.col(column) * 100).cast("bigint").cast("string")
        )

    def parties(name: str, prefix: str, kind: str, *observations) -> DataFrame:
        return table(spark, folder, name).select(
            F.col(f"{prefix}_name").alias("name"),
            F.lit(kind).alias("type"),
            F.array(*observations).cast("array<string>").alias("observations"),
        )

    entities = (
        parties("supplier", "s", "Supplier", cents("s_acctbal"), F.lit("ships goods"))
        .unionByName(
            parties("customer", "c", "Customer", F.col("c_mktsegment"), cents("c_acctbal"))
        )
        .unionByName(parties("nation", "n", "Nation"))
        .unionByName(parties("region", "r", "Region"))
    )
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")

    def located(name: str, prefix: str) -> DataFrame:
        rows = table(spark, folder, name)
        return rows.join(nations, rows[f"{prefix}_nationkey"] == nations["n_nationkey"]).select(
            F.col(f"{prefix}_name").alias("source"),
            F.col("n_name").alias("target"),
            F.lit("LOCATED_IN").alias("relationType"),
        )

    part_of = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(
        F.col("n_name").alias("source"),
        F.col("r_name").alias("target"),
        F.lit("PART_OF").alias("relationType"),
    )
    relations = located("supplier", "s").union(located("customer", "c")).union(part_of)
    return graph_from_lists(entities, relations)
