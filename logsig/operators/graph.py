"""Knowledge graph in tables: entities, their observations, their relations.

Observations are rows of their own, so one entity with very many of them is
spread over tasks like everything else, and adding or removing one touches no
long list. ``with_observations`` gives the one-row-per-entity view back.

Every mutation maps tables to tables; the caller writes the result to a new
version. The batch of a mutation carries ``ord``, the order it was given in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, materialize

TRIPLE = ["source", "target", "relationType"]
_NOT_TOKEN = r"[^\p{L}\p{N}_]+"


@dataclass(frozen=True)
class Graph:
    """``entities(name, type, labels)``, ``observations(name, batch, ord, idx, text)``
    and ``relations(source, target, relationType)``."""

    entities: DataFrame
    observations: DataFrame
    relations: DataFrame


def graph_from_lists(entities: DataFrame, relations: DataFrame) -> Graph:
    """Tables from ``entities(name, type, observations array<string>)``."""
    listed = entities.select(
        "name",
        F.lit(0).cast("bigint").alias("batch"),
        F.lit(0).cast("bigint").alias("ord"),
        F.posexplode("observations").alias("idx", "text"),
    )
    nodes = entities.select("name", "type", F.array("type").alias("labels"))
    return Graph(nodes, listed, relations.select(*TRIPLE).dropDuplicates(TRIPLE))


def with_observations(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per entity with its observations as an ordered list."""
    rows = F.array_sort(F.collect_list(F.struct("batch", "ord", "idx", "text")))
    lists = observations.groupBy("name").agg(
        F.transform(rows, lambda r: r["text"]).alias("observations")
    )
    empty = F.array().cast("array<string>")
    return entities.join(lists, "name", "left").withColumn(
        "observations", F.coalesce("observations", empty)
    )


def valid_entities(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("name").isNotNull() & (F.col("name") != ""))


def valid_relations(relations: DataFrame) -> DataFrame:
    return relations.filter(F.col("relationType").isNotNull() & (F.col("relationType") != ""))


def _names(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("name")).distinct()


def _known(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Those of a batch's names that are entities; the big table is not shuffled
    when the batch is small."""
    return entities.select("name").join(broadcast_if_bounded(names), "name", "left_semi")


# ---- reads ------------------------------------------------------------------


def touching(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations with either end among the (distinct) names."""
    ends = broadcast_if_bounded(names.select("name"))
    marked = relations.join(
        ends.select(F.col("name").alias("_s")), F.col("source") == F.col("_s"), "left"
    ).join(ends.select(F.col("name").alias("_t")), F.col("target") == F.col("_t"), "left")
    return marked.filter(F.col("_s").isNotNull() | F.col("_t").isNotNull()).select(*TRIPLE)


def graph_read(graph: Graph) -> Graph:
    return Graph(
        valid_entities(graph.entities), graph.observations, valid_relations(graph.relations)
    )


def graph_neighbourhood(graph: Graph, hits: DataFrame) -> Graph:
    """The hit entities, their observations and every relation touching them."""
    names = broadcast_if_bounded(_names(hits, "name"))
    return graph_read(
        Graph(
            graph.entities.join(names, "name", "left_semi"),
            graph.observations.join(names, "name", "left_semi"),
            touching(graph.relations, names).distinct(),
        )
    )


def query_terms(query: str) -> tuple[list[str], list[str]]:
    """Whole words and word beginnings of a query, taken apart like the text.

    A star at the end of a word asks for its beginning; of a word with punctuation in
    it, that of its last part.
    """
    words, prefixes = [], []
    for given in query.lower().split():
        parts = [p for p in re.split(r"[^\w]+", given.rstrip("*")) if p]
        if parts and given.endswith("*"):
            prefixes.append(parts.pop())
        words += parts
    return words, prefixes


def matches_query(text: Column, query: str) -> Column:
    """Does the text hold any of the query's words? ``word*`` matches prefixes."""
    if query.strip() == "*":
        return F.lit(True)
    tokens = F.split(F.lower(text), _NOT_TOKEN)
    words, prefixes = query_terms(query)
    hit = F.lit(False)
    if prefixes:

        def starts(token: Column) -> Column:
            return reduce(or_, [F.startswith(token, F.lit(p)) for p in prefixes])

        hit = F.exists(tokens, starts)
    if words:
        hit = hit | F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    return hit


def search_hits(graph: Graph, query: str) -> DataFrame:
    """Names of entities whose name, type or any observation matches."""
    own = graph.entities.filter(matches_query(F.concat_ws(" ", "name", "type"), query))
    noted = graph.observations.filter(matches_query(F.col("text"), query))
    return own.select("name").union(noted.select("name")).distinct()


def graph_search(graph: Graph, query: str) -> Graph:
    """Hits of a word search and the relations touching them."""
    return graph_neighbourhood(graph, search_hits(graph, query))


def text_index(graph: Graph) -> DataFrame:
    """Inverted table ``(token, name)`` for repeated searches over a big graph."""
    words = graph.entities.select("name", F.concat_ws(" ", "name", "type").alias("text")).union(
        graph.observations.select("name", "text")
    )
    tokens = words.select(F.explode(F.split(F.lower("text"), _NOT_TOKEN)).alias("token"), "name")
    return tokens.filter(F.col("token") != "").distinct()


def index_hits(index: DataFrame, query: str) -> DataFrame:
    """Names the inverted table gives for a query."""
    hit = F.lit(query.strip() == "*")
    words, prefixes = query_terms(query)
    for prefix in prefixes:
        hit = hit | F.startswith(F.col("token"), F.lit(prefix))
    for word in words:
        hit = hit | (F.col("token") == word)
    return index.filter(hit).select("name").distinct()


def graph_find(graph: Graph, names: Iterable[str] | DataFrame) -> Graph:
    """Entities by exact name and the relations touching any of the names.

    No relations are given when none of the names is an entity.
    """
    if not isinstance(names, DataFrame):
        spark = graph.entities.sparkSession
        names = spark.createDataFrame([(n,) for n in names], "name string")
    names = broadcast_if_bounded(names.select("name").distinct())
    found = graph.entities.join(names, "name", "left_semi")
    relations = touching(graph.relations, names)
    if found.isEmpty():
        relations = relations.limit(0)
    return Graph(found, graph.observations.join(names, "name", "left_semi"), relations)


# ---- mutations --------------------------------------------------------------


def _next_batch(observations: DataFrame) -> Column:
    """A number that orders new observations behind all present ones."""
    last = observations.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    return F.lit(last + 1).cast("bigint").alias("batch")


def entities_upsert(graph: Graph, batch: DataFrame) -> Graph:
    """Merge ``(name, type, observations, ord)``: the last row of a name wins.

    Type and observations are replaced, labels only grow.
    """
    latest = batch.groupBy("name").agg(
        F.max_by(F.struct("type", "observations", "ord"), "ord").alias("new"),
        F.array_sort(F.collect_set("type")).alias("new_labels"),
    )
    latest = materialize(latest)
    small = broadcast_if_bounded(latest, stored=True)
    none = F.array().cast("array<string>")
    merged = graph.entities.join(small, "name", "left").select(
        "name",
        F.coalesce("new.type", "type").alias("type"),
        F.array_union(F.coalesce("labels", none), F.coalesce("new_labels", none)).alias("labels"),
    )
    # The names that are no entities yet are found on the batch's side alone.
    present = broadcast_if_bounded(_known(graph.entities, latest.select("name")))
    added = latest.join(present, "name", "left_anti").select(
        "name", F.col("new.type").alias("type"), F.array_distinct("new_labels").alias("labels")
    )
    entities = merged.unionByName(added)
    names = broadcast_if_bounded(batch.select("name").distinct())
    kept = graph.observations.join(names, "name", "left_anti")
    fresh = latest.select(
        "name",
        _next_batch(graph.observations),
        F.col("new.ord").alias("ord"),
        F.posexplode("new.observations").alias("idx", "text"),
    )
    return Graph(entities, kept.unionByName(fresh), graph.relations)


def relations_upsert(graph: Graph, batch: DataFrame) -> Graph:
    """Add relations whose two ends exist and that are not there yet."""
    wanted = batch.select(*TRIPLE).distinct()
    ends = wanted.select(F.col("source").alias("name")).union(
        wanted.select(F.col("target").alias("name"))
    )
    known = broadcast_if_bounded(_known(graph.entities, ends.distinct()))
    valid = wanted.join(
        known.withColumnRenamed("name", "source"), "source", "left_semi"
    ).join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    present = graph.relations.join(broadcast_if_bounded(wanted), TRIPLE, "left_semi")
    fresh = valid.select(*TRIPLE).join(present, TRIPLE, "left_anti")
    return Graph(graph.entities, graph.observations, graph.relations.unionByName(fresh))


def observations_add(graph: Graph, batch: DataFrame) -> tuple[Graph, DataFrame]:
    """Append ``(entityName, observations, ord)`` not yet present before the batch.

    Also returns ``(ord, entityName, addedObservations)`` for existing entities.
    """
    known = broadcast_if_bounded(_known(graph.entities, _names(batch, "entityName")))
    asked = batch.withColumnRenamed("entityName", "name").join(known, "name", "left_semi")
    given = asked.select("name", "ord", F.posexplode("observations").alias("idx", "text"))
    keys = broadcast_if_bounded(given.select("name", "text").distinct())
    present = graph.observations.join(keys, ["name", "text"], "left_semi")
    fresh = given.join(present.select("name", "text"), ["name", "text"], "left_anti")
    added = fresh.select(
        "name",
        _next_batch(graph.observations),
        F.col("ord").cast("bigint").alias("ord"),
        "idx",
        "text",
    )
    listed = F.array_sort(F.collect_list(F.struct("idx", "text")))
    # A row of the batch is one group here, no larger than the list it came with.
    per_row = fresh.groupBy("ord").agg(F.transform(listed, lambda r: r["text"]).alias("added"))
    result = asked.join(per_row, "ord", "left").select(
        "ord",
        F.col("name").alias("entityName"),
        F.coalesce("added", F.array().cast("array<string>")).alias("addedObservations"),
    )
    return (
        Graph(graph.entities, graph.observations.unionByName(added), graph.relations),
        result,
    )


def list_except(items: Column, others: Column) -> Column:
    """A list without the entries of another; order and repeats stay, nulls go."""
    return F.filter(items, lambda x: ~F.array_contains(others, x))


def observations_delete(graph: Graph, batch: DataFrame) -> Graph:
    """Remove the listed observations; unknown names and texts are ignored."""
    listed = batch.select(
        F.col("entityName").alias("name"), F.explode("observations").alias("text")
    ).distinct()
    kept = graph.observations.join(broadcast_if_bounded(listed), ["name", "text"], "left_anti")
    return Graph(graph.entities, kept.select(*graph.observations.columns), graph.relations)


def entities_delete(graph: Graph, names: DataFrame) -> Graph:
    """Remove entities with their observations and relations."""
    gone = broadcast_if_bounded(names.select("name").distinct())
    relations = graph.relations.join(
        gone.withColumnRenamed("name", "source"), "source", "left_anti"
    ).join(gone.withColumnRenamed("name", "target"), "target", "left_anti")
    return Graph(
        graph.entities.join(gone, "name", "left_anti"),
        graph.observations.join(gone, "name", "left_anti"),
        relations.select(*TRIPLE),
    )


def relations_delete(graph: Graph, batch: DataFrame) -> Graph:
    """Remove exact triples."""
    gone = broadcast_if_bounded(batch.select(*TRIPLE).distinct())
    kept = graph.relations.join(gone, TRIPLE, "left_anti").select(*TRIPLE)
    return Graph(graph.entities, graph.observations, kept)
