"""Knowledge-graph operators over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import (
    Graph,
    entities_delete,
    entities_upsert,
    graph_find,
    graph_neighbourhood,
    graph_read,
    graph_search,
    index_hits,
    list_except,
    observations_add,
    observations_delete,
    relations_delete,
    relations_upsert,
    text_index,
    touching,
    valid_entities,
    valid_relations,
    with_observations,
)
from .corpora import business_graph, table
from .registry import query

_GRAPH = """WITH entities AS MATERIALIZED (
    SELECT s_name AS name, 'Supplier' AS type,
      ['balance ' || CAST(round(s_acctbal * 100) AS BIGINT), 'ships goods'] AS observations
    FROM supplier
    UNION ALL SELECT c_name, 'Customer',
      [c_mktsegment, 'balance ' || CAST(round(c_acctbal * 100) AS BIGINT)] FROM customer
    UNION ALL SELECT n_name, 'Nation', CAST([] AS VARCHAR[]) FROM nation
    UNION ALL SELECT r_name, 'Region', CAST([] AS VARCHAR[]) FROM region),
  relations AS MATERIALIZED (
    SELECT s_name AS source, n_name AS target, 'LOCATED_IN' AS "relationType"
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION SELECT c_name, n_name, 'LOCATED_IN' FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION SELECT n_name, r_name, 'PART_OF' FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _rows(entities: str, relations: str) -> str:
    """Entities and relations as one table of four text columns."""
    return f"""SELECT 'entity' AS kind, name AS a, type AS b,
        coalesce(array_to_string(observations, '|'), '') AS c FROM {entities}
      UNION ALL SELECT 'relation', source, target, "relationType" FROM {relations}"""


def _as_rows(graph: Graph):
    entities = with_observations(graph.entities, graph.observations).select(
        F.lit("entity").alias("kind"),
        F.col("name").alias("a"),
        F.col("type").alias("b"),
        F.array_join("observations", "|").alias("c"),
    )
    return entities.union(graph.relations.select(F.lit("relation"), "source", "target", "relationType"))


def _touching(names: str) -> str:
    return (
        f"SELECT DISTINCT * FROM relations WHERE source IN (SELECT name FROM {names}) "
        f"OR target IN (SELECT name FROM {names})"
    )


@query("graph_read", f"{_GRAPH} {_rows('entities', 'relations')}")
def read_all(spark, folder):
    return _as_rows(graph_read(business_graph(spark, folder)))


_NATIONS = "hits AS (SELECT * FROM entities WHERE name IN ('NATION_3', 'NATION_7', 'Atlantis'))"


@query(
    "filter_names_in",
    f"{_GRAPH}, {_NATIONS} {_touching('hits')}",
)
def names_in(spark, folder):
    names = spark.createDataFrame([("NATION_3",), ("NATION_7",), ("Atlantis",)], "name string")
    return touching(business_graph(spark, folder).relations, names)


@query(
    "filter_null_names",
    f"""{_GRAPH}, e AS (SELECT nullif(name, 'NATION_0') AS name, type, observations FROM entities),
    r AS (SELECT source, target, CASE WHEN "relationType" = 'PART_OF' THEN '' ELSE "relationType"
          END AS "relationType" FROM relations)
    SELECT 'entity' AS kind, count(*) AS n FROM e WHERE name <> ''
    UNION ALL SELECT 'relation', count(*) FROM r WHERE "relationType" <> ''""",
)
def null_names(spark, folder):
    graph = business_graph(spark, folder)
    entities = graph.entities.withColumn("name", F.nullif("name", F.lit("NATION_0")))
    relations = graph.relations.withColumn(
        "relationType",
        F.when(F.col("relationType") == "PART_OF", "").otherwise(F.col("relationType")),
    )

    def counted(kind, rows):
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")

    return counted("entity", valid_entities(entities)).union(
        counted("relation", valid_relations(relations))
    )


@query(
    "graph_neighbourhood",
    f"""{_GRAPH}, hits AS (SELECT * FROM entities WHERE type = 'Region'),
    around AS ({_touching('hits')}) {_rows('hits', 'around')}""",
)
def neighbourhood(spark, folder):
    graph = business_graph(spark, folder)
    return _as_rows(graph_neighbourhood(graph, graph.entities.filter("type = 'Region'")))


_TOKENS = """regexp_split_to_array(lower(concat_ws(' ', name, type,
  array_to_string(observations, ' '))), '[^\\p{L}\\p{N}_]+')"""


@query(
    "graph_search",
    f"""{_GRAPH}, hits AS (SELECT * FROM entities
      WHERE list_has_any({_TOKENS}, ['building', 'region'])
        OR len(list_filter({_TOKENS}, lambda t: starts_with(t, 'mach'))) > 0),
    around AS ({_touching('hits')}) {_rows('hits', 'around')}""",
)
def search(spark, folder):
    return _as_rows(graph_search(business_graph(spark, folder), "Building mach* REGION"))


@query(
    "graph_search_index",
    f"""{_GRAPH} SELECT name FROM entities
    WHERE list_has_any({_TOKENS}, ['supplier', 'asia', 'furniture'])""",
)
def indexed_search(spark, folder):
    return index_hits(text_index(business_graph(spark, folder)), "supplier Asia FURNITURE")


_PUNCTUATED_QUERY = "#000000007 ships, NATION_3 (goods-Furn*"


@query(
    "graph_search_punctuated",
    f"""{_GRAPH}, hits AS MATERIALIZED (SELECT * FROM entities
      WHERE list_has_any({_TOKENS}, ['000000007', 'ships', 'nation_3', 'goods'])
        OR len(list_filter({_TOKENS}, lambda t: starts_with(t, 'furn'))) > 0),
    around AS ({_touching('hits')}) {_rows('hits', 'around')}""",
)
def punctuated_search(spark, folder):
    """A query is taken apart like the text, whatever marks its words carry."""
    return _as_rows(graph_search(business_graph(spark, folder), _PUNCTUATED_QUERY))


@query(
    "graph_search_index_punctuated",
    f"""{_GRAPH} SELECT name FROM entities
    WHERE list_has_any({_TOKENS}, ['000000007', 'ships', 'nation_3', 'goods'])
      OR len(list_filter({_TOKENS}, lambda t: starts_with(t, 'furn'))) > 0""",
)
def punctuated_index_search(spark, folder):
    return index_hits(text_index(business_graph(spark, folder)), _PUNCTUATED_QUERY)


@query(
    "graph_find",
    f"{_GRAPH}, {_NATIONS}, around AS ({_touching('hits')}) {_rows('hits', 'around')}",
)
def find(spark, folder):
    return _as_rows(graph_find(business_graph(spark, folder), ["NATION_3", "NATION_7", "Atlantis"]))


# Every order renames its customer's record; the last order of a customer wins.
_UPSERTS = """batch AS MATERIALIZED (
    SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name,
      CASE WHEN o_orderkey % 3 = 0 THEN 'Buyer' ELSE 'Customer' END AS type,
      ['ordered ' || o_orderkey, 'status ' || o_orderstatus] AS observations,
      o_orderkey AS ord FROM orders)"""


def _upserts(spark, folder):
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.concat(
            F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")
        ).alias("name"),
        F.when(key % 3 == 0, "Buyer").otherwise("Customer").alias("type"),
        F.array(
            F.concat(F.lit("ordered "), key.cast("string")),
            F.concat(F.lit("status "), F.col("o_orderstatus")),
        ).alias("observations"),
        key.cast("bigint").alias("ord"),
    )


@query(
    "entities_upsert",
    f"""{_GRAPH}, {_UPSERTS}, latest AS (SELECT name, arg_max(type, ord) AS type,
      arg_max(observations, ord) AS observations,
      list_sort(list(DISTINCT type)) AS labels FROM batch GROUP BY name)
    SELECT name, coalesce(n.type, e.type) AS type,
      array_to_string(coalesce(n.observations, e.observations), '|') AS observations,
      array_to_string(list_concat(CASE WHEN e.type IS NULL THEN [] ELSE [e.type] END,
        list_filter(coalesce(n.labels, []), lambda l: e.type IS NULL OR l <> e.type)), '|')
        AS labels
    FROM entities e FULL JOIN latest n USING (name)""",
)
def upsert(spark, folder):
    graph = entities_upsert(business_graph(spark, folder), _upserts(spark, folder))
    return with_observations(graph.entities, graph.observations).select(
        "name",
        "type",
        F.array_join("observations", "|").alias("observations"),
        F.array_join("labels", "|").alias("labels"),
    )


@query(
    "relations_upsert",
    f"""{_GRAPH}, batch AS (
      SELECT s_name AS source, n_name AS target, 'LOCATED_IN' AS "relationType"
      FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT s_name, n_name, 'TRADES_WITH' FROM supplier
        JOIN nation ON (s_nationkey + 1) % 25 = n_nationkey
      UNION ALL SELECT s_name, 'Atlantis', 'LOCATED_IN' FROM supplier)
    SELECT source, target, "relationType" FROM relations
    UNION SELECT source, target, "relationType" FROM batch
      WHERE source IN (SELECT name FROM entities) AND target IN (SELECT name FROM entities)""",
)
def upsert_relations(spark, folder):
    suppliers, nations = table(spark, folder, "supplier"), table(spark, folder, "nation")
    key = F.col("s_nationkey")

    def linked(shift: int, kind: str):
        return suppliers.join(nations, (key + shift) % 25 == F.col("n_nationkey")).select(
            F.col("s_name").alias("source"),
            F.col("n_name").alias("target"),
            F.lit(kind).alias("relationType"),
        )

    nowhere = suppliers.select("s_name", F.lit("Atlantis"), F.lit("LOCATED_IN"))
    batch = linked(0, "LOCATED_IN").union(linked(1, "TRADES_WITH")).union(nowhere)
    return relations_upsert(business_graph(spark, folder), batch).relations


_ADDS = """batch AS MATERIALIZED (
    SELECT CASE WHEN c_custkey % 10 = 0 THEN 'Nobody#' || c_custkey ELSE c_name END AS "entityName",
      [c_mktsegment, 'key ' || c_custkey, 'key ' || c_custkey] AS observations,
      c_custkey AS ord FROM customer),
  added AS MATERIALIZED (
    SELECT ord, "entityName", list_filter(b.observations,
      lambda o: NOT list_contains(e.observations, o)) AS fresh
    FROM batch b JOIN entities e ON e.name = b."entityName")"""


def _adds(spark, folder):
    key = F.col("c_custkey")
    noted = F.concat(F.lit("key "), key.cast("string"))
    return table(spark, folder, "customer").select(
        F.when(key % 10 == 0, F.concat(F.lit("Nobody#"), key.cast("string")))
        .otherwise(F.col("c_name"))
        .alias("entityName"),
        F.array(F.col("c_mktsegment"), noted, noted).alias("observations"),
        key.cast("bigint").alias("ord"),
    )


@query(
    "observations_add",
    f"""{_GRAPH}, {_ADDS} SELECT ord, "entityName",
      array_to_string(fresh, '|') AS "addedObservations" FROM added""",
)
def add(spark, folder):
    _, added = observations_add(business_graph(spark, folder), _adds(spark, folder))
    return added.withColumn("addedObservations", F.array_join("addedObservations", "|"))


@query(
    "array_union_new",
    f"""{_GRAPH}, {_ADDS} SELECT name, array_to_string(
      list_concat(observations, coalesce(fresh, [])), '|') AS observations
    FROM entities LEFT JOIN added ON name = "entityName" """,
)
def add_and_read(spark, folder):
    graph, _ = observations_add(business_graph(spark, folder), _adds(spark, folder))
    lists = with_observations(graph.entities, graph.observations)
    return lists.select("name", F.array_join("observations", "|").alias("observations"))


_DROPS = f"""{_GRAPH}, gone AS (SELECT c_name AS name, c_mktsegment AS text FROM customer
    WHERE c_custkey % 2 = 0 UNION ALL SELECT s_name, 'ships goods' FROM supplier),
  lists AS (SELECT name, list(text) AS texts FROM gone GROUP BY name)
  SELECT name, coalesce(array_to_string(list_filter(observations,
    lambda o: NOT coalesce(list_contains(texts, o), false)), '|'), '') AS observations
  FROM entities LEFT JOIN lists USING (name)"""


def _without(spark, folder):
    even = table(spark, folder, "customer").filter(F.col("c_custkey") % 2 == 0)
    batch = even.select(
        F.col("c_name").alias("entityName"), F.array("c_mktsegment").alias("observations")
    ).union(
        table(spark, folder, "supplier").select("s_name", F.array(F.lit("ships goods")))
    )
    graph = observations_delete(business_graph(spark, folder), batch)
    lists = with_observations(graph.entities, graph.observations)
    return lists.select("name", F.array_join("observations", "|").alias("observations"))


query("observations_delete", _DROPS)(_without)


@query(
    "array_except",
    """SELECT doc_id, array_to_string(list_filter(string_split(text, ' '),
      lambda w: NOT list_contains(string_split(lang || ' the of de la der', ' '), w)), ' ') AS rest
    FROM documents""",
)
def without_words(spark, folder):
    """Lists without the entries of another list, order and repeats kept."""
    words, others = F.split("text", " "), F.split(F.concat("lang", F.lit(" the of de la der")), " ")
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(list_except(words, others), " ").alias("rest")
    )


@query(
    "entities_delete",
    f"""{_GRAPH}, gone AS (SELECT n_name AS name FROM nation WHERE n_regionkey = 1
      UNION ALL SELECT c_name FROM customer WHERE c_acctbal < 0),
    e AS (SELECT * FROM entities WHERE name NOT IN (SELECT name FROM gone)),
    r AS (SELECT * FROM relations WHERE source NOT IN (SELECT name FROM gone)
      AND target NOT IN (SELECT name FROM gone)) {_rows('e', 'r')}""",
)
def delete(spark, folder):
    gone = (
        table(spark, folder, "nation")
        .filter("n_regionkey = 1")
        .select(F.col("n_name").alias("name"))
        .union(table(spark, folder, "customer").filter("c_acctbal < 0").select("c_name"))
    )
    return _as_rows(entities_delete(business_graph(spark, folder), gone))


@query(
    "relations_delete",
    f"""{_GRAPH} SELECT source, target, "relationType" FROM relations
    WHERE NOT ("relationType" = 'LOCATED_IN' AND source IN (
      SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'))""",
)
def delete_relations(spark, folder):
    graph = business_graph(spark, folder)
    builders = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    batch = builders.join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("c_name").alias("source"),
        F.col("n_name").alias("target"),
        F.lit("LOCATED_IN").alias("relationType"),
    )
    return relations_delete(graph, batch).relations
