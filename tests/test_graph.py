"""Knowledge-graph jobs on small graphs."""

import pytest

from logsig.operators.graph import (
    entities_delete,
    entities_upsert,
    graph_find,
    graph_from_lists,
    graph_read,
    graph_search,
    index_hits,
    observations_add,
    observations_delete,
    relations_delete,
    relations_upsert,
    text_index,
    with_observations,
)

ENTITY = "name string, type string, observations array<string>"
BATCH = ENTITY + ", ord long"
RELATION = "source string, target string, relationType string"


def make(spark, entities, relations=()):
    return graph_from_lists(
        spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(relations), RELATION)
    )


def entities_of(graph):
    rows = with_observations(graph.entities, graph.observations).collect()
    return {r["name"]: (r["type"], r["observations"]) for r in rows}


def relations_of(graph):
    return sorted(map(tuple, graph.relations.select("source", "target", "relationType").collect()))


def test_create_and_read(spark):
    empty = make(spark, [])
    batch = [
        ("Alice", "Person", ["Likes reading", "Works at Company X"], 0),
        ("Bob", "Person", ["Enjoys hiking"], 1),
    ]
    graph = entities_upsert(empty, spark.createDataFrame(batch, BATCH))
    graph = relations_upsert(graph, spark.createDataFrame([("Alice", "Bob", "KNOWS")], RELATION))
    graph = graph_read(graph)
    assert entities_of(graph) == {
        "Alice": ("Person", ["Likes reading", "Works at Company X"]),
        "Bob": ("Person", ["Enjoys hiking"]),
    }
    assert relations_of(graph) == [("Alice", "Bob", "KNOWS")]


def test_upsert_replaces_and_last_wins(spark):
    graph = make(spark, [("A", "Old", ["x", "y"]), ("B", "Keep", ["z"])])
    batch = [("A", "Mid", ["m"], 0), ("A", "New", ["n", "n"], 1), ("C", "New", [], 2)]
    graph = entities_upsert(graph, spark.createDataFrame(batch, BATCH))
    assert entities_of(graph) == {"A": ("New", ["n", "n"]), "B": ("Keep", ["z"]), "C": ("New", [])}
    labels = {r["name"]: r["labels"] for r in graph.entities.collect()}
    assert labels == {"A": ["Old", "Mid", "New"], "B": ["Keep"], "C": ["New"]}


def test_relations_need_both_ends_and_stay_unique(spark):
    graph = make(spark, [("A", "T", []), ("B", "T", [])], [("A", "B", "R")])
    batch = [("A", "B", "R"), ("A", "B", "S"), ("A", "B", "S"), ("A", "Z", "R"), ("Z", "B", "R")]
    graph = relations_upsert(graph, spark.createDataFrame(batch, RELATION))
    assert relations_of(graph) == [("A", "B", "R"), ("A", "B", "S")]


def test_add_observations(spark):
    graph = make(spark, [("Charlie", "Person", ["Initial"]), ("Empty", "Person", [])])
    batch = [
        ("Charlie", ["New 1", "Initial", "New 1"], 0),
        ("Nobody", ["x"], 1),
        ("Charlie", ["New 2", "New 1"], 2),
        ("Charlie", ["Initial"], 3),
        ("Empty", ["first"], 4),
    ]
    graph, added = observations_add(
        graph, spark.createDataFrame(batch, "entityName string, observations array<string>, ord long")
    )
    assert entities_of(graph)["Charlie"][1] == ["Initial", "New 1", "New 1", "New 2", "New 1"]
    assert entities_of(graph)["Empty"][1] == ["first"]
    assert [(r["entityName"], r["addedObservations"]) for r in added.orderBy("ord").collect()] == [
        ("Charlie", ["New 1", "New 1"]),
        ("Charlie", ["New 2", "New 1"]),
        ("Charlie", []),
        ("Empty", ["first"]),
    ]
    again, _ = observations_add(
        graph, spark.createDataFrame([("Empty", ["second"], 0)], "entityName string, observations array<string>, ord long")
    )
    assert entities_of(again)["Empty"][1] == ["first", "second"]


def test_deletes(spark):
    graph = make(
        spark,
        [("Dave", "P", ["O 1", "O 2", "O 3"]), ("Eve", "P", ["x"]), ("Frank", "P", ["y"])],
        [("Dave", "Eve", "KNOWS"), ("Dave", "Frank", "KNOWS"), ("Dave", "Frank", "WORKS_WITH")],
    )
    removal = spark.createDataFrame(
        [("Dave", ["O 2"]), ("Ghost", ["O 1"])], "entityName string, observations array<string>"
    )
    graph = observations_delete(graph, removal)
    assert entities_of(graph)["Dave"][1] == ["O 1", "O 3"]
    graph = entities_delete(graph, spark.createDataFrame([("Eve",), ("Ghost",)], "name string"))
    assert set(entities_of(graph)) == {"Dave", "Frank"} and len(relations_of(graph)) == 2
    graph = relations_delete(graph, spark.createDataFrame([("Dave", "Frank", "KNOWS")], RELATION))
    assert relations_of(graph) == [("Dave", "Frank", "WORKS_WITH")]


@pytest.fixture
def drinks(spark):
    return make(
        spark,
        [("Ian", "Person", ["Likes coffee"]), ("Jane", "Person", ["Likes tea"]), ("coffee", "Beverage", [])],
        [("Ian", "Jane", "KNOWS"), ("Jane", "tea house", "VISITS")],
    )


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("coffee", {"Ian", "coffee"}),
        ("COFFEE tea", {"Ian", "Jane", "coffee"}),
        ("bev*", {"coffee"}),
        ("*", {"Ian", "Jane", "coffee"}),
        ("cof", set()),
    ],
)
def test_search(drinks, text, names):
    found = graph_search(drinks, text)
    assert set(entities_of(found)) == names
    assert {r["name"] for r in index_hits(text_index(drinks), text).collect()} == names
    assert (("Ian", "Jane", "KNOWS") in relations_of(found)) == bool(names & {"Ian", "Jane"})


def test_find(drinks):
    found = graph_find(drinks, ["Jane", "Nobody"])
    assert set(entities_of(found)) == {"Jane"} and len(relations_of(found)) == 2
    nothing = graph_find(drinks, ["tea house"])
    assert entities_of(nothing) == {} and relations_of(nothing) == []
