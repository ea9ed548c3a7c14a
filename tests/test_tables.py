"""Sources, sinks, paging, registry and run logs on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from logsig import session
from logsig.catalog import tables
from logsig.operators import query
from logsig.operators.clusters import cluster_samples, cluster_signatures, cluster_stats
from logsig.operators.registry import (
    apply_mapping,
    build_registry,
    log_schema,
    map_signatures,
    registry_summary,
)
from logsig.operators.runlog import (
    call_results,
    insight_streak,
    read_run_logs,
    run_summary,
    tool_call_counts,
    tool_usage,
)
from logsig.operators.query import log_query
from logsig.session import materialize, shared_folder, temporary_tables
from logsig.sources import (
    annotate,
    append_clustered,
    append_clustered_csv,
    clustered_rows,
    read_clustered,
    read_clustered_csv,
    read_log_directory,
    read_log_file,
    read_registry_json,
    stored_model,
)


@pytest.fixture
def folder(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "b.log").write_bytes(b"  b one \r\n\n\t\nb [two]\xff x\n")
    (logs / "a.log").write_text("a: 1\na: 2\n　a: 3\n", encoding="utf-8")
    (logs / "skip.txt").write_text("no\n")
    return logs


def test_log_directory_order_and_cleaning(spark, folder):
    lines = read_log_directory(spark, str(folder)).orderBy("source_file", "pos").collect()
    assert [(r["source_file"], r["raw_log"]) for r in lines] == [
        ("a.log", "a: 1"),
        ("a.log", "a: 2"),
        ("a.log", "a: 3"),
        ("b.log", "b one"),
        ("b.log", "b [two] x"),
    ]


def test_missing_sources_are_errors(spark, folder):
    with pytest.raises(FileNotFoundError):
        read_log_directory(spark, str(folder), "*.none")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_log_file(spark, str(folder / "gone.log"))


def test_position_follows_file_order_over_splits(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = read_log_file(spark, str(path))
        assert lines.rdd.getNumPartitions() > 4
        number = F.regexp_extract("raw_log", r"(\d+)", 1).cast("int")
        ordered = lines.select("pos", number.alias("i")).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["i"] for r in ordered] == list(range(60_000))


def test_clustered_csv_round_trip_and_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, 0, 'say "hi", ok.'), (2, -1, "odd: line"), (3, 0, "plain")],
        "pos long, stable_id int, raw_log string",
    )
    out = str(tmp_path / "csv")
    append_clustered_csv(clustered_rows(rows), out)
    (tmp_path / "csv" / "extra.csv").write_text(
        'cluster,raw_log,pattern\nx,"bad","."\n7\n8,"good","."\n'
    )
    got = read_clustered_csv(spark, out).select("cluster", "raw_log", "pattern").collect()
    assert sorted(map(tuple, got)) == [
        (-1, "odd: line", "outlier"),
        (0, "plain", ""),
        (0, 'say "hi", ok.', '"X" , .'),
        (8, "good", "."),
    ]


def test_registry_json(spark, tmp_path):
    document = {
        "signature_to_stable_id": {"h0": 0, "h1": 1},
        "stable_id_to_info": {
            "0": {"signature_hash": "h0", "patterns": [". ."], "training_size": 3, "sample_logs": ["a"]},
            "1": {
                "signature_hash": "h1", "patterns": ["-"], "training_size": 0, "inference_size": 2,
                "sample_logs": [], "is_new_pattern": True,
            },
        },
        "next_stable_id": 2,
        "cluster_stats": {"0": {"size": 3, "avg_intra_distance": 0.5, "centroid_norm": 1.0}},
        "distance_thresholds": {
            "primary_distance_threshold": 0.25, "secondary_distance_threshold": 0.4,
            "knn_k": 5, "knn_confidence_threshold": 0.6,
        },
    }
    path = tmp_path / "registry.json"
    path.write_text(json.dumps(document, indent=2))
    registry, stats, settings = read_registry_json(spark, str(path))
    assert registry.count() == 2 and stats.first()["avg_intra_distance"] == 0.5
    assert settings.first()["next_stable_id"] == 2 and settings.first()["knn_k"] == 5
    summary = registry_summary(registry).first()
    assert (summary["training_clusters"], summary["new_patterns_discovered"]) == (1, 1)
    clusters, totals = log_schema(registry)
    previews = {r["cluster"]: r["sample_preview"] for r in clusters.collect()}
    assert previews == {0: "a", 1: "No sample available"}
    assert totals.first()["total_training_logs"] == 3
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED"):
        read_registry_json(spark, str(tmp_path / "bad.json"))[0].collect()


# ---- pages ------------------------------------------------------------------


def clustered(spark, n=57):
    return spark.range(n).select(
        (F.col("id") * 3).alias("pos"),
        F.lit(4).alias("cluster"),
        F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(": v [q]")).alias("raw_log"),
        F.lit(": [X]").alias("pattern"),
    )


@pytest.mark.parametrize("limit", [1, 7, 57, 1000])
def test_pages_add_up_to_the_whole(spark, limit):
    rows, seen, offset = clustered(spark).cache(), [], 0
    while True:
        lines, meta = query.log_query(rows, 4, "[x]", limit, offset)
        seen += [r["text"] for r in lines.orderBy("pos").collect()]
        if offset % 5 == 0 or limit > 1:
            assert meta.first()["isEnd"] == (offset + limit >= 57)
        offset += limit
        if offset >= 57:
            break
    assert seen == [f"n{i}: v [q]" for i in range(57)]


def test_deep_pages_are_located_exactly(spark, monkeypatch):
    monkeypatch.setattr(query, "DIRECT_OFFSET", 3)
    monkeypatch.setattr(query, "SEEK_RANGES", 5)
    rows = clustered(spark).unionByName(clustered(spark)).repartition(5).cache()
    everything = [r["pos"] for r in rows.orderBy("pos").collect()]
    for offset in (0, 3, 4, 50, 113, 114, 500):
        got = [r["pos"] for r in query.page(rows, 6, offset).orderBy("pos").collect()]
        assert got == everything[offset : offset + 6]


@pytest.mark.parametrize("args", [(0, 0), (-1, 0), (1001, 0), (5, -1)])
def test_bad_pages(spark, args):
    with pytest.raises(ValueError):
        query.log_query(clustered(spark), 4, "", *args)


def test_log_filter(spark):
    rows = clustered(spark)
    assert {r["text"] for r in query.log_filter(rows, 4, "")[0].collect()} == {""}
    lines, meta = query.log_filter(rows, 4, ": [", [1, 0, 9, 2], limit=2, offset=56)
    assert [r["text"] for r in lines.collect()] == ["v\tn56\tq"]
    assert meta.first().asDict() == {
        "current_offset": 56, "returned_count": 1, "requested_limit": 2, "isEnd": True,
        "total_matches": 57, "cluster_id": 4, "pattern_filter": ": [", "field_indices": [1, 0, 9, 2],
    }
    with pytest.raises(ValueError, match="field indices"):
        query.log_filter(rows, 4, "", [-1])


# ---- registry -----------------------------------------------------------------


ROWS = [
    (0, 7, "a.b", "."), (1, -1, "??", "? ?"), (2, 5, "a-b", "-"), (3, 7, "a:b", ":"),
    (4, 7, "c.d", "."), (5, 5, "c-d", "-"), (6, 9, "x.y", "."), (7, 9, "x:y", ":"), (8, 9, "y.y", "."),
]


def training(spark, rows=ROWS):
    return spark.createDataFrame(
        rows, "pos long, cluster_id long, raw_log string, pattern string"
    )


def test_cluster_signatures(spark):
    got = {r["cluster_id"]: r for r in cluster_signatures(training(spark)).collect()}
    assert set(got) == {5, 7, 9}
    assert got[7]["patterns"] == [".", ":"] and got[7]["size"] == 3
    assert got[7]["sample_logs"] == ["a.b", "a:b"]
    assert got[7]["signature_hash"] == got[9]["signature_hash"]
    stats = cluster_stats(training(spark)).first()
    assert stats["cluster_sizes"] == {"-1": 1, "5": 2, "7": 3, "9": 3}
    assert (stats["num_clusters"], stats["num_outliers"]) == (3, 1)
    samples = {r["cluster_id"]: r["sample_logs"] for r in cluster_samples(training(spark)).collect()}
    assert samples[-1] == ["??"]


def test_ids_follow_appearance_and_later_hash_wins(spark):
    registry = build_registry(cluster_signatures(training(spark)))
    ids = {r["cluster_id"]: r["stable_id"] for r in registry.collect()}
    assert ids == {7: 0, 5: 1, 9: 2}
    fresh = training(
        spark,
        [(0, 3, "p.q", "."), (1, 3, "p:q", ":"), (2, 8, "n!", "!"), (3, 6, "m!", "!"), (4, 1, "k%", "%")],
    )
    mapping, extended = map_signatures(cluster_signatures(fresh), registry)
    assert {r["cluster_id"]: r["stable_id"] for r in mapping.collect()} == {3: 2, 8: 3, 6: 3, 1: 4}
    new = {r["stable_id"]: r for r in extended.filter("is_new_pattern").collect()}
    assert new[3]["sample_logs"] == ["n!"] and new[3]["training_size"] == 0
    assert new[3]["inference_size"] == 1 and set(new) == {3, 4}
    rows = training(spark, [(0, 3, "", ""), (1, -1, "", ""), (2, 44, "", "")])
    applied = apply_mapping(rows, mapping).orderBy("pos").collect()
    assert [r["stable_id"] for r in applied] == [2, -1, None]


def test_bucketed_numbering_equals_direct(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("key"))
    direct = session.sequential_ids(rows, ["key"], "n").collect()
    monkeypatch.setattr(session, "NUMBERING_BUCKETS", 16)
    bucketed = session.sequential_ids(rows, ["key"], "n", direct=0).collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, bucketed))
    # Texts that begin alike, of several lengths and of characters beyond ASCII.
    text = F.concat(F.lit("s3://logs/é/"), F.left(F.md5(F.col("key").cast("string")), F.col("key") % 9), F.lit("é"))
    named = rows.select(text.alias("word"), "key")
    got = session.sequential_ids(named, ["word", "key"], "n", direct=0).orderBy("n").collect()
    order = [(r["word"].encode(), r["key"]) for r in got]
    assert order == sorted(order) and [r["n"] for r in got] == list(range(3000))
    numbers = named.select(session._text_number(named, "word").cast("double").alias("x"))
    assert numbers.distinct().count() > 1000


# ---- run logs -------------------------------------------------------------------


def test_run_log(spark, tmp_path):
    def call(i, name):
        return {"timestamp": "2025-08-10T15:32:01.9", "type": "tool_call", "tool_name": name,
                "tool_id": f"c{i}", "arguments": {"entities": [{"name": "A"}]}}

    def result(i, text):
        return {"timestamp": "2025-08-10T15:32:02.1", "type": "tool_result",
                "tool_call_id": f"c{i}", "content": text}

    run = {
        "start_time": "2025-08-10 15:31:43", "end_time": "2025-08-10 15:32:34",
        "total_duration": 51.1, "termination_reason": "done", "success": True,
        "final_state": {"insights_discovered": 3},
        "iterations": [
            {"iteration": 1, "duration": 18.6, "tool_usage": [
                call(1, "read_graph"), result(1, "x" * 201), call(2, "create_entities")]},
            {"iteration": 2, "duration": 15.0, "tool_usage": [call(3, "read_graph"), result(3, "y")]},
        ],
    }
    (tmp_path / "run.json").write_text(json.dumps(run, indent=1))
    logs = read_run_logs(spark, str(tmp_path / "run.json"))
    usage = tool_usage(logs)
    assert usage.count() == 5
    counts = [(r["tool_name"], r["calls"]) for r in tool_call_counts(usage).collect()]
    assert counts == [("create_entities", 1), ("read_graph", 2), (None, 3)]
    joined = {r["call_id"]: r for r in call_results(usage).collect()}
    assert joined["c1"]["preview"] == "x" * 200 + "..." and joined["c2"]["content"] is None
    assert json.loads(joined["c1"]["arguments"]) == {"entities": [{"name": "A"}]}
    summary = run_summary(logs).first()
    assert (summary["total_iterations"], summary["insights_discovered"]) == (2, 3)
    assert (summary["clusters_analyzed"], summary["success"]) == (0, True)


@pytest.mark.parametrize("chunk", [1, 2, 5, 100_000])
def test_insight_streak_over_chunks(spark, chunk):
    texts = ["cluster"] * 5 + ["an Insight", "x", "y", "z", "found it", "", "cluster", "w"]
    rows = [(c, i, t) for c in (1, 2) for i, t in enumerate(texts[c - 1 :])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = insight_streak(df, chunk=chunk).orderBy("conv_id", "turn").collect()
    want = []
    for c in (1, 2):
        clusters = insights = streak = 0
        for i, t in enumerate(texts[c - 1 :]):
            clusters += "cluster" in t
            hit = "insight" in t.lower() or "found" in t
            insights, streak = insights + hit, 0 if hit else streak + 1
            want.append((c, i, clusters, insights, streak, clusters >= 5 and insights > 0 and streak >= 3))
    keep = ["conv_id", "turn", "clusters_analyzed", "insights_discovered", "consecutive_no_insights", "saturated"]
    assert [tuple(r[k] for k in keep) for r in got] == want


def test_pages_over_files_and_appends_follow_their_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i} x: 1\n" for i in range(6)))
    lines = annotate(read_log_directory(spark, str(tmp_path))).withColumn("cluster", F.lit(3))
    table = shared_folder(spark)
    for _ in range(2):
        append_clustered(lines, table)
    want = [f"{n}{i} x: 1" for n in "ab" for i in range(6)] * 2
    got = []
    for offset in range(0, 24, 3):
        page, _ = log_query(read_clustered(spark, table), 3, ":", limit=3, offset=offset)
        got += [r.text for r in page.orderBy("pos").collect()]
    assert got == want
    csv = shared_folder(spark)
    append_clustered_csv(lines, csv)
    append_clustered_csv(lines, csv)
    assert [r.raw_log for r in read_clustered_csv(spark, csv).orderBy("pos").collect()] == want


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('pattern,more,raw_log,cluster\n"[X]",z,"[a] b",4\n"",z,c,x\n')
    row = read_clustered_csv(spark, str(tmp_path)).collect()
    assert [(r.cluster, r.raw_log, r.pattern) for r in row] == [(4, "[a] b", "[X]")]


def test_runs_of_one_file_are_told_apart(spark, tmp_path):
    run = """{"start_time":"%s","iterations":[{"iteration":1,"tool_usage":[
      {"type":"tool_call","tool_name":"t","tool_id":"c"},
      {"type":"tool_result","tool_call_id":"c","content":"%s"}]}]}""".replace("\n", " ")
    (tmp_path / "runs.json").write_text(run % ("a", "A") + "\n" + run % ("b", "B") + "\n")
    runs = read_run_logs(spark, str(tmp_path), multiline=False)
    assert runs.select("run_id").distinct().count() == 2
    results = call_results(tool_usage(runs)).collect()
    assert sorted(r.content for r in results) == ["A", "B"]


def test_temporary_tables_go(spark):
    with temporary_tables(spark):
        table = materialize(spark.range(3))
        path = table.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_a_stored_registry_goes_on_from_its_next_id(spark, tmp_path):
    # Keys of the registry document.
    info = {"signature_hash": "h0", "patterns": ["."], "training_size": 2, "sample_logs": ["a."]}
    limits = {"primary_distance_threshold": 0.1, "knn_k": 3}
    document = {
        "stable_id_to_info": {"0": info},
        "next_stable_id": 7,
        "distance_thresholds": limits,
    }
    (tmp_path / "registry.json").write_text(json.dumps(document))
    empty = spark.createDataFrame([], "stable_id bigint, vec array<double>")
    model = stored_model(spark, str(tmp_path / "registry.json"), empty, empty)
    assert model.thresholds.primary_distance == 0.1 and model.thresholds.knn_k == 3
    assert model.thresholds.secondary_distance == 0.4
    fresh = spark.createDataFrame(
        [(4, "h0", ["."], 3, ["b."], 1), (5, "h1", [":"], 1, ["c:"], 2)],
        "cluster_id int, signature_hash string, patterns array<string>, size bigint, "
        "sample_logs array<string>, first_pos bigint",
    )
    mapping, _ = map_signatures(fresh, model.registry, next_id=model.next_id)
    assert {r.cluster_id: r.stable_id for r in mapping.collect()} == {4: 0, 5: 7}


def test_files_of_ordered_lines_follow_the_input(spark, tmp_path, monkeypatch):
    """Much input makes more files, so that none is one task's; their order is that of the lines."""
    docs = [(i, f"b{i}\na{i}\n\nc{i}", "en", "src1") for i in range(300)]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(docs, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(tables, "FILE_BYTES", 200)
    path = tables._write_ordered(spark, str(tmp_path))
    assert spark.read.text(path).select("_metadata.file_path").distinct().count() > 8
    got = tables.log_directory(spark, str(tmp_path)).orderBy("place").collect()
    assert [r["raw_log"] for r in got] == [f"{c}{i}" for i in range(300) for c in "bac"]
    assert [r["place"] for r in got] == list(range(900))


def test_positions_of_files_are_numbered_without_a_shuffle(spark, monkeypatch):
    """Whole numbers that lie close are counted in bit maps; others, copies and nulls are not."""
    span = 1 << 40
    taken = [-32769, -1, 0, 7, 8, 9, 32767, 32768, 65536, span + 3, span + 4, 3 * span]
    taken += [5 * span + 3 * i for i in range(40000)]
    rows = spark.createDataFrame([(p, f"l{p}") for p in reversed(taken)], "pos bigint, raw_log string")
    more = spark.createDataFrame([(None, "null"), (7, "copy")], rows.schema)
    buckets = session._bucketed_ids
    monkeypatch.setattr(session, "_bucketed_ids", None)
    got = session.sequential_ids(rows.repartition(5), ["pos"], "place", 3, direct=10).collect()
    assert {(r.pos, r.raw_log): r.place for r in got} == {(p, f"l{p}"): 3 + i for i, p in enumerate(taken)}
    monkeypatch.setattr(session, "_bucketed_ids", buckets)
    got = session.sequential_ids(rows.union(more), ["pos"], "place", direct=10).collect()
    assert sorted(r.place for r in got) == list(range(len(taken) + 2))
    monkeypatch.setattr(session, "BITMAPS", 2)
    got = session.sequential_ids(rows, ["pos"], "place", direct=10).orderBy("place").collect()
    assert [r.pos for r in got] == taken
