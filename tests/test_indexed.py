"""The indexed log against the plain table."""

import random

import pytest
from pyspark.sql import functions as F

from logsig.operators import indexed
from logsig.operators.indexed import (
    append_indexed,
    indexed_filter,
    indexed_query,
    match_counts,
    matching_lines,
    read_indexed,
    uniqueness_estimate,
)
from logsig.operators.query import log_filter, log_query
from logsig.session import materialize, shared_folder
from logsig.sources import append_clustered, read_clustered

from test_catalog import plan


@pytest.fixture(scope="module")
def logs(spark):
    """Three appends with far apart positions, in both kinds of table."""
    draw = random.Random(1)
    plain, path = shared_folder(spark), shared_folder(spark)
    shapes = ["[X] : =", ". ,", ": :", "[X] .", "= X=x"]
    for part in range(3):
        rows, pos = [], 0
        for i in range(150):
            pos += draw.choice([1, 7, 90, 5000])
            pattern = shapes[draw.randrange(2 + part)]
            rows.append((pos, f"a{part}: {i} = [{i}] b.c", pattern, i % 3 - 1))
        df = spark.createDataFrame(rows, "pos long, raw_log string, pattern string, cluster int")
        append_clustered(df, plain)
        append_indexed(df, path)
    return read_clustered(spark, plain), path


@pytest.mark.parametrize(("width", "sums"), [(1 << 24, 4096), (64, 5), (1000, 2)])
def test_pages_equal_those_of_the_plain_table(spark, logs, monkeypatch, width, sums):
    table, path = logs
    if width != indexed.RANGE:
        monkeypatch.setattr(indexed, "RANGE", width)
        path = shared_folder(spark)
        for part in range(3):
            rows = table.filter(f"raw_log like 'a{part}:%'").select("pos", "raw_log", "pattern", "cluster")
            append_indexed(rows, path)
    monkeypatch.setattr(indexed, "SEEK_RANGES", sums)
    log = read_indexed(spark, path)
    for needle, limit, offset in ((":", 20, 0), ("x", 7, 33), ("", 50, 140), ("=", 5, 10_000), ("no", 5, 0)):
        want, meta = log_query(table, 1, needle, limit, offset)
        got, own = indexed_query(log, 1, needle, limit, offset)
        assert sorted(own.collect()) == sorted(meta.collect())
        texts = lambda df: [r["text"] for r in df.collect()]
        assert texts(got) == texts(want)
    want, got = log_filter(table, 0, ".", [1, 0], 9, 4)[0], indexed_filter(log, 0, ".", [1, 0], 9, 4)[0]
    assert [r["text"] for r in got.collect()] == [r["text"] for r in want.collect()]
    with pytest.raises(ValueError):
        indexed_query(log, 1, ":", 0)


def test_no_pattern_text_is_read_with_lines(spark, logs, monkeypatch):
    log = read_indexed(spark, logs[1])
    text = plan(matching_lines(log, 1, ":").select("pos"))
    lines = [p for p in text.split("\n\n") if "Scan parquet" in p and "/lines" in p]
    assert len(lines) == 1 and "pattern_id" in lines[0] and "pattern:string" not in lines[0]
    assert "contains" not in text and "cluster" in lines[0]
    stored = []
    monkeypatch.setattr(indexed, "materialize", lambda df: stored.append(df) or materialize(df))
    page = indexed_query(log, 1, ":", 5, 60)[0]
    scan = [p for p in plan(stored[-1]).split("\n\n") if "Scan parquet" in p and "/lines" in p][0]
    assert "GreaterThanOrEqual(pos" in scan and "LessThan(pos" in scan
    assert "/lines" not in plan(page)
    # The total is a sum of counts, and no line is counted.
    assert "/lines" not in plan(match_counts(log, 1, ":"))


def test_an_unfinished_append_is_not_read_and_replaced(spark):
    path = shared_folder(spark)
    df = spark.createDataFrame([(0, "a: b", ":", 1), (4, "c: d", ":", 1)], "pos long, raw_log string, pattern string, cluster int")
    append_indexed(df, path)
    half = df.withColumnRenamed("pattern", "pattern_id")
    half.write.partitionBy("cluster").parquet(f"{path}/lines/append=1")
    assert matching_lines(read_indexed(spark, path), 1, ":").count() == 2
    append_indexed(df.limit(1), path)
    log = read_indexed(spark, path)
    assert [r["raw_log"] for r in matching_lines(log, 1, ":").orderBy("pos").collect()] == ["a: b", "c: d", "a: b"]


def test_sketches_are_merged(spark, logs):
    log = read_indexed(spark, logs[1])
    row = uniqueness_estimate(log).first()
    exact = log.patterns.select("pattern").distinct().count()
    assert row["lines"] == 450 and abs(row["distinct_patterns"] - exact) <= row["error"] * exact
    assert row["low_variation"] == (exact / 450 < 0.05) and not row["uniform"] is None


def test_an_append_computes_its_lines_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(text):
        seen.add(1)
        return text

    rows = [(i, f"line {i % 7}", i % 2) for i in range(60)]
    lines = spark.createDataFrame(rows, "pos long, raw_log string, cluster int")
    append_indexed(lines.withColumn("pattern", costly("raw_log")), path := shared_folder(spark))
    assert seen.value == 60
    assert read_indexed(spark, path).lines.count() == 60
