"""The catalog as a whole, and the plans its queries should get."""

import contextlib
import io

import duckdb
import pytest

from logsig.catalog import ORACLES, QUERIES
from logsig.catalog.corpora import clustered_docs
from logsig.operators.query import filter_cluster_pattern
from logsig.session import shared_folder
from logsig.sources import append_clustered, read_clustered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Answered per area here; check.py runs every one.
SHOWN = [
    "signature_counts",
    "categorize_fields",
    "log_filter",
    "map_signatures",
    "assign_stable_cluster",
    "density_cluster",
    "entities_upsert",
    "insight_streak_documents",
    "sink_clustered_append",
]


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_oracle(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, data).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_page_reads_one_cluster_and_its_columns(spark, data):
    path = shared_folder(spark)
    append_clustered(clustered_docs(spark, data), path)
    text = plan(filter_cluster_pattern(read_clustered(spark, path), 3, "x").select("pos"))
    assert "PartitionFilters: [isnotnull(cluster" in text and "raw_log" not in text


def test_plans(spark, data):
    nearest = plan(QUERIES["assign_stable_cluster"](spark, data))
    assert "ArrowEvalPython" in nearest and "Join" not in nearest and "Exchange" not in nearest
    samples = plan(QUERIES["cluster_samples"](spark, data))
    before, after = samples.split("Exchange", 1)
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after
    counts = plan(QUERIES["signature_counts"](spark, data))
    assert "SortAggregate" not in counts and "BatchEvalPython" not in counts
