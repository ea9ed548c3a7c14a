"""Signatures, fields and reconstruction against golden values and the plain model."""

import time

import model
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsig.functions import (
    categorize_fields,
    extract_fields,
    pattern_signature,
    select_fields_dual,
    select_fields_unified,
    shallow_reconstruct,
    signature_hash,
    strip,
    text_preview,
    token_kinds,
)
from logsig.functions.walk import field_walk, fields, shallow, shallow_walk
from logsig.functions.signature import mask_by_fold, symbol_skeleton
from logsig.functions.text import WHITESPACE

# Lines and the signatures they must get.
SIGNATURES = [
    ('[user]: "hello world"', '[X] : "X"'),
    ("<timestamp><event></timestamp>", "<X> <X> <X>"),
    ("{data: value}", "{X}"),
    ('"string with spaces"', '"X"'),
    ('"first string" "second string"', '"X" "X"'),
    ("192.168.1.1 - - [22/Jan/2019:14:18:06 +0330]", ". . . - - [X]"),
    ('84.241.26.205 [timestamp] "GET /image/820/brand HTTP/1.1" 200', '... [X] "X"'),
    ("simple-log-entry", "- -"),
    ('1.2.3.4 - - : [time] "GET /test" 200', '. . . - - : [X] "X"'),
    ("[][]...()//", "[X] [X] . . . ( ) / /"),
    ("a..] b. c", "..."),
    ('x: [abc "d" e', ":"),
    ("a -> b: c", "- :"),
    ("if a < b: c", ""),
    ("plain", ""),
    ("", ""),
    ('{a [b <c "d {e}" f> g] h} - i', "{X} -"),
    ('[a {b <c "d [e {f}] g" h> i} j] k.', "[X] ."),
]

# Line, pattern, fields, shallow text.
WALKS = [
    (
        '192.168.1.1 - - [22/Jan/2019:14:18:06] "GET /test" 200',
        '. . . - - [X] "X"',
        ["192", "168", "1", "1", "22/Jan/2019:14:18:06", "GET /test", "200"],
        '192 . 168 . 1 . 1 - - [X] "X" 200',
    ),
    (
        '192.168.1.1 - - [22/Jan/2019:14:18:06] "GET /test" 200',
        '. - - [X] "X"',
        ["192", "168.1.1", "22/Jan/2019:14:18:06", "GET /test", "200"],
        '192 . 168.1.1 - - [X] "X" 200',
    ),
    (
        "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 instruction cache parity error",
        "- . . -",
        ["1117838570 2005", "06", "03 R02", "M1-N0-C:J12-U11 instruction cache parity error"],
        "- 1117838570 2005 . 06 . 03 R02 - M1-N0-C:J12-U11 instruction cache parity error",
    ),
    ("1.2.3.4", "...", ["1", "2.3.4"], "1 ... 2.3.4"),
    ("[a [b] c] d: e", "[X] :", ["a [b", "e"], "[X] c] d : e"),
    ("a->b: c d", "- :", ["a", "c d"], "a - >b : c d"),
    (
        "2568643 node-70 action start 1074119817 1 clusterAddMember  (command 1902)",
        "- ( )",
        ["2568643 node", "70 action start 1074119817 1 clusterAddMember", "command 1902"],
        "2568643 node - 70 action start 1074119817 1 clusterAddMember ( command 1902 )",
    ),
    ("some line", "outlier", ["some line"], "outlier some line"),
    ("some line", "", [], ""),
    ("", ".", [], ""),
]

LINE = st.text(st.sampled_from('ab _X"[]{}<>.-:¿1é\t'), max_size=24)
TOKENS = st.sampled_from(
    ["X", "...", "-", "->", "[X]", '"X"', "<X>", "fooX", "XX", "[X", ".", "outlier", ":", "["]
)
PATTERN = st.lists(TOKENS, max_size=6).map(" ".join)
QUICK = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_signature_goldens(spark):
    df = spark.createDataFrame(SIGNATURES, "line string, want string")
    got = df.select("line", "want", pattern_signature(F.col("line")).alias("got"))
    assert got.filter("got <> want").collect() == []
    assert [(line, model.signature(line)) for line, _ in SIGNATURES] == SIGNATURES


@QUICK
@given(st.lists(LINE, min_size=150, max_size=300))
def test_signature_equals_model(spark, lines):
    df = spark.createDataFrame([(x, model.signature(x)) for x in lines], "line string, want string")
    line = F.col("line")
    wrong = df.select(
        "line",
        "want",
        pattern_signature(line).alias("got"),
        mask_by_fold(symbol_skeleton(line)).alias("fold"),
    ).filter("got <> want OR fold <> want")
    assert wrong.collect() == []


def test_signature_of_very_long_lines(spark):
    lines = ["a.b-" * 50_000, "[" * 3000 + "]" * 3000 + ".", '"[{<' * 2000]
    df = spark.createDataFrame([(x, model.signature(x)) for x in lines], "line string, want string")
    assert df.filter(pattern_signature(F.col("line")) != F.col("want")).collect() == []


def test_walk_goldens(spark):
    df = spark.createDataFrame(
        WALKS, "line string, pattern string, want array<string>, shallow string"
    )
    line, pattern = F.col("line"), F.col("pattern")
    got = df.withColumn("got", extract_fields(line, pattern)).withColumn(
        "text", shallow_reconstruct(line, pattern)
    )
    assert got.filter("got <> want OR text <> shallow").collect() == []


@QUICK
@given(st.lists(st.tuples(LINE, PATTERN, st.booleans()), min_size=150, max_size=300))
def test_walks_equal_model(spark, cases):
    rows = []
    for line, pattern, own in cases:
        pattern = model.signature(line) if own else pattern
        walked = model.walk(line, pattern)
        rows.append(
            (
                line,
                pattern,
                [t for _, t in walked],
                [t for e, t in walked if not e],
                [t for e, t in walked if e],
                model.shallow(line, pattern),
            )
        )
    df = spark.createDataFrame(
        rows,
        "line string, pattern string, fields array<string>, gaps array<string>, "
        "regions array<string>, shallow string",
    )
    line, pattern = F.col("line"), F.col("pattern")
    got = df.select(
        "*",
        extract_fields(line, pattern).alias("f"),
        F.transform(field_walk(line, pattern), lambda w: w["text"]).alias("w"),
        categorize_fields(line, pattern).alias("c"),
        shallow_reconstruct(line, pattern).alias("s"),
        shallow_walk(line, pattern).alias("sw"),
    )
    wrong = got.filter(
        "f <> fields OR w <> fields OR c.whitespace_fields <> gaps OR c.x_fields <> regions "
        "OR s <> shallow OR sw <> shallow"
    )
    assert wrong.collect() == []


def test_token_kinds(spark):
    row = spark.range(1).select(token_kinds(F.lit('X . [X] -> "X" word fooX')).alias("t")).first()
    assert [(t["kind"], t["token"], t["needles"], t["closer"]) for t in row["t"]] == [
        ("complex_content", "X", [], ""),
        ("symbol", ".", ["."], ""),
        ("enclosed_content", "[X]", ["["], "]"),
        ("symbol", "->", ["-", ">"], ""),
        ("enclosed_content", '"X"', ['"'], '"'),
        ("enclosed_content", "fooX", ["f"], "o"),
    ]


def test_field_selection(spark):
    fields = F.array(*[F.lit(x) for x in "abcde"])
    gaps, regions = F.array(F.lit("ip"), F.lit("user"), F.lit("code")), F.array(F.lit("t"), F.lit("r"))
    row = spark.range(1).select(
        select_fields_unified(fields, [4, 0, 99, 0]).alias("some"),
        select_fields_unified(fields, []).alias("none"),
        select_fields_dual(gaps, regions, [0, 2], [1, 7]).alias("two"),
    ).first()
    assert row["some"] == ["e", "a", "a"] and row["none"] == []
    assert (row["two"][0], row["two"][1]) == (["ip", "code"], ["r"])


def test_text_helpers(spark):
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    row = spark.range(1).select(
        strip(F.lit("\x1c　 a b\x85\n")).alias("strip"),
        text_preview(F.lit("x" * 151), 150).alias("cut"),
        text_preview(F.lit("x" * 150), 150).alias("whole"),
        signature_hash(F.array(F.lit("- ( )"))).alias("hash"),
    ).first()
    assert row["strip"] == "a b"
    assert row["cut"] == "x" * 150 + "..." and row["whole"] == "x" * 150
    assert row["hash"] == "4db14f9c7223"


@pytest.mark.parametrize("pattern", ["[X] : ( )", ". . . - - [X]"])
def test_signature_hash_ignores_order(spark, pattern):
    row = spark.range(1).select(
        signature_hash(F.array(F.lit(pattern), F.lit("-"))).alias("a"),
        signature_hash(F.array(F.lit("-"), F.lit(pattern))).alias("b"),
    ).first()
    assert row["a"] == row["b"]


@pytest.mark.parametrize("unit, tail, pattern", [
    ("a.", "[b", ". "), ("<a", "", "<X> "), ('"a. ', "[b", '"X" . '), ("x[y ", "", "[X] : "),
])
def test_long_lines_take_linear_time(unit, tail, pattern):
    def took(n):
        start = time.process_time()
        fields(unit * n + tail, (pattern * n).strip())
        shallow(unit * n + tail, (pattern * n).strip())
        return time.process_time() - start

    took(1000)
    small, large = took(20_000), took(160_000)
    assert large < 10 and large < 30 * max(small, 0.05)


@pytest.mark.parametrize("line", ["a." * 300_000 + "[b", "<a" * 300_000, '{"k": [' * 100_000])
def test_a_very_long_line(spark, line):
    df = spark.createDataFrame([(line,)], "raw_log string")
    signed = df.withColumn("pattern", pattern_signature(F.col("raw_log")))
    start = time.time()
    row = signed.select(
        F.size(extract_fields(F.col("raw_log"), F.col("pattern"))).alias("n"),
        F.length(shallow_reconstruct(F.col("raw_log"), F.col("pattern"))).alias("size"),
    ).first()
    assert row.n is not None and time.time() - start < 90
