"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for candidates. Their values' hashes are counted by distinct
repositories and owners over the whole corpus. A value that many owners have is a copied
example; one that few have is a live-looking credential of theirs. Besides the base
kinds there are spans of kind ``bare``: tokens that look random, and tokens whose value stands
as a credential of a base kind anywhere in the corpus. For the latter the values of a first
scan are known to the tasks of the second as a bit map of bounded size, and joined exactly
afterwards. A bare span stays only if its value is owner-specific. Points, hyphens and equals
signs at the ends of a value do not count in comparisons.

Null and empty texts have no spans. Counts are of distinct pairs, combined before the
shuffle, so repeated rows and hot sources add nothing; rows without a repository or
owner count as owned by an unnamed one. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded, materialize
from .common import computed, per_text, structs
from .rolling import bit_map, marked

#: A value in the hands of at least so many owners, or in so many repositories, is an example.
EXAMPLE_OWNERS = 5
EXAMPLE_REPOSITORIES = 5

# The base kinds in their order, with the least length of a match.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12

_KEYS = ("passw", "secret", "token", "api")
#: Other key-shaped values: at least 20 characters, letters of both cases and digits.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
BARE_BITS = 3.5
#: What is compared with the credentials of other texts.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
ENDS = ".=-"
#: Digests of texts with live credentials are broadcast up to this size.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _mixed(value: str) -> bool:
    return (
        any(c.isdigit() for c in value)
        and any(c.islower() for c in value)
        and any(c.isupper() for c in value)
        and entropy(value) >= BARE_BITS
    )


def candidates(text: str, known=None) -> list[tuple[int, int, int, int, bool]]:
    """``(start, kind, end, start of the value, sure)`` of the matches of a text, by start, then
    kind. ``known`` says which values, as numbers, may stand as a credential elsewhere; matches
    that rest on that are not sure."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_VALUE:
                found.append((m.start(), 0, m.end(), m.start(2), True))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), True) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), True) for m in HEX.finditer(text)]
    taken = _Taken(found)
    for m in BARE.finditer(text):
        if _mixed(m[0]) and not taken.meets(m.start(), m.end()):
            found.append((m.start(), 3, m.end(), m.start(), True))
    if known is not None:
        taken = _Taken(found)
        tokens = [m for m in TOKEN.finditer(text) if len(m[0].strip(ENDS)) >= ASSIGN_VALUE]
        values = [m[0].strip(ENDS) for m in tokens]
        for m, value, there in zip(tokens, values, known(values), strict=True):
            start = m.start() + len(m[0]) - len(m[0].lstrip(ENDS))
            if there and not taken.meets(start, start + len(value)):
                found.append((start, 3, start + len(value), start, False))
    return sorted(found)


class _Taken:
    """Stretches of a text that matches cover."""

    def __init__(self, found: list[tuple]):
        stretches = sorted((s, e) for s, _, e, *_ in found)
        self.starts = [s for s, _ in stretches]
        self.reach = list(itertools.accumulate((e for _, e in stretches), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def value_number(value: str) -> int:
    """Of a value without its ends, the number that bit maps hold."""
    return int(hashlib.sha256(value.encode()).hexdigest()[:16], 16)


def spelled(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


_CANDIDATE = pa.struct(
    [
        ("kind", pa.string()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("secret", pa.int32()),
        ("value_hash", pa.string()),
        ("sure", pa.bool_()),
    ]
)
_FIELDS = [
    ("n_assign", pa.int64()),
    ("n_access", pa.int64()),
    ("n_hex", pa.int64()),
    ("base_sha256", pa.string()),
    ("candidates", pa.list_(_CANDIDATE)),
]


def _row(text: str, known=None) -> tuple:
    found = candidates(text, known)
    counts = Counter(f[1] for f in found)
    base = spelled([f for f in found if f[1] < 3])
    listed = [
        {
            "kind": KINDS[k],
            "start": s,
            "end": e,
            "secret": v,
            "value_hash": hashlib.sha256(text[v:e].strip(ENDS).encode()).hexdigest()[:32],
            "sure": sure,
        }
        for s, k, e, v, sure in found
    ]
    digest = hashlib.sha256(base.encode()).hexdigest()
    return counts[0], counts[1], counts[2], digest, listed


SCAN = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, candidates "
    "array<struct<kind string, start int, end int, secret int, value_hash string, sure boolean>>"
)


def scan(text: Column, bits=None) -> Column:
    """Counts, digest and candidates of a text; ``bits`` is a broadcast map of known values."""

    def work():
        def known(values: list[str]) -> np.ndarray:
            numbers = np.array([value_number(v) for v in values], np.uint64)
            return marked(bits.value, numbers)

        def batch(texts: list[str]) -> pa.Array:
            rows = [_row(t, None if bits is None else known) for t in texts]
            return structs(_FIELDS, [[r[i] for r in rows] for i in range(5)])

        return batch

    return per_text(work, SCAN)(text)


def credential_values(df: DataFrame, text: Column) -> DataFrame:
    """The different ``value_hash`` of all matches of a base kind, stored."""
    found = df.select(scan(text).alias("_made")).select(F.explode("_made.candidates").alias("c"))
    return materialize(found.filter("c.kind <> 'bare'").select("c.value_hash").distinct())


def known_values(spark: SparkSession, values: DataFrame):
    """The broadcast bit map of stored values; of bounded size."""
    number = F.conv(F.left("value_hash", F.lit(16)), 16, -10).cast("bigint").alias("number")
    return spark.sparkContext.broadcast(bit_map(values.select(number), "number"))


def certain(spans: DataFrame, values: DataFrame) -> DataFrame:
    """Exploded candidates without tokens that are no credential's value."""
    unsure = spans.filter("not sure").join(values, "value_hash", "left_semi")
    return spans.filter("sure").unionByName(unsure.select(spans.columns))


def ownership(found: DataFrame) -> DataFrame:
    """``(value_hash, n_owners, n_repositories, example)`` of rows ``(value_hash, repository,
    owner)``: distinct pairs first, so a value copied a million times in one repository
    is one row per task."""
    pairs = found.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("_one"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("_repositories"))
    # A repository belongs to one owner; one under several owners counts with each.
    return owners.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"), F.sum("_repositories").alias("n_repositories")
    ).withColumn(
        "example",
        (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES),
    )


def scanned(
    df: DataFrame,
    key: str,
    text: str = "text",
    repository: str | Column = "source",
    owner: str | Column = "source",
) -> DataFrame:
    """``(key, n_assign, n_access, n_hex, base_sha256, secrets)`` per row of ``df``.

    ``secrets`` are the spans with their ownership: ``array<struct<start, kind, end,
    n_owners, n_repositories, live>>`` by start, then kind. Bare candidates stay only if
    they are owner-specific.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    picked = df.select(
        F.col(key).alias("_key"),
        column(repository).cast("string").alias("repository"),
        column(owner).cast("string").alias("owner"),
        F.col(text).alias("_text"),
    )
    values = credential_values(picked, F.col("_text"))
    bits = known_values(df.sparkSession, values)
    found = materialize(computed(picked, scan(F.col("_text"), bits)).drop("_text"))
    # Rows are told apart by a digest of themselves, so equal rows share their verdict.
    spans = (
        found.filter(F.size("candidates") > 0)
        .select("repository", "owner", "candidates", F.explode("candidates").alias("c"))
        .select("repository", "owner", "candidates", "c.*")
    )
    spans = certain(spans, values)
    owned = ownership(spans)
    judged = (
        spans.select(*_digest(F.col("candidates")), "kind", "start", "end", "value_hash")
        .distinct()
        .join(owned, "value_hash")
        .filter((F.col("kind") != "bare") | ~F.col("example"))
        .groupBy("_h1", "_h2")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "start",
                        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
                        .cast("int")
                        .alias("rank"),
                        "kind",
                        "end",
                        "n_owners",
                        "n_repositories",
                        (~F.col("example")).alias("live"),
                    )
                )
            ).alias("secrets")
        )
    )
    # Rows without a candidate have nothing to look up, and would all meet at one key.
    some = found.filter(F.size("candidates") > 0)
    none = found.filter(F.size("candidates") == 0).withColumn(
        "secrets", F.lit(None).cast(judged.schema["secrets"].dataType)
    )
    looked_up = some.select("*", *_digest(F.col("candidates"))).join(judged, ["_h1", "_h2"], "left")
    return (
        looked_up.drop("_h1", "_h2")
        .unionByName(none)
        .drop("candidates", "repository", "owner")
        .withColumnRenamed("_key", key)
    )


def spans_text(secrets: str = "secrets") -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    spelled_out = F.transform(
        F.col(secrets), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    )
    return F.coalesce(F.array_join(spelled_out, ","), F.lit(""))


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(
    df: DataFrame,
    text: str = "text",
    mark: str = "[SECRET]",
    repository: str | Column = "source",
    owner: str | Column = "source",
) -> DataFrame:
    """``df`` with the values of live-looking credentials in its texts replaced by ``mark``.

    Texts are scanned once; what is live in them comes back by a digest of the text, so
    only texts with a live credential are rewritten.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    values = credential_values(df, F.col(text))
    bits = known_values(df.sparkSession, values)
    found = materialize(
        df.select(
            column(repository).cast("string").alias("repository"),
            column(owner).cast("string").alias("owner"),
            *_digest(F.col(text)),
            scan(F.col(text), bits).alias("_made"),
        )
        .filter(F.size("_made.candidates") > 0)
        .select("repository", "owner", "_h1", "_h2", "_made.candidates")
    )
    spans = found.select("*", F.explode("candidates").alias("c")).drop("candidates").select(
        "repository", "owner", "_h1", "_h2", "c.*"
    )
    spans = certain(spans, values)
    live = (
        spans.select("_h1", "_h2", "value_hash", "secret", "end")
        .distinct()
        .join(ownership(spans).filter(~F.col("example")), "value_hash")
        .groupBy("_h1", "_h2")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("secret").alias("start"), "end"))).alias("_live"))
    )
    few = broadcast_if_bounded(live, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES)

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array(
            [
                None if s is None else cut_out(t, [(x["start"], x["end"]) for x in s], mark)
                for t, s in rows
            ],
            pa.string(),
        )

    # The row stays whole beside the helper columns, so no name of its can clash.
    rows = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), *_digest(F.col(text)))
    only_live = F.when(F.col("_live").isNotNull(), F.col("_text"))
    changed = rows.join(few, ["_h1", "_h2"], "left").select(
        "_row", F.coalesce(rewrite(only_live, "_live"), F.col("_text")).alias("_text")
    )
    return changed.select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`") for c in df.columns]
    )


def _digest(value: Column) -> list[Column]:
    """128 bits that stand for a value in joins."""
    return [F.xxhash64(value).alias("_h1"), F.xxhash64(F.lit(1), value).alias("_h2")]
