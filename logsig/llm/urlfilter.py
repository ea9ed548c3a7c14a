"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only.

Each distinct (host, path) is expanded to the expressions a rule for it could have: its
host and every parent domain, times the path prefixes of the lengths that rules have.
Expressions meet rules on the first 32 bits of their digest; the full digest, host and
path then confirm, and the longest rule wins (of equal length the blocking one, then the
first in text order). URLs without a rule get the default verdict.

A null URL or one without ``://`` has an empty host and path and fits no rule, unless a
rule is for the empty host itself. The same address on many rows is expanded once;
repeated rows are answered alike. Rules with a null part are left out; of repeated rules
with different verdicts the blocking one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast up to so many rows of at most so many characters.
BROADCAST_RULES = 100_000
BROADCAST_CHARS = 16 << 20
DEFAULT_VERDICT = "allow"

# Fixed value: the letters that are lower-cased.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def _digest(host: Column, path: Column) -> Column:
    # The separator cannot be part of a host.
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def prepared(rules: DataFrame) -> DataFrame:
    """``(prefix, digest, rule_host, rule_path, verdict)`` per distinct rule."""
    return (
        rules.select(
            F.translate("host", _UPPER, _UPPER.lower()).alias("rule_host"),
            F.col("path").alias("rule_path"),
            "verdict",
        )
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", _prefix(F.col("digest")))
    )


def judged(
    df: DataFrame, url: str, rules: DataFrame, default: str = DEFAULT_VERDICT
) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path joined, null if none) and
    ``verdict``; columns of these names are replaced. ``rules`` are ``(host, path, verdict)``."""
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    parsed = df.select(*own, host.alias("host"), path.alias("path"))
    ready = prepared(rules)
    size = ready.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.length("rule_host") + F.length("rule_path") + 100), F.lit(0)).alias("chars"),
        # Rules' lengths are few: at most as many as the longest address has characters.
        F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    if size.n <= BROADCAST_RULES and size.chars <= BROADCAST_CHARS:
        ready = F.broadcast(ready)
    addresses = parsed.select("host", "path").distinct()
    lengths = F.filter(
        F.array(*map(F.lit, size.lengths)).cast("array<int>"), lambda n: n <= F.length("path")
    )
    expanded = (
        addresses.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("_suffix"))
        .select("host", "path", "_suffix", F.explode(lengths).alias("_length"))
        .withColumn("_start", F.substr("path", F.lit(1), F.col("_length")))
        .withColumn("_digest", _digest(F.col("_suffix"), F.col("_start")))
        .withColumn("_prefix", _prefix(F.col("_digest")))
    )
    confirmed = expanded.join(ready, F.col("_prefix") == F.col("prefix")).filter(
        (F.col("_digest") == F.col("digest"))
        & (F.col("_suffix") == F.col("rule_host"))
        & (F.col("_start") == F.col("rule_path"))
    )
    name = F.concat("rule_host", "rule_path")
    # The first in text order wins a tie, so its order is turned around by taking a minimum.
    best = confirmed.groupBy("host", "path").agg(
        F.min(
            F.struct(
                (-F.length(name)).alias("order"),
                (F.col("verdict") != "block").alias("allows"),
                name.alias("rule"),
                "verdict",
            )
        ).alias("_best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        *own,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
