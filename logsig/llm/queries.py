"""Queries over the standard tables, one per operator, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    attribution,
    bpe,
    collocation,
    decontaminate,
    langid,
    secretscan,
    simhash,
    substrings,
    suffixes,
    toxicity,
    urlfilter,
    whiten,
)
from .common import HELD_OUT, LEARNED, Query, read

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op1_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per line of every document, from one encoding of the document."""
    documents = read(spark, folder, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    counted = attribution.attributed(documents, "text", path, pattern, rule="most")
    return counted.select("doc_id", F.explode_outer("sections").alias("s")).select(
        "doc_id",
        F.col("s.name").cast("int").alias("line"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
        F.col("s.n_tokens").cast("bigint").alias("n_tokens"),
        F.col("s.n_crossing").alias("n_crossing"),
    )


# Host, path and verdict of the rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

URL_FILTER_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest
  FROM pages),
addresses AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
         ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict
  FROM addresses LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM fitting
QUALIFY row_number() OVER (PARTITION BY page_id
  ORDER BY length(rule) DESC NULLS LAST, verdict <> 'block', rule) = 1
"""


@query("op2_url_filter", URL_FILTER_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read(spark, folder, "pages").select("page_id", "url")
    return urlfilter.judged(pages, "url", rules).drop("url")


@query("op3_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.scanned(read(spark, folder, "documents"), "doc_id").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        secretscan.spans_text().alias("spans"),
        F.size(F.filter(F.coalesce("secrets", F.array()), lambda s: s["live"])).alias("n_live"),
    )


@query("op4_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"), "doc_id")
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def toxicity_model(documents: DataFrame, spark: SparkSession, folder: str) -> toxicity.Model:
    labels = read(spark, folder, "labels")
    return toxicity.fit(toxicity.training_sample(documents, labels, LEARNED))


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    model = toxicity_model(documents, spark, folder)
    return toxicity.scored(documents.select("doc_id", "text"), model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted", "offending"
    )


def contaminated(documents: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(
        documents, read(spark, folder, "benchmark"), "doc_id", "item_id"
    )
    joined = F.array_join(F.array_sort(F.coalesce("items", F.array().cast("array<string>"))), ",")
    return (
        found.withColumn("n_hit", decontaminate.covered())
        .withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)).cast("bigint"))
        .withColumn("items_sha256", F.sha2(joined, 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
asked AS (
  SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS phrase
  FROM (SELECT item_id, words, least(13, len(words)) AS size,
               unnest(range(1, len(words) - least(13, len(words)) + 2)) AS s
        FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM asked),
held AS (
  SELECT doc_id, size, s, array_to_string(words[s:s + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s
        FROM d CROSS JOIN sizes)),
hits AS MATERIALIZED (SELECT doc_id, s, size, item_id FROM held JOIN asked USING (size, phrase)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), spark, folder).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


#: Places that the rarest terms of a window may be out of their order and distances.
SLOP = 3


@query("decontamination_near")
def decontamination_near(spark: SparkSession, folder: str) -> DataFrame:
    """The proximity matches of the index of ``op6_decontamination``."""
    return decontaminate.proximity_matches(
        read(spark, folder, "documents"), read(spark, folder, "benchmark"), "doc_id", "item_id", SLOP
    ).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n", "shift")


@query("op9_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(documents, "text", path, pattern).drop("text")


SUBSTRING_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') AS words FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS place
  FROM windows JOIN firsts USING (h) WHERE first_doc < doc_id),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d)
  ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


@query("op7_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(read(spark, folder, "documents"), "doc_id")


@query("op8_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    model = langid.fit(documents, LEARNED)
    return langid.identified(documents.select("doc_id", "text"), model).select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])),
                          lambda a, b: a + b)) AS score
  FROM (SELECT DISTINCT ON (vec_id) * FROM usable WHERE vec_id % 100 = 0) q
  JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER)
         AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op10_nearest", NEAREST_SQL)
def nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", k=10)


@query("op12_whitening")
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whitened(read(spark, folder, "embeddings"), "vec_id", "embedding")


COLLOCATION_SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, doc, piece, regexp_extract_all(p, '[^\x20\x09]+') AS words
  FROM (SELECT lang, doc, unnest(ps) AS p, generate_subscripts(ps, 1) AS piece
        FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents))),
runs AS (
  SELECT lang, size, words[s:s + size - 1] AS ws
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS s
        FROM pieces, (VALUES (1), (2), (3), (4)) AS t(size) WHERE len(words) >= size)),
f AS MATERIALIZED (SELECT lang, size, ws, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT lang, size, ws, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (
  SELECT c.lang, c.size, c.ws, c.a, k, x.a AS l, y.a AS r,
         CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k]
  JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:c.size]),
weakest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inside AS (
  SELECT lang, ws[s:s + m - 1] AS ws, max(a) AS longer
  FROM (SELECT lang, ws, a, size, m, unnest(range(1, size - m + 2)) AS s
        FROM (SELECT lang, ws, a, size, unnest(range(2, size)) AS m FROM f WHERE size > 2))
  GROUP BY ALL),
kept AS (
  SELECT w.*, array_to_string(w.ws, ' ') AS phrase FROM weakest w LEFT JOIN inside i USING (lang, ws)
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
  phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocation.collocations(read(spark, folder, "documents"), "text", "lang")


REPEATED_BYTES_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS MATERIALIZED (
  SELECT doc, s, md5(substr(h, 2 * s + 1, 400)) AS k
  FROM (SELECT doc, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM d WHERE len(h) >= 400)),
again AS (SELECT k FROM strings GROUP BY k HAVING count(*) > 1),
hits AS (
  SELECT doc, s, max(s + 200) OVER (PARTITION BY doc ORDER BY s
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM strings SEMI JOIN again USING (k)),
numbered AS (
  SELECT doc, s, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc ORDER BY s) AS run FROM hits),
runs AS (SELECT doc, run, min(s) AS a, max(s) + 200 AS b FROM numbered GROUP BY doc, run),
bounds AS (
  SELECT doc, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone, count(*) AS n
  FROM runs GROUP BY doc)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
  coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE
    array_to_string(list_transform(range(0, n + 1), lambda i:
      substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * b[i] + 1 END,
        CASE WHEN i = n THEN len(h) ELSE 2 * a[i + 1] END
        - CASE WHEN i = 0 THEN 0 ELSE 2 * b[i] END)), '') END)) AS kept_sha256
FROM d LEFT JOIN bounds USING (doc)
"""


@query("op11_suffix_dedup", REPEATED_BYTES_SQL)
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", "text")
    return suffixes.without_repeats(documents, "doc_id", keep=False).drop("text")
