"""Training and inference with a featurizer SQL can follow.

Vectors are unit-length counts of a fixed list of tokens, handed in the way a
user's own featurizer is, so clusters, registry, geometry and assignments all have
oracles by brute force over all pairs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.density import Density, density_parameters
from ..operators.features import pattern_words
from ..plans.infer import assign_lines
from ..plans.train import label_patterns, pattern_table, train
from ..sources import Model, Thresholds, annotate
from . import sql
from .clustering import _signatures_sql
from .corpora import doc_lines, page_lines
from .registry import query

# The counted tokens.
TOKENS = [".", ",", "[X]", "<X>", "-", ":", "/", "!", "%", "#", "*", "&", "@", "(", "+"]
PRESET = "preprocessed"
NEAR = Thresholds(0.2, 0.2, 5, 0.6)


def token_counts(patterns):
    """Add ``vec``: how often each listed token occurs, scaled to unit length."""
    words = pattern_words(F.col("pattern"))
    counts = F.transform(
        F.array(*map(F.lit, TOKENS)),
        lambda t: F.size(F.filter("_words", lambda w: w == t)).cast("double"),
    )
    norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
    return (
        patterns.withColumn("_words", words)
        .withColumn("_counts", counts)
        .withColumn("_norm", norm)
        .withColumn(
            "vec", F.transform("_counts", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x))
        )
        .drop("_words", "_counts", "_norm")
    )


def token_vector(pattern: str) -> str:
    """The same vector as a SQL expression."""
    tokens = ", ".join(f"'{t}'" for t in TOKENS)
    counts = (
        f"list_transform([{tokens}], lambda t: CAST(len(list_filter("
        f"string_split({pattern}, ' '), lambda w: w = t)) AS DOUBLE))"
    )
    return (
        f"list_transform([{counts}], lambda c: list_transform(c, lambda x: "
        "x / greatest(sqrt(list_dot_product(c, c)), 1e-9)))[1]"
    )


def _labels(p: Density, vector=None, corpus: str = f"{sql.DOC_LINES}, {sql.signed('doc_lines')}") -> str:
    vector = (vector or token_vector)("pattern")
    return f"""WITH RECURSIVE {corpus},
  counted AS MATERIALIZED (SELECT pattern, count(*) AS weight, min(pos) AS first_pos
    FROM signed GROUP BY pattern),
  points AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first_pos) - 1 AS point_id,
    {vector} AS vec FROM counted),
  near AS MATERIALIZED (SELECT a.point_id AS a, b.point_id AS b, b.weight FROM points a
    CROSS JOIN points b WHERE list_distance(a.vec, b.vec) <= {p.epsilon} + 1e-9),
  cores AS MATERIALIZED (SELECT a AS point_id FROM near GROUP BY a
    HAVING sum(weight) > {p.min_samples}),
  -- An edge to the lowest neighbour and one per vector class keep the search small.
  classes AS MATERIALIZED (SELECT point_id, min(point_id) OVER (PARTITION BY vec) AS site
    FROM points SEMI JOIN cores USING (point_id)),
  sites AS MATERIALIZED (SELECT DISTINCT site FROM classes),
  edges AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN sites ON a = site
    SEMI JOIN (SELECT site AS s FROM sites) ON b = s),
  reach(src, dst) AS (SELECT site, site FROM sites
    UNION SELECT src, b FROM reach JOIN edges ON dst = a),
  parts AS (SELECT src AS site, min(dst) AS component FROM reach GROUP BY src),
  members AS MATERIALIZED (SELECT point_id, component, weight FROM classes
    JOIN parts USING (site) JOIN points USING (point_id)),
  kept AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster_id
    FROM members GROUP BY component HAVING sum(weight) >= {p.min_cluster_size}),
  labels AS MATERIALIZED (SELECT pattern, weight, first_pos, vec, point_id,
      CAST(coalesce(cluster_id, -1) AS BIGINT) AS cluster_id
    FROM points LEFT JOIN (SELECT point_id, component FROM members) USING (point_id)
      LEFT JOIN kept USING (component))"""


_LABELS = _labels(density_parameters(PRESET))


@query(
    "density_cluster_tokens",
    f"{_LABELS} SELECT pattern, weight, cluster_id FROM labels",
)
def token_clusters(spark, folder):
    patterns = pattern_table(annotate(doc_lines(spark, folder)))
    labels = label_patterns(patterns, density_parameters(PRESET), token_counts)
    return labels.select("pattern", "weight", "cluster_id")


@query(
    "train_tokens_stats",
    f"""{_LABELS} SELECT CAST(sum(weight) AS BIGINT) AS total_logs,
      count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS num_clusters,
      CAST(sum(weight) FILTER (cluster_id = -1) AS BIGINT) AS num_outliers,
      round(sum(weight) FILTER (cluster_id = -1) / sum(weight) * 100, 6) AS outlier_percentage,
      'preprocessed' AS data_type, 'preprocessed' AS aggression_level,
      'less aggressive' AS clustering_approach FROM labels""",
)
def token_stats(spark, folder):
    stats = train(doc_lines(spark, folder), PRESET, token_counts).stats
    return stats.drop("cluster_sizes").withColumn(
        "outlier_percentage", F.round("outlier_percentage", 6)
    )


def _model(labels: str) -> str:
    return f"""{labels}, lines AS (SELECT pos, raw_log, pattern, cluster_id
    FROM signed JOIN labels USING (pattern)),
  {_signatures_sql('lines', '')},
  numbered AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY first_pos) - 1 AS stable_id FROM signatures),
  dims AS (SELECT cluster_id, i, sum(weight * x) / sum(weight) AS x FROM (
      SELECT cluster_id, weight, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM labels)
    GROUP BY cluster_id, i),
  centers AS MATERIALIZED (
    SELECT cluster_id, list(x ORDER BY i) AS center FROM dims GROUP BY cluster_id)"""


_MODEL = _model(_LABELS)
_MODEL_ROWS = """, pairs AS (SELECT a.cluster_id, sum(a.weight * b.weight
        * (1 - list_dot_product(a.vec, b.vec))) AS total
      FROM labels a JOIN labels b ON a.cluster_id = b.cluster_id GROUP BY a.cluster_id),
    zeros AS (SELECT cluster_id, sum(weight) FILTER (list_dot_product(vec, vec) = 0) AS own
      FROM labels GROUP BY cluster_id)
    SELECT CAST(stable_id AS BIGINT) AS stable_id, signature_hash,
      array_to_string(patterns, '|') AS patterns, size AS training_size,
      array_to_string(sample_logs, '|') AS sample_logs,
      round(sqrt(list_dot_product(center, center)), 6) AS centroid_norm,
      round(CASE WHEN size > 1 THEN (total - coalesce(own, 0)) / (size * (size - 1)) ELSE 0 END, 6)
        + 0 AS avg_intra_distance
    FROM numbered JOIN centers USING (cluster_id) JOIN pairs USING (cluster_id)
      JOIN zeros USING (cluster_id)"""


@query("train_tokens_model", _MODEL + _MODEL_ROWS)
def token_model(spark, folder):
    return _model_rows(train(doc_lines(spark, folder), PRESET, token_counts).model)


def _model_rows(model: Model):
    return model.registry.join(model.centroids, "stable_id").select(
        "stable_id",
        "signature_hash",
        F.array_join("patterns", "|").alias("patterns"),
        "training_size",
        F.array_join("sample_logs", "|").alias("sample_logs"),
        F.round("centroid_norm", 6).alias("centroid_norm"),
        (F.round("avg_intra_distance", 6) + 0.0).alias("avg_intra_distance"),
    )


# ---- the same with the default vectors ------------------------------------------------

_DEFAULT_LABELS = _labels(density_parameters(PRESET), sql.default_vector)
_PAGE_LABELS = _labels(
    density_parameters(PRESET),
    sql.default_vector,
    f"{sql.PAGE_LINES}, {sql.signed('page_lines')}",
)


@query("train_model", _model(_PAGE_LABELS) + _MODEL_ROWS)
def default_model(spark, folder):
    """Training with the default vectors, on the page lines."""
    return _model_rows(train(page_lines(spark, folder), PRESET).model)


@query(
    "density_cluster_patterns",
    f"""{_labels(density_parameters("moderate"), sql.default_vector)}
    SELECT pattern, weight, cluster_id FROM labels""",
)
def default_clusters(spark, folder):
    patterns = pattern_table(annotate(doc_lines(spark, folder)))
    labels = label_patterns(patterns, density_parameters("moderate"))
    return labels.select("pattern", "weight", "cluster_id")


_STATS_ROW = """ SELECT CAST(sum(weight) AS BIGINT) AS total_logs,
      count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS num_clusters,
      CAST(sum(weight) FILTER (cluster_id = -1) AS BIGINT) AS num_outliers FROM labels"""


@query("train_stats", _DEFAULT_LABELS + _STATS_ROW)
def default_stats(spark, folder):
    stats = train(doc_lines(spark, folder), PRESET).stats
    return stats.select("total_logs", "num_clusters", "num_outliers")


_PAGE_SIGNED = sql.signed("page_lines", "page_signed")
_INFERRED = f"""{_MODEL}, {sql.PAGE_LINES}, {_PAGE_SIGNED},
  page_patterns AS (SELECT DISTINCT pattern, {token_vector('pattern')} AS vec FROM page_signed),
  compared AS (SELECT pattern, stable_id, CASE WHEN list_dot_product(vec, vec) = 0
      OR list_dot_product(center, center) = 0 THEN 1
      ELSE 1 - list_cosine_similarity(vec, center) END AS distance
    FROM page_patterns CROSS JOIN numbered JOIN centers USING (cluster_id)),
  nearest AS (SELECT * FROM compared QUALIFY row_number() OVER (
    PARTITION BY pattern ORDER BY round(distance, 9), stable_id) = 1)
  SELECT pos, CAST(CASE WHEN distance < {NEAR.primary_distance} THEN stable_id ELSE -1 END AS BIGINT)
    AS stable_id, CASE WHEN distance < {NEAR.primary_distance} THEN 'direct' ELSE 'outlier' END
    AS match_kind, round(distance, 6) AS distance
  FROM page_signed JOIN nearest USING (pattern)"""


def _inferred(spark, folder, per_pattern: bool):
    model = train(doc_lines(spark, folder), PRESET, token_counts).model
    near = Model(model.registry, model.centroids, model.samples, NEAR)
    lines = page_lines(spark, folder).select("pos", "raw_log")
    assigned = assign_lines(lines, near, token_counts, per_pattern)
    return assigned.select(
        "pos", "stable_id", "match_kind", F.round("distance", 6).alias("distance")
    )


@query("infer_tokens", _INFERRED)
def token_inference(spark, folder):
    """Page lines assigned to the documents' clusters, one pattern at a time."""
    return _inferred(spark, folder, True)


@query("infer_tokens_narrow", _INFERRED)
def narrow_token_inference(spark, folder):
    """The same line by line, without any shuffle of the lines."""
    return _inferred(spark, folder, False)


_DRAWN = f"""{_model(_labels(density_parameters("ultra_sensitive"), sql.default_vector))},
  waits AS (SELECT cluster_id, point_id, vec, weight, unnest(range(1, least(weight, 10) + 1)) AS j
    FROM labels WHERE cluster_id <> -1),
  arrivals AS (SELECT cluster_id, point_id, vec, sum(-ln(
      (CAST('0x' || left(md5('17:' || point_id || ':' || j), 12) AS BIGINT) + 1) / 281474976710657.0)
      / (weight - j + 1)) OVER (PARTITION BY point_id ORDER BY j) AS arrival FROM waits),
  drawn AS MATERIALIZED (SELECT stable_id, vec, row_number() OVER (
      PARTITION BY cluster_id ORDER BY arrival, point_id) - 1 AS idx
    FROM arrivals JOIN numbered USING (cluster_id) QUALIFY idx < 10),
  own_centers AS MATERIALIZED (SELECT stable_id, center FROM centers JOIN numbered USING (cluster_id)),
  {sql.PAGE_LINES}, {_PAGE_SIGNED},
  fresh AS MATERIALIZED (SELECT pattern, count(*) AS lines,
    {sql.default_vector('pattern')} AS vec FROM page_signed GROUP BY pattern),
  {sql.matched('fresh', 'own_centers', 'drawn', Thresholds())}
  SELECT match_kind, stable_id, CAST(sum(lines) AS BIGINT) AS lines FROM matched GROUP BY ALL"""


@query("infer_lines", _DRAWN)
def default_inference(spark, folder):
    """A model trained on the documents, applied to the page lines."""
    model = train(doc_lines(spark, folder), preset="ultra_sensitive").model
    lines = page_lines(spark, folder).select("pos", "raw_log")
    return assign_lines(lines, model).groupBy("match_kind", "stable_id").agg(
        F.count(F.lit(1)).alias("lines")
    )
