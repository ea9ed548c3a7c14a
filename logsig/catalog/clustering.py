"""Aggregates, stable ids, vectors and density clusters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clusters import (
    cluster_distribution,
    cluster_samples,
    cluster_signatures,
    cluster_stats,
    not_outlier,
    pattern_counts,
    pattern_uniqueness,
    topk_patterns,
)
from ..operators.density import (
    DENSITY_PRESETS,
    Density,
    connected_components,
    density_cluster,
    density_parameters,
)
from ..operators.hierarchy import density_hierarchy
from ..operators.features import symbol_features
from ..operators.registry import (
    apply_mapping,
    build_registry,
    map_signatures,
    registry_summary,
    stable_ids,
)
from ..operators.vectors import (
    BROADCAST_COMPONENTS,
    assign_fallback,
    assign_stable_cluster,
    assignment_summary,
    centroid_nearest,
    cluster_geometry,
    cluster_sample_vectors,
    knn_vote,
    nearest_blocked,
    nearest_references,
)
from ..plans.infer import assign_lines
from ..plans.train import label_patterns, pattern_table, train
from ..sources import Model, Thresholds, annotate
from . import sql
from .corpora import doc_lines, embeddings, event_lines, labelled_docs, page_lines, table
from .registry import query

_LABELLED = f"""WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}, labelled AS (
  SELECT pos, raw_log, pattern, CASE WHEN cluster = 0 THEN -1 ELSE cluster END AS cluster_id
  FROM signed)"""
_COUNTS = """counts AS (
  SELECT cluster_id, pattern, count(*) AS n, min(pos) AS first_pos FROM labelled
  WHERE cluster_id <> -1 GROUP BY ALL)"""


def _signatures_sql(rows: str, prefix: str) -> str:
    return f"""{prefix}counts AS (
      SELECT cluster_id, pattern, count(*) AS n, min(pos) AS first_pos FROM {rows}
      WHERE cluster_id <> -1 GROUP BY ALL),
    {prefix}tops AS (SELECT *, row_number() OVER (PARTITION BY cluster_id
        ORDER BY n DESC, first_pos) AS rank FROM {prefix}counts),
    {prefix}patterns AS (SELECT cluster_id, list(pattern ORDER BY rank) AS patterns,
        left(md5(string_agg(pattern, '|' ORDER BY pattern)), 12) AS signature_hash
      FROM {prefix}tops WHERE rank <= 3 GROUP BY cluster_id),
    {prefix}firsts AS (SELECT cluster_id, pos, raw_log, row_number() OVER (
        PARTITION BY cluster_id ORDER BY pos) AS rank FROM {rows}),
    {prefix}samples AS (SELECT cluster_id, list(raw_log ORDER BY rank) AS sample_logs
      FROM {prefix}firsts WHERE rank <= 2 GROUP BY cluster_id),
    {prefix}sizes AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS size,
        min(first_pos) AS first_pos FROM {prefix}counts GROUP BY cluster_id),
    {prefix}signatures AS (SELECT cluster_id, signature_hash, patterns, size, sample_logs, first_pos
      FROM {prefix}patterns JOIN {prefix}samples USING (cluster_id)
      JOIN {prefix}sizes USING (cluster_id))"""


_SIGNATURES = f"{_LABELLED}, {_signatures_sql('labelled', '')}"
REGISTRY_SQL = f"""{_SIGNATURES}, registry AS (
  SELECT *, row_number() OVER (ORDER BY first_pos) - 1 AS stable_id FROM signatures)"""


def two_sets(fresh: str) -> str:
    """Even documents make the registry, ``fresh`` rows are mapped onto it."""
    return f"""{_LABELLED},
  training AS (SELECT * FROM labelled WHERE (pos // 4294967296) % 2 = 0),
  fresh AS ({fresh}),
  {_signatures_sql('training', 't_')}, {_signatures_sql('fresh', 'f_')},
  known AS (SELECT signature_hash, max(id) AS known_id FROM (
    SELECT signature_hash, row_number() OVER (ORDER BY first_pos) - 1 AS id FROM t_signatures)
    GROUP BY signature_hash),
  unseen AS (SELECT signature_hash, min(first_pos) AS first_pos FROM f_signatures
    ANTI JOIN known USING (signature_hash) GROUP BY signature_hash),
  numbered AS (SELECT signature_hash, row_number() OVER (ORDER BY first_pos) - 1
    + (SELECT count(*) FROM t_signatures) AS new_id FROM unseen),
  mapping AS (SELECT cluster_id, coalesce(known_id, new_id) AS stable_id,
      known_id IS NULL AS is_new_pattern
    FROM f_signatures LEFT JOIN known USING (signature_hash)
    LEFT JOIN numbered USING (signature_hash))"""


_TWO_SETS = two_sets("""SELECT pos, raw_log, pattern, CASE WHEN cluster_id = -1 THEN -1
    ELSE cluster_id + length(raw_log) % 2 * 100 END AS cluster_id FROM labelled""")


def _even_documents(rows):
    return rows.filter(F.floor(F.col("pos") / (1 << 32)) % 2 == 0)


def _fresh(rows):
    odd = F.char_length("raw_log") % 2 * 100
    return rows.withColumn(
        "cluster_id", F.when(F.col("cluster_id") == -1, -1).otherwise(F.col("cluster_id") + odd)
    )


def _mapped(spark, folder):
    rows = labelled_docs(spark, folder)
    registry = build_registry(cluster_signatures(_even_documents(rows)))
    fresh = _fresh(rows)
    return fresh, *map_signatures(cluster_signatures(fresh), registry)


# ---- aggregates ---------------------------------------------------------------


def _uniqueness(corpus: str, table: str) -> str:
    return f"""WITH {corpus}, {sql.signed(table)}, t AS (
      SELECT count(*) AS lines, count(DISTINCT pattern) AS distinct_patterns FROM signed)
    SELECT lines, distinct_patterns, distinct_patterns / lines AS uniqueness,
      distinct_patterns / lines < 0.05 AS low_variation,
      distinct_patterns / lines < 0.01 AS uniform FROM t"""


@query("pattern_uniqueness", _uniqueness(sql.DOC_LINES, "doc_lines"))
def uniqueness_docs(spark, folder):
    return pattern_uniqueness(annotate(doc_lines(spark, folder)))


@query("pattern_uniqueness_events", _uniqueness(sql.EVENT_LINES, "event_lines"))
def uniqueness_events(spark, folder):
    return pattern_uniqueness(annotate(event_lines(spark, folder)))


@query("filter_outlier", f"{_LABELLED} SELECT pos, cluster_id FROM labelled WHERE cluster_id <> -1")
def without_outliers(spark, folder):
    rows = labelled_docs(spark, folder)
    return rows.filter(not_outlier(F.col("cluster_id"))).select("pos", "cluster_id")


@query(
    "cluster_stats",
    f"""{_LABELLED}, sizes AS (
      SELECT cluster_id, count(*) AS size FROM labelled GROUP BY cluster_id)
    SELECT CAST(sum(size) AS BIGINT) AS total_logs,
      count(*) FILTER (cluster_id <> -1) AS num_clusters,
      CAST(sum(size) FILTER (cluster_id = -1) AS BIGINT) AS num_outliers,
      sum(size) FILTER (cluster_id = -1) / sum(size) * 100 AS outlier_percentage,
      string_agg(cluster_id || '=' || size, ',' ORDER BY CAST(cluster_id AS VARCHAR))
        AS cluster_sizes,
      'raw' AS data_type, 'moderate' AS aggression_level,
      'aggressive' AS clustering_approach FROM sizes""",
)
def stats(spark, folder):
    row = cluster_stats(labelled_docs(spark, folder), aggression_level="moderate")
    entries = F.transform(
        F.map_entries("cluster_sizes"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return row.withColumn("cluster_sizes", F.array_join(entries, ","))


@query(
    "cluster_distribution",
    f"{_LABELLED} SELECT cluster_id, count(*) AS size FROM labelled GROUP BY cluster_id",
)
def distribution(spark, folder):
    return cluster_distribution(labelled_docs(spark, folder))


@query(
    "sort_clusters",
    f"""{_LABELLED} SELECT cluster_id, min(pos) AS first_pos, count(*) AS size
    FROM labelled GROUP BY cluster_id ORDER BY cluster_id""",
)
def sorted_clusters(spark, folder):
    return cluster_distribution(labelled_docs(spark, folder), first="pos")


@query(
    "cluster_samples",
    f"""{_LABELLED}, f AS (SELECT *, row_number() OVER (
      PARTITION BY cluster_id ORDER BY pos) AS rank FROM labelled)
    SELECT cluster_id, string_agg(raw_log, '|' ORDER BY rank) AS sample_logs
    FROM f WHERE rank <= 2 GROUP BY cluster_id""",
)
def samples(spark, folder):
    return cluster_samples(labelled_docs(spark, folder)).withColumn(
        "sample_logs", F.array_join("sample_logs", "|")
    )


@query(
    "topk_patterns",
    f"""{_LABELLED}, {_COUNTS}, r AS (SELECT *, row_number() OVER (
      PARTITION BY cluster_id ORDER BY n DESC, first_pos) AS rank FROM counts)
    SELECT cluster_id, pattern, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def top_patterns(spark, folder):
    counts = pattern_counts(labelled_docs(spark, folder))
    return topk_patterns(counts).select("cluster_id", "pattern", "n", "rank")


@query(
    "cluster_signatures",
    f"""{_SIGNATURES} SELECT cluster_id, signature_hash, array_to_string(patterns, '|') AS patterns,
      size, array_to_string(sample_logs, '|') AS sample_logs, first_pos FROM signatures""",
)
def signatures(spark, folder):
    return cluster_signatures(labelled_docs(spark, folder)).select(
        "cluster_id",
        "signature_hash",
        F.array_join("patterns", "|").alias("patterns"),
        "size",
        F.array_join("sample_logs", "|").alias("sample_logs"),
        "first_pos",
    )


# ---- stable ids -----------------------------------------------------------------


@query("stable_ids", f"{REGISTRY_SQL} SELECT cluster_id, stable_id FROM registry")
def numbered(spark, folder):
    return stable_ids(cluster_signatures(labelled_docs(spark, folder)))


@query("stable_ids_bucketed", f"{REGISTRY_SQL} SELECT cluster_id, stable_id FROM registry")
def bucketed_ids(spark, folder):
    """The same numbers, ranked in quantile buckets as for very many clusters."""
    return stable_ids(cluster_signatures(labelled_docs(spark, folder)), direct=0)


@query(
    "map_signatures",
    f"{_TWO_SETS} SELECT cluster_id, CAST(stable_id AS BIGINT) AS stable_id, is_new_pattern FROM mapping",
)
def mapping(spark, folder):
    return _mapped(spark, folder)[1]


@query(
    "map_signatures_registry",
    f"""{_TWO_SETS}, added AS (
      SELECT new_id AS stable_id, signature_hash, CAST(0 AS BIGINT) AS training_size,
        (SELECT arg_min(size, f.first_pos) FROM f_signatures f
         WHERE f.signature_hash = numbered.signature_hash) AS inference_size FROM numbered)
    SELECT CAST(row_number() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS stable_id, signature_hash,
      size AS training_size, CAST(NULL AS BIGINT) AS inference_size FROM t_signatures
    UNION ALL SELECT CAST(stable_id AS BIGINT), signature_hash, training_size, inference_size
    FROM added""",
)
def mapped_registry(spark, folder):
    return _mapped(spark, folder)[2].select(
        "stable_id", "signature_hash", "training_size", "inference_size"
    )


@query(
    "apply_mapping",
    f"""{_TWO_SETS} SELECT pos, CAST(CASE WHEN cluster_id = -1 THEN -1 ELSE stable_id END AS BIGINT)
      AS stable_id FROM fresh LEFT JOIN mapping USING (cluster_id)""",
)
def applied(spark, folder):
    rows, ids, _ = _mapped(spark, folder)
    return apply_mapping(rows, ids).select("pos", "stable_id")


@query(
    "registry_summary",
    f"""{_TWO_SETS} SELECT (SELECT count(*) FROM t_signatures) + count(*) AS total_stable_ids,
      (SELECT count(*) FROM t_signatures) AS training_clusters,
      count(*) AS new_patterns_discovered,
      (SELECT count(*) FROM t_signatures) + count(*) AS next_available_id,
      false AS has_centroids, false AS distance_based_enabled FROM numbered""",
)
def summary(spark, folder):
    return registry_summary(_mapped(spark, folder)[2])


# ---- vectors --------------------------------------------------------------------

_EMB = """WITH emb AS MATERIALIZED (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""
_CENTROIDS = f"""{_EMB}, dims AS (
  SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vec) AS x,
    generate_subscripts(vec, 1) AS i FROM emb) GROUP BY label, i),
  centroids AS MATERIALIZED (
    SELECT label AS stable_id, list(x ORDER BY i) AS center FROM dims GROUP BY label),
  samples AS MATERIALIZED (
    SELECT label AS stable_id, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS idx,
      vec AS sample FROM emb QUALIFY idx < 10),
  distances AS (SELECT row_id, vec, stable_id,
      1 - list_cosine_similarity(vec, center) AS distance FROM emb CROSS JOIN centroids),
  nearest AS MATERIALIZED (SELECT row_id, vec, stable_id, distance FROM distances
    QUALIFY row_number() OVER (PARTITION BY row_id
      ORDER BY round(distance, 9), stable_id) = 1),
  sample_distances AS (SELECT row_id, n.stable_id AS candidate, s.stable_id, s.idx,
      1 - list_cosine_similarity(vec, sample) AS distance
    FROM nearest n CROSS JOIN samples s),
  knn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_id
      ORDER BY round(distance, 9), stable_id, idx) AS rank FROM sample_distances
    QUALIFY rank <= 5),
  votes AS MATERIALIZED (SELECT row_id, candidate, count(*) FILTER (stable_id = candidate) / 5
    AS vote FROM knn GROUP BY ALL)"""
LIMITS = Thresholds(0.6, 0.75, 5, 0.4)


def _embedding_model(spark, folder) -> tuple:
    vectors = embeddings(spark, folder)
    centroids = cluster_geometry(vectors).select(
        F.col("label").alias("stable_id"), F.col("centroid").alias("vec")
    )
    drawn = cluster_sample_vectors(vectors, "row_id", seed=None)
    chosen = drawn.select(F.col("label").alias("stable_id"), "idx", "vec")
    return vectors, Model(centroids, centroids, chosen, LIMITS)


@query(
    "cluster_centroid",
    f"""{_CENTROIDS} SELECT CAST(stable_id AS INTEGER) AS label,
      CAST(unnest(range(len(center))) AS INTEGER) AS dim,
      round(unnest(center), 6) AS value FROM centroids""",
)
def centroid(spark, folder):
    shape = cluster_geometry(embeddings(spark, folder))
    return shape.select("label", F.posexplode("centroid").alias("dim", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "avg_intra_distance",
    f"""{_CENTROIDS}, pairs AS (SELECT a.label,
        avg(1 - list_cosine_similarity(a.vec, b.vec)) AS avg_intra_distance
      FROM emb a JOIN emb b ON a.label = b.label AND a.row_id < b.row_id GROUP BY a.label),
    sizes AS (SELECT label, count(*) AS size FROM emb GROUP BY label)
    SELECT label, size, round(sqrt(list_dot_product(center, center)), 6) AS centroid_norm,
      round(avg_intra_distance, 6) AS avg_intra_distance
    FROM sizes JOIN pairs USING (label) JOIN centroids ON stable_id = label""",
)
def intra_distance(spark, folder):
    return cluster_geometry(embeddings(spark, folder)).select(
        "label",
        "size",
        F.round("centroid_norm", 6).alias("centroid_norm"),
        F.round("avg_intra_distance", 6).alias("avg_intra_distance"),
    )


@query(
    "cluster_sample_vectors",
    """SELECT label, vec_id AS row_id, CAST(row_number() OVER (
      PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS idx
    FROM embeddings QUALIFY idx < 10""",
)
def sample_vectors(spark, folder):
    drawn = cluster_sample_vectors(embeddings(spark, folder), "row_id", seed=None)
    return drawn.select("label", "row_id", "idx")


@query(
    "cluster_sample_vectors_seeded",
    """SELECT label, vec_id AS row_id, CAST(row_number() OVER (
      PARTITION BY label ORDER BY md5('17:' || vec_id), vec_id) - 1 AS INTEGER) AS idx
    FROM embeddings QUALIFY idx < 10""",
)
def seeded_sample_vectors(spark, folder):
    drawn = cluster_sample_vectors(embeddings(spark, folder), "row_id")
    return drawn.select("label", "row_id", "idx")


@query(
    "centroid_nearest",
    f"""{_CENTROIDS} SELECT row_id, CAST(stable_id AS BIGINT) AS stable_id,
      round(distance, 6) AS distance FROM nearest""",
)
def nearest(spark, folder):
    vectors, model = _embedding_model(spark, folder)
    return centroid_nearest(vectors, model.centroids).withColumn(
        "distance", F.round("distance", 6)
    )


_KNN = f"""{_CENTROIDS} SELECT row_id, CAST(rank AS INTEGER) AS rank,
      CAST(stable_id AS BIGINT) AS stable_id, CAST(idx AS BIGINT) AS idx,
      round(distance, 6) AS distance FROM knn"""


@query("nearest_blocked", _KNN)
def blocked_neighbours(spark, folder):
    """Neighbours found block by block, as for a model too large to broadcast."""
    vectors, model = _embedding_model(spark, folder)
    near = nearest_blocked(vectors, "row_id", model.samples, 5, "vec", 7, 60)
    return near.select(
        "row_id", "rank", "stable_id", "idx", F.round("distance", 6).alias("distance")
    )


@query("knn_topk", _KNN)
def neighbours(spark, folder):
    vectors, model = _embedding_model(spark, folder)
    return nearest_references(vectors, model.samples, 5).withColumn(
        "distance", F.round("distance", 6)
    )


@query(
    "knn_vote",
    f"""{_CENTROIDS} SELECT row_id, CAST(candidate AS BIGINT) AS stable_id, vote FROM votes""",
)
def vote(spark, folder):
    vectors, model = _embedding_model(spark, folder)
    near = centroid_nearest(vectors, model.centroids)
    return knn_vote(near.join(vectors.select("row_id", "vec"), "row_id"), model.samples)


_ASSIGNED = f"""{_CENTROIDS}, assigned AS (
  SELECT row_id, stable_id AS candidate, distance, vote,
    CASE WHEN distance < {LIMITS.primary_distance} THEN 'direct'
         WHEN distance < {LIMITS.secondary_distance} AND vote >= {LIMITS.knn_confidence} THEN 'knn'
         ELSE 'outlier' END AS match_kind
  FROM nearest JOIN votes USING (row_id))"""


_ASSIGNMENT = f"""{_ASSIGNED} SELECT row_id, CAST(CASE WHEN match_kind = 'outlier' THEN -1 ELSE candidate END
      AS BIGINT) AS stable_id, CAST(candidate AS BIGINT) AS candidate,
      round(distance, 6) AS distance, match_kind FROM assigned"""


@query("assign_stable_cluster", _ASSIGNMENT)
def assignment(spark, folder):
    return _assignment(spark, folder, "row_id", BROADCAST_COMPONENTS)


@query("assign_blocked", _ASSIGNMENT)
def blocked_assignment(spark, folder):
    """The same with a model that counts as too large to broadcast, rows without an id."""
    return _assignment(spark, folder, None, 0)


def _assignment(spark, folder, row_id, components):
    vectors, model = _embedding_model(spark, folder)
    return assign_stable_cluster(vectors, model, row_id, "vec", components).select(
        "row_id", "stable_id", "candidate", F.round("distance", 6).alias("distance"), "match_kind"
    )


@query(
    "assign_fallback",
    """SELECT vec_id AS row_id, CAST(-1 AS BIGINT) AS stable_id, 'outlier' AS match_kind
    FROM embeddings""",
)
def fallback(spark, folder):
    return assign_fallback(embeddings(spark, folder)).select("row_id", "stable_id", "match_kind")


@query(
    "assignment_summary",
    f"""{_ASSIGNED} SELECT match_kind, count(row_id) AS size
    FROM (VALUES ('direct'), ('knn'), ('outlier')) k(match_kind) LEFT JOIN assigned USING (match_kind)
    GROUP BY match_kind""",
)
def assignment_totals(spark, folder):
    vectors, model = _embedding_model(spark, folder)
    return assignment_summary(assign_stable_cluster(vectors, model, "row_id"))


# ---- density and training ---------------------------------------------------------

RADIUS = Density(min_cluster_size=5, min_samples=2, epsilon=1.15)


@query(
    "density_presets",
    """WITH p(preset, min_cluster_size, min_samples, epsilon) AS (VALUES
      ('ultra_sensitive', 2, 1, CAST(0.05 AS DOUBLE)), ('preprocessed', 5, 3, 0.1),
      ('moderate', 15, 10, 0.2), ('high', 25, 15, 0.3)) SELECT label, preset, min_cluster_size, min_samples, epsilon,
      n >= min_cluster_size AS can_form_cluster
    FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) CROSS JOIN p""",
)
def presets(spark, folder):
    """Which presets would let a label's vectors form a cluster at all."""
    sizes = embeddings(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    each = [
        F.struct(
            F.lit(name).alias("preset"),
            F.lit(density_parameters(name).min_cluster_size).alias("min_cluster_size"),
            F.lit(density_parameters(name).min_samples).alias("min_samples"),
            F.lit(density_parameters(name).epsilon).alias("epsilon"),
        )
        for name in DENSITY_PRESETS
    ]
    return sizes.select("label", "n", F.inline(F.array(*each))).select(
        "label",
        "preset",
        "min_cluster_size",
        "min_samples",
        "epsilon",
        (F.col("n") >= F.col("min_cluster_size")).alias("can_form_cluster"),
    )


_DENSITY = f"""{_EMB.replace('WITH', 'WITH RECURSIVE')}, near AS MATERIALIZED (
      SELECT a.row_id AS a, b.row_id AS b FROM emb a CROSS JOIN emb b
      WHERE list_distance(a.vec, b.vec) <= {RADIUS.epsilon}),
    cores AS MATERIALIZED (SELECT a AS row_id FROM near GROUP BY a
      HAVING count(*) > {RADIUS.min_samples}),
    edges AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT row_id FROM cores)
      AND b IN (SELECT row_id FROM cores)),
    reach(src, dst) AS (SELECT row_id, row_id FROM cores
      UNION SELECT src, b FROM reach JOIN edges ON dst = a),
    parts AS (SELECT src AS row_id, min(dst) AS component FROM reach GROUP BY src),
    kept AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster_id
      FROM parts GROUP BY component HAVING count(*) >= {RADIUS.min_cluster_size})
    SELECT row_id AS point_id, CAST(coalesce(cluster_id, -1) AS BIGINT) AS cluster_id
    FROM emb LEFT JOIN parts USING (row_id) LEFT JOIN kept USING (component)"""


@query("density_cluster", _DENSITY)
def density_embeddings(spark, folder):
    points = embeddings(spark, folder).select(
        F.col("row_id").alias("point_id"), "vec", F.lit(1).cast("bigint").alias("weight")
    )
    return density_cluster(points, RADIUS).select("point_id", "cluster_id")


@query("density_cluster_cells", _DENSITY)
def density_by_cells(spark, folder):
    """The same through cells and rounds of label spreading, as for very many vectors."""
    points = embeddings(spark, folder).select(
        F.col("row_id").alias("point_id"), "vec", F.lit(1).cast("bigint").alias("weight")
    )
    labels = density_cluster(points, RADIUS, block_points=0, direct_edges=0)
    return labels.select("point_id", "cluster_id")


RADII = (0.9, 1.0, 1.1, 1.15)
SMALL = Density(min_cluster_size=3, min_samples=1, epsilon=0.9)


def _grid_sql(radii, least: int, samples: int) -> str:
    """Clusters at each radius by brute force, then excess of mass over the grid."""
    text = f"""{_EMB.replace('WITH', 'WITH RECURSIVE')}, apart AS MATERIALIZED (
      SELECT a.row_id AS a, b.row_id AS b, list_distance(a.vec, b.vec) AS d
      FROM emb a CROSS JOIN emb b WHERE list_distance(a.vec, b.vec) <= {radii[-1]})"""
    for g, r in enumerate(radii):
        text += f""",
    cores{g} AS MATERIALIZED (SELECT a AS row_id FROM apart WHERE d <= {r} GROUP BY a
      HAVING count(*) > {samples}),
    edges{g} AS MATERIALIZED (SELECT a, b FROM apart WHERE d <= {r}
      AND a IN (SELECT row_id FROM cores{g}) AND b IN (SELECT row_id FROM cores{g})),
    reach{g}(src, dst) AS (SELECT row_id, row_id FROM cores{g}
      UNION SELECT src, b FROM reach{g} JOIN edges{g} ON dst = a),
    parts{g} AS MATERIALIZED (SELECT src AS row_id, min(dst) AS c FROM reach{g} GROUP BY src),
    held{g} AS MATERIALIZED (SELECT c, count(*) AS mass FROM parts{g} GROUP BY c
      HAVING count(*) >= {least})"""
    for g, r in enumerate(radii):
        gain = f"(1.0::DOUBLE / {r} - 1.0::DOUBLE / {radii[min(g + 1, len(radii) - 1)]})"
        parent = f"(SELECT p.c FROM parts{g + 1} p WHERE p.row_id = h.c)" if g + 1 < len(radii) else "NULL"
        inner = (
            f"(SELECT parent, count(*) AS n, sum(chain) AS chain, sum(below) AS below, "
            f"sum(greatest(chain, below)) AS best FROM scored{g - 1} GROUP BY parent)"
            if g
            else "(SELECT NULL::BIGINT AS parent, 0 AS n, 0.0 AS chain, 0.0 AS below, 0.0 AS best)"
        )
        text += f""",
    scored{g} AS MATERIALIZED (SELECT h.c, {parent} AS parent,
      mass * {gain} + CASE WHEN i.n = 1 THEN i.chain ELSE 0 END AS chain,
      CASE WHEN i.n = 1 THEN i.below ELSE coalesce(i.best, 0) END AS below
      FROM held{g} h LEFT JOIN {inner} i ON i.parent = h.c)"""
    for g in reversed(range(len(radii))):
        seen = "TRUE" if g == len(radii) - 1 else (
            f"(parent IS NULL OR parent IN (SELECT c FROM looked{g + 1} WHERE NOT wins))"
        )
        text += f""",
    looked{g} AS MATERIALIZED (SELECT c, chain, round(chain, 9) >= round(below, 9) AS wins
      FROM scored{g} WHERE {seen})"""
    taken = " UNION ALL ".join(
        f"SELECT row_id, c, {r}::DOUBLE AS radius, chain FROM looked{g} JOIN parts{g} USING (c) WHERE wins"
        for g, r in enumerate(radii)
    )
    return f"""{text}, taken AS MATERIALIZED ({taken}),
    numbers AS (SELECT radius, c, row_number() OVER (ORDER BY min(row_id)) - 1 AS cluster_id
      FROM taken GROUP BY radius, c)
    SELECT emb.row_id AS point_id, CAST(coalesce(cluster_id, -1) AS BIGINT) AS cluster_id,
      CAST(radius AS DOUBLE) AS radius, round(chain, 6) AS stability
    FROM emb LEFT JOIN (taken JOIN numbers USING (radius, c)) USING (row_id)"""


_HIERARCHY = _grid_sql(RADII, SMALL.min_cluster_size, SMALL.min_samples)


def _by_hierarchy(spark, folder, **forced):
    points = embeddings(spark, folder).select(
        F.col("row_id").alias("point_id"), "vec", F.lit(1).cast("bigint").alias("weight")
    )
    labels = density_hierarchy(points, SMALL, RADII, **forced)
    return labels.select("point_id", "cluster_id", "radius", F.round("stability", 6).alias("stability"))


@query("density_hierarchy", _HIERARCHY)
def hierarchy_embeddings(spark, folder):
    """The most stable clusters over four radii."""
    return _by_hierarchy(spark, folder)


@query("density_hierarchy_rounds", _HIERARCHY)
def hierarchy_by_rounds(spark, folder):
    """The same with Boruvka rounds, as for very many vectors."""
    return _by_hierarchy(spark, folder, direct_edges=0)


@query(
    "components_rounds",
    """WITH RECURSIVE up(site, top) AS (SELECT doc_id, doc_id FROM documents
      UNION ALL SELECT site, top // 3 FROM up WHERE top % 7 <> 0)
    SELECT site, min(top) AS component FROM up GROUP BY site""",
)
def component_rounds(spark, folder):
    """Connected parts of a forest over the documents, by rounds of label spreading."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("site"))
    edges = docs.filter(F.col("site") % 7 != 0).select(
        F.col("site").alias("src"), F.floor(F.col("site") / 3).alias("dst")
    )
    return connected_components(docs, edges, direct_edges=0)


@query(
    "uniform_cluster",
    f"""WITH {sql.EVENT_LINES}, {sql.signed('event_lines')}
    SELECT pattern, count(*) AS weight, CAST(0 AS BIGINT) AS cluster_id
    FROM signed GROUP BY pattern""",
)
def uniform(spark, folder):
    patterns = pattern_table(annotate(event_lines(spark, folder)))
    labels = label_patterns(patterns, density_parameters("moderate"), uniform=True)
    return labels.select("pattern", "weight", "cluster_id")


@query(
    "train_uniform",
    f"""WITH {sql.EVENT_LINES}, {sql.signed('event_lines')}, n AS (
      SELECT pattern, count(*) AS weight, min(pos) AS first_pos FROM signed GROUP BY pattern),
    tops AS (SELECT * FROM n ORDER BY weight DESC, first_pos LIMIT 3)
    SELECT CAST(0 AS BIGINT) AS stable_id,
      (SELECT left(md5(string_agg(pattern, '|' ORDER BY pattern)), 12) FROM tops)
        AS signature_hash,
      (SELECT string_agg(pattern, '|' ORDER BY weight DESC, first_pos) FROM tops) AS patterns,
      count(*) AS training_size,
      (SELECT string_agg(raw_log, '|' ORDER BY pos) FROM (
        SELECT raw_log, pos FROM signed ORDER BY pos LIMIT 2)) AS sample_logs,
      CAST(1 AS BIGINT) AS num_clusters, CAST(0 AS BIGINT) AS num_outliers FROM signed""",
)
def trained_uniform(spark, folder):
    """Training on nearly uniform lines: everything is one cluster."""
    training = train(event_lines(spark, folder), uniform=True)
    stats = training.stats.first()
    return training.model.registry.select(
        "stable_id",
        "signature_hash",
        F.array_join("patterns", "|").alias("patterns"),
        "training_size",
        F.array_join("sample_logs", "|").alias("sample_logs"),
        F.lit(stats["num_clusters"]).cast("bigint").alias("num_clusters"),
        F.lit(stats["num_outliers"]).cast("bigint").alias("num_outliers"),
    )


@query(
    "features_default",
    f"""WITH {sql.DOC_LINES}, {sql.signed('doc_lines')}, p AS (SELECT DISTINCT pattern FROM signed),
    v AS (SELECT pattern, {sql.default_vector('pattern')} AS vec FROM p),
    parts AS (SELECT pattern, unnest(vec) AS value, generate_subscripts(vec, 1) - 1 AS bucket FROM v)
    SELECT pattern, CAST(bucket AS INTEGER) AS bucket, round(value, 6) AS value
    FROM parts WHERE value <> 0""",
)
def default_features(spark, folder):
    patterns = annotate(doc_lines(spark, folder)).select("pattern").distinct()
    parts = symbol_features(patterns).select("pattern", F.posexplode("vec").alias("bucket", "value"))
    return parts.filter("value <> 0").withColumn("value", F.round("value", 6))
