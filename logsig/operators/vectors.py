"""Cluster geometry: centroids, nearest clusters, neighbour votes.

Vectors are ``array<float|double>`` columns. Distances to a model are matrix
products over Arrow batches: only the vector column leaves the JVM, no row is
multiplied by the number of clusters, and nothing is shuffled. A model too big
to broadcast lies in blocks around pivots, and a row visits only the blocks that can hold
its nearest (``nearest_blocked``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from ..sources.logs import OUTLIER
from ..sources.model import Model, Thresholds

# Distances one task holds at a time, and references it lays out for them.
TILE = 1 << 20
REFERENCES = 4096
# Rows of a batch or group that are turned into a matrix at a time.
ROWS = 4096
# The largest model, in vector components, that is collected and broadcast.
BROADCAST_COMPONENTS = 32_000_000
BLOCK_VECTORS = 4096
# Pivots that blocks of references lie around; larger blocks are cut into parts.
MOST_PIVOTS = 1024
GROUP_ROWS = 16_384
# Distances equal to this many digits are ties, settled by id.
TIE_DIGITS = 9
SAMPLES_PER_CLUSTER = 10


# ---- per-cluster aggregates -------------------------------------------------


def unit_rows(vectors: DataFrame, vector: str = "vec") -> DataFrame:
    """Add ``_v`` and ``_unit``: the vector and its direction (zero stays zero)."""
    typed = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return Normalizer(p=2.0, inputCol="_v", outputCol="_unit").transform(typed)


def _norm2(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)


def cluster_geometry(
    vectors: DataFrame, label: str = "label", vector: str = "vec", weight: str | None = None
) -> DataFrame:
    """Size, centroid, its norm and the mean pairwise cosine distance per cluster.

    With ``S`` the sum of a cluster's unit vectors, the cosines over all ordered
    pairs sum to ``|S|^2`` less the diagonal, so the pairwise mean comes out of one
    partial aggregation, without any pair being formed. ``weight`` names a column
    of row multiplicities.
    """
    copies = F.col(weight) if weight else F.lit(1)
    nonzero = F.when(_norm2(F.col(vector).cast("array<double>")) > 0, copies).otherwise(0)
    times = copies.cast("double")
    sums = (
        unit_rows(vectors.filter(F.col(label) != OUTLIER), vector)
        .groupBy(label)
        .agg(
            F.sum(copies).alias("size"),
            F.sum(nonzero).alias("_m"),
            vector_to_array(Summarizer.mean(F.col("_v"), times)).alias("centroid"),
            vector_to_array(Summarizer.sum(F.col("_unit"), times)).alias("_s"),
        )
    )
    n = F.col("size")
    spread = 1 - (_norm2(F.col("_s")) - F.col("_m")) / (n * (n - 1))
    return sums.select(
        label,
        "size",
        "centroid",
        F.sqrt(_norm2(F.col("centroid"))).alias("centroid_norm"),
        F.when(n > 1, spread).otherwise(F.lit(0.0)).alias("avg_intra_distance"),
    )


def cluster_sample_vectors(
    vectors: DataFrame,
    row_id: str,
    label: str = "label",
    vector: str = "vec",
    count: int = SAMPLES_PER_CLUSTER,
    seed: int | None = 17,
) -> DataFrame:
    """Up to ``count`` vectors per cluster, chosen by a seeded hash of the row id.

    ``seed=None`` takes the lowest row ids instead. A task sends at most ``count``
    rows per cluster to the shuffle.
    """
    name = F.concat_ws(":", F.lit(seed).cast("string"), F.col(row_id).cast("string"))
    draw = [F.col(row_id)] if seed is None else [F.md5(name), F.col(row_id)]
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*draw))
    return (
        vectors.filter(F.col(label) != OUTLIER)
        .select(label, row_id, F.col(vector).alias("vec"))
        .withColumn("idx", rank - 1)
        .filter(F.col("idx") < count)
    )


# ---- distances to a model ---------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _slices(column: pa.Array) -> list[pa.Array]:
    """The vectors of a batch or group, ``ROWS`` at a time; one empty part of none."""
    return [column.slice(i, ROWS) for i in range(0, max(len(column), 1), ROWS)]


def _directions(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class Compact:
    """A matrix that is mostly zeros, by its other entries; slices of rows are laid out."""

    def __init__(self, matrix: np.ndarray):
        at, place = np.nonzero(matrix)
        self.starts = np.searchsorted(at, np.arange(len(matrix) + 1))
        self.places, self.values, self.width = place.astype(np.int32), matrix[at, place], matrix.shape[1]

    @classmethod
    def of(cls, column: pa.Array) -> Compact:
        """The vectors of a column ``(width, at, x)``: their length, places and entries."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        width, at, x = column.flatten()
        held = cls.__new__(cls)
        held.starts = at.offsets.to_numpy() - at.offsets[0].as_py() if len(column) else np.zeros(1, int)
        held.places = at.flatten().to_numpy(zero_copy_only=False)
        held.values = x.flatten().to_numpy(zero_copy_only=False)
        held.width = width[0].as_py() if len(column) else 0
        return held

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> np.ndarray:
        """Any of the rows, laid out."""
        first, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(np.arange(len(rows)), sizes)
        of = np.arange(len(at)) + (first - (np.cumsum(sizes) - sizes))[at]
        dense = np.zeros((len(rows), self.width))
        dense[at, self.places[of]] = self.values[of]
        return dense

    def __getitem__(self, rows: slice) -> np.ndarray:
        starts = self.starts[rows.start : rows.stop + 1]
        of = slice(starts[0], starts[-1])
        dense = np.zeros((len(starts) - 1, self.width))
        dense[np.repeat(np.arange(len(dense)), np.diff(starts)), self.places[of]] = self.values[of]
        return dense


def _compact(units: np.ndarray) -> np.ndarray | Compact:
    """The references as every Python worker holds them."""
    return Compact(units) if 4 * np.count_nonzero(units) < units.size else units


def _nearest(rows: np.ndarray, units: np.ndarray | Compact, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosine distances of each unit row's ``k`` nearest references.

    Distances are held a tile of at most ``TILE`` entries at a time, references laid out
    ``REFERENCES`` at a time.
    """
    best, apart = np.empty((len(rows), 0), np.int64), np.empty((len(rows), 0))
    for of in range(0, len(units), REFERENCES):
        others = units[of : of + REFERENCES]
        step = max(1, TILE // len(others))
        places, distances = [np.empty((0, min(k, len(others))), np.int64)], [np.empty((0, min(k, len(others))))]
        for at in range(0, len(rows), step):
            tile = 1.0 - rows[at : at + step] @ others.T
            places.append(_smallest(tile, k))
            distances.append(np.take_along_axis(tile, places[-1], axis=1))
        # Earlier references stand to the left, so ties stay theirs.
        best = np.hstack([best, np.concatenate(places) + of])
        apart = np.hstack([apart, np.concatenate(distances)])
        if of:
            kept = _smallest(apart, k)
            best, apart = (np.take_along_axis(x, kept, axis=1) for x in (best, apart))
    return best, apart


def _nearest_of(column: pa.Array, units: np.ndarray | Compact, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of the vectors of a column, of which few are laid out at a time."""
    found = [_nearest(_directions(_matrix(part)), units, k) for part in _slices(column)]
    best, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    return best, apart


def _smallest(distances: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` smallest entries; ties go to the left."""
    rounded = np.round(distances, TIE_DIGITS)
    if k == 1:
        return rounded.argmin(axis=1)[:, None]
    if rounded.shape[1] > 4 * k:
        bound = np.partition(rounded, k - 1, axis=1)[:, k - 1 : k]
        # Everything up to the k-th distance, ties included, then an exact order.
        rounded = np.where(rounded <= bound, rounded, np.inf)
    # A slice alone would keep the order of all entries.
    return np.argsort(rounded, axis=1, kind="stable")[:, :k].copy()


def collect_reference(
    references: DataFrame,
    keys: Sequence[str],
    vector: str = "vec",
    components: int = BROADCAST_COMPONENTS,
) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys and unit vectors of a model table in key order, if small enough."""
    size = references.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")
    ).first()
    if size["n"] * size["d"] > components:
        return None
    table = references.select(
        *[F.col(k).cast("bigint") for k in keys], F.col(vector).cast("array<double>").alias("vec")
    ).toArrow()
    names = np.array([table.column(k).to_numpy() for k in keys]).T.reshape(len(table), len(keys))
    order = np.lexsort(names.T[::-1])
    return names[order], _directions(_matrix(table.column("vec")))[order]


def _nearest_column(vector: Column, keys: np.ndarray, units: np.ndarray, k: int) -> Column:
    """``array<struct<stable_id, idx, distance>>`` of the ``k`` nearest references."""
    units = _compact(units)

    @F.arrow_udf("array<struct<stable_id:bigint,idx:bigint,distance:double>>")
    def nearest(batch: pa.Array) -> pa.Array:
        near = min(k, len(units))
        if not len(batch) or not near:
            return pa.array([[]] * len(batch), type=pa.list_(_HIT))
        best, distances = _nearest_of(batch, units, near)
        hits = pa.StructArray.from_arrays(
            [
                pa.array(keys[best, 0].ravel()),
                pa.array(keys[best, -1].ravel()),
                pa.array(distances.ravel()),
            ],
            fields=list(_HIT),
        )
        offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * near)
        return pa.ListArray.from_arrays(offsets, hits)

    return nearest(vector)


_HIT = pa.struct(
    [("stable_id", pa.int64()), ("idx", pa.int64()), ("distance", pa.float64())]
)


class Routing:
    """Blocks of references around pivots, and which of them can hold a row's nearest.

    Cosine distances are half the squared distances of unit vectors. A zero vector is at
    distance one from everything, so it gets a direction of its own: one for rows, one
    for references.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = self.placed(pivots, references=True)
        self.radii = np.full(len(pivots), -np.inf)
        # Rows whose distances to the pivots are held at a time.
        self.rows = max(1, min(ROWS, TILE // max(len(pivots), 1)))

    @staticmethod
    def placed(matrix: np.ndarray, references: bool) -> np.ndarray:
        units = _directions(matrix)
        zero = (~units.any(axis=1)).astype(float)[:, None]
        none = np.zeros_like(zero)
        return np.hstack([units, *((none, zero) if references else (zero, none))])

    def apart(self, matrix: np.ndarray, references: bool = False) -> np.ndarray:
        """Distances to the pivots."""
        cosines = self.placed(matrix, references) @ self.pivots.T
        return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))

    def home(self, matrix: np.ndarray, references: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The nearest block that holds anything, and the distance to its pivot."""
        apart = self.apart(matrix, references)
        if not references:
            apart = np.where(np.isinf(self.radii), np.inf, apart)
        best = apart.argmin(axis=1)
        return best, apart[np.arange(len(best)), best]

    def homes(self, column: pa.Array, references: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The same of the vectors of a column, with the distances of few at a time."""
        steps = range(0, len(column), self.rows)
        found = [self.home(_matrix(column.slice(i, self.rows)), references) for i in steps]
        best, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        return best, apart

    def within(self, matrix: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Blocks with a point that may be as near as a cosine distance, rounding allowed for."""
        reach = np.sqrt(2.0 * (distance + 2 * 10.0**-TIE_DIGITS)) + 1e-7
        return self.apart(matrix) - self.radii <= reach[:, None]


def routing_of(references: DataFrame, block_vectors: int) -> tuple[Routing, DataFrame]:
    """A routing for stored references, and the references with their ``_block``, stored."""
    count = min(MOST_PIVOTS, references.count() // block_vectors + 1)
    order = [F.xxhash64("stable_id", "idx"), "stable_id", "idx"]
    routing = Routing(_matrix(references.orderBy(*order).limit(count).select("vec").toArrow().column("vec")))

    @F.arrow_udf("struct<block:int,apart:double>")
    def place(batch: pa.Array) -> pa.Array:
        block, apart = routing.homes(batch, references=True) if len(batch) else ([], [])
        return pa.StructArray.from_arrays(
            [pa.array(block, pa.int32()), pa.array(apart, pa.float64())], names=["block", "apart"]
        )

    placed = references.withColumn("_at", place.asNondeterministic()(F.col("vec")))
    placed = materialize(
        placed.select("stable_id", "idx", "vec", F.col("_at.block").alias("_block"), "_at.apart")
    )
    # As many numbers as pivots.
    shape = placed.groupBy("_block").agg(F.max("apart").alias("radius")).collect()
    for row in shape:
        routing.radii[row["_block"]] = row["radius"]
    return routing, placed.drop("apart")


def nearest_blocked(
    vectors: DataFrame,
    row_id: str,
    references: DataFrame,
    k: int,
    vector: str = "vec",
    block_vectors: int = BLOCK_VECTORS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The ``k`` nearest references per row for a model of any size, exactly.

    References lie in blocks around pivots. A row first meets the block of its nearest pivot;
    the ``k``-th distance there bounds the answer, and by the triangle inequality only
    blocks that reach into this distance are visited after that. A task sees one part of
    a block and one group of its visitors, both of bounded size.
    """
    id_type = dict(vectors.dtypes)[row_id]
    schema = f"{row_id} {id_type}, stable_id bigint, idx bigint, distance double"
    stored = materialize(
        references.select(
            F.col("stable_id").cast("bigint"),
            F.col("idx").cast("bigint"),
            F.col("vec").cast("array<double>"),
        )
    )
    order = Window.partitionBy(row_id).orderBy(F.round("distance", TIE_DIGITS), "stable_id", "idx")
    best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if stored.isEmpty() or k < 1:
        return best(vectors.sparkSession.createDataFrame([], schema))
    routing, placed = routing_of(stored, block_vectors)
    rows = vectors.select(row_id, F.col(vector).cast("array<double>").alias("vec"))

    @F.arrow_udf("int")
    def home(batch: pa.Array) -> pa.Array:
        return pa.array(routing.homes(batch)[0] if len(batch) else [], pa.int32())

    rows = materialize(rows.withColumn("_home", home.asNondeterministic()(F.col("vec"))))
    first = materialize(
        best(_meet(rows.withColumnRenamed("_home", "_block"), row_id, placed, k, schema, block_vectors, group_rows))
    )
    # Fewer than k in the home block bound nothing: four is above any cosine distance.
    bound = first.groupBy(row_id).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(4.0)).alias("_bound")
    )
    visits = visited(rows.join(bound, row_id), routing)
    others = _meet(visits, row_id, placed, k, schema, block_vectors, group_rows)
    return best(first.drop("rank").unionByName(others))


def visited(rows: DataFrame, routing: Routing) -> DataFrame:
    """``rows`` (with ``_home`` and ``_bound``) once per further ``_block`` that may hold nearer
    references."""

    @F.arrow_udf("array<int>")
    def blocks(batch: pa.Array, own: pa.Array, bound: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], pa.list_(pa.int32()))
        most = bound.to_numpy(zero_copy_only=False)
        steps = range(0, len(batch), routing.rows)
        reached = np.concatenate(
            [routing.within(_matrix(batch.slice(i, routing.rows)), most[i : i + routing.rows]) for i in steps]
        )
        reached[np.arange(len(batch)), own.to_numpy(zero_copy_only=False)] = False
        at, block = np.nonzero(reached)
        offsets = np.searchsorted(at, np.arange(len(batch) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.astype(np.int32)))

    found = blocks.asNondeterministic()(F.col("vec"), F.col("_home"), F.col("_bound"))
    kept = [c for c in rows.columns if c not in ("_home", "_bound")]
    return rows.withColumn("_reached", found).select(*kept, F.explode("_reached").alias("_block"))


def _meet(
    visits: DataFrame, row_id: str, placed: DataFrame, k: int, schema: str, block_vectors: int, group_rows: int
) -> DataFrame:
    """The ``k`` nearest references of each row in each part of the block it visits."""
    visits = materialize(visits)
    parts = placed.groupBy("_block").agg(
        F.ceil(F.count(F.lit(1)) / block_vectors).cast("int").alias("_parts")
    )
    groups = visits.groupBy("_block").agg(
        F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("_groups")
    )
    # At most a row per pivot.
    sizes = F.broadcast(materialize(parts.join(groups, "_block")))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(sizes, "_block").select(
        row_id,
        "vec",
        "_block",
        F.pmod(F.xxhash64(row_id), F.col("_groups")).cast("int").alias("_group"),
        numbers("_parts").alias("_part"),
    )
    right = placed.join(sizes, "_block").select(
        "stable_id",
        "idx",
        "vec",
        "_block",
        numbers("_groups").alias("_group"),
        F.pmod(F.xxhash64("stable_id", "idx"), F.col("_parts")).cast("int").alias("_part"),
    )
    hit_type = to_arrow_schema(StructType.fromDDL(schema))

    def compare(rows: pa.Table, refs: pa.Table) -> pa.Table:
        names = np.array([refs.column("stable_id").to_numpy(), refs.column("idx").to_numpy()]).T
        order = np.lexsort(names.T[::-1])
        near = min(k, len(order))
        if not len(rows) or not near:
            return hit_type.empty_table()
        units = _directions(_matrix(refs.column("vec")))[order]
        best, distances = _nearest_of(rows.column("vec"), units, near)
        found = names[order][best].reshape(-1, 2)
        return pa.table(
            {
                row_id: rows.column(row_id).take(np.repeat(np.arange(len(rows)), near)),
                "stable_id": found[:, 0],
                "idx": found[:, 1],
                "distance": distances.ravel(),
            },
            schema=hit_type,
        )

    key = ["_block", "_part", "_group"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema)


def fits_broadcast(model: Model, components: int = BROADCAST_COMPONENTS) -> bool:
    """Whether a model's vectors are few enough for every task to hold."""
    for table in (model.centroids, model.samples):
        size = table.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")
        ).first()
        if size["n"] * size["d"] > components:
            return False
    return True


def _with_idx(references: DataFrame) -> DataFrame:
    return references if "idx" in references.columns else references.withColumn("idx", F.lit(0))


def nearest_references(
    vectors: DataFrame,
    references: DataFrame,
    k: int,
    row_id: str = "row_id",
    vector: str = "vec",
    components: int = BROADCAST_COMPONENTS,
) -> DataFrame:
    """``(row_id, rank, stable_id, idx, distance)`` of each row's ``k`` nearest.

    References of more than ``components`` vector components are compared in blocks.
    """
    references = _with_idx(references)
    small = collect_reference(references, ["stable_id", "idx"], components=components)
    if small is None:
        hits = nearest_blocked(
            vectors, row_id, references, k, vector, BLOCK_VECTORS, GROUP_ROWS
        )
        return hits.select(row_id, "rank", "stable_id", "idx", "distance")
    near = vectors.select(row_id, _nearest_column(F.col(vector), *small, k).alias("hits"))
    return near.select(row_id, F.posexplode("hits").alias("rank", "hit")).select(
        row_id, (F.col("rank") + 1).alias("rank"), "hit.*"
    )


def centroid_nearest(
    vectors: DataFrame,
    centroids: DataFrame,
    row_id: str = "row_id",
    vector: str = "vec",
    components: int = BROADCAST_COMPONENTS,
) -> DataFrame:
    """Every row with its closest centroid; ties go to the lower stable id."""
    return nearest_references(vectors, centroids, 1, row_id, vector, components).select(
        row_id, "stable_id", "distance"
    )


def knn_vote(
    candidates: DataFrame,
    samples: DataFrame,
    k: int = Thresholds.knn_k,
    row_id: str = "row_id",
    vector: str = "vec",
    components: int = BROADCAST_COMPONENTS,
) -> DataFrame:
    """Share of a row's ``k`` nearest samples that belong to its candidate.

    Zero when there are fewer than ``k`` samples in all.
    """
    hits = nearest_references(candidates, samples, k, row_id, vector, components)
    cand = candidates.select(row_id, F.col("stable_id").alias("_candidate"))
    agree = F.count_if(F.col("stable_id") == F.col("_candidate"))
    voted = (
        cand.join(hits, row_id, "left")
        .groupBy(row_id)
        .agg(
            F.first("_candidate").alias("stable_id"),
            F.when(F.count("stable_id") >= k, agree / F.lit(k)).otherwise(F.lit(0.0)).alias("vote"),
        )
    )
    return voted


# How a row can be matched.
MATCH_KINDS = ("direct", "knn", "outlier")


# ---- assignment -------------------------------------------------------------


def decide(candidate: Column, distance: Column, vote: Column, limits: Thresholds) -> Column:
    """``direct``, ``knn`` or ``outlier`` for a row's nearest centroid."""
    verified = (distance < limits.secondary_distance) & (vote >= limits.knn_confidence)
    return (
        F.when(candidate.isNotNull() & (distance < limits.primary_distance), F.lit("direct"))
        .when(candidate.isNotNull() & verified, F.lit("knn"))
        .otherwise(F.lit("outlier"))
    )


_MATCH = "struct<stable_id:bigint,candidate:bigint,distance:double,vote:double,match_kind:string>"
_MATCH_TYPE = pa.struct(
    [
        ("stable_id", pa.int64()),
        ("candidate", pa.int64()),
        ("distance", pa.float64()),
        ("vote", pa.float64()),
        ("match_kind", pa.string()),
    ]
)


def _match_column(vector: Column, centroids, samples, limits: Thresholds) -> Column:
    ids, centers = centroids[0][:, 0], _compact(centroids[1])
    owners, units = samples[0][:, 0], _compact(samples[1])

    def matched(batch: pa.Array) -> pa.Array:
        rows = _directions(_matrix(batch))
        best, nearest = (x[:, 0] for x in _nearest(rows, centers, 1))
        candidate = ids[best]
        direct = nearest < limits.primary_distance
        band = ~direct & (nearest < limits.secondary_distance)
        vote = np.full(len(rows), np.nan)
        if band.any():
            vote[band] = 0.0
            if len(units) >= limits.knn_k:
                near = _nearest(rows[band], units, limits.knn_k)[0]
                agree = (owners[near] == candidate[band, None]).sum(axis=1)
                vote[band] = agree / limits.knn_k
        verified = band & (np.nan_to_num(vote) >= limits.knn_confidence)
        kind = np.where(direct, "direct", np.where(verified, "knn", "outlier"))
        return pa.StructArray.from_arrays(
            [
                pa.array(np.where(direct | verified, candidate, OUTLIER)),
                pa.array(candidate),
                pa.array(nearest),
                pa.array(vote, mask=~band),
                pa.array(kind),
            ],
            fields=list(_MATCH_TYPE),
        )

    @F.arrow_udf(_MATCH)
    def match(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], type=_MATCH_TYPE)
        return pa.concat_arrays([matched(part) for part in _slices(batch)])

    return match(vector)


def assign_stable_cluster(
    vectors: DataFrame,
    model: Model,
    row_id: str | None = None,
    vector: str = "vec",
    components: int = BROADCAST_COMPONENTS,
) -> DataFrame:
    """Add ``stable_id, candidate, distance, vote, match_kind`` to every row.

    One narrow stage for a model that can be broadcast: rows are neither
    shuffled nor multiplied. A model of more than ``components`` vector components goes
    through blocked comparisons and joins on ``row_id``; without one, rows are stored with a
    number of their own. Without centroids every row is an outlier.
    """
    limits = model.thresholds
    centroids = collect_reference(
        _with_idx(model.centroids), ["stable_id"], components=components
    )
    if centroids is not None and not len(centroids[0]):
        return assign_fallback(vectors)
    samples = collect_reference(
        _with_idx(model.samples), ["stable_id", "idx"], components=components
    )
    if centroids is not None and samples is not None:
        matched = vectors.withColumn(
            "_match", _match_column(F.col(vector), centroids, samples, limits)
        )
        return matched.select(*vectors.columns, "_match.*")
    # Each row and its nearest centroid are used several times below.
    own = row_id or "_row"
    stored = materialize(
        vectors if row_id else vectors.withColumn(own, F.monotonically_increasing_id())
    )
    near = materialize(centroid_nearest(stored, model.centroids, own, vector, components))
    band = near.filter(
        (F.col("distance") >= limits.primary_distance)
        & (F.col("distance") < limits.secondary_distance)
    ).join(stored.select(own, F.col(vector).alias("vec")), own)
    votes = knn_vote(band, model.samples, limits.knn_k, own, "vec", components)
    kind = decide(F.col("candidate"), F.col("distance"), F.col("vote"), limits)
    return (
        stored.join(near.withColumnRenamed("stable_id", "candidate"), own, "left")
        .join(votes.select(own, "vote"), own, "left")
        .withColumn("match_kind", kind)
        .withColumn(
            "stable_id",
            F.when(F.col("match_kind") == "outlier", F.lit(OUTLIER)).otherwise(F.col("candidate")),
        )
        .select(*vectors.columns, "stable_id", "candidate", "distance", "vote", "match_kind")
    )


def assign_fallback(vectors: DataFrame) -> DataFrame:
    """What assignment gives without any centroid."""
    nothing = F.lit(None)
    return vectors.select(
        "*",
        F.lit(OUTLIER).cast("bigint").alias("stable_id"),
        nothing.cast("bigint").alias("candidate"),
        nothing.cast("double").alias("distance"),
        nothing.cast("double").alias("vote"),
        F.lit("outlier").alias("match_kind"),
    )


def assignment_summary(assigned: DataFrame) -> DataFrame:
    """Rows per kind of match, kinds without a row included."""
    counts = assigned.agg(
        *[F.count_if(F.col("match_kind") == kind).alias(kind) for kind in MATCH_KINDS]
    )
    return counts.unpivot([], list(MATCH_KINDS), "match_kind", "size")
