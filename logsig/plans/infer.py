"""Inference: new lines get the stable id of a trained cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import Featurizer, features
from ..operators.vectors import assign_stable_cluster, fits_broadcast
from ..session import is_bounded, materialize, spread
from ..sources.logs import annotate, clustered_rows
from ..sources.model import Model

_MATCH = ["stable_id", "candidate", "distance", "vote", "match_kind"]


def assign_lines(
    lines: DataFrame,
    model: Model,
    featurizer: Featurizer | None = None,
    per_pattern: bool = True,
) -> DataFrame:
    """Lines with pattern, stable id and how they were matched.

    ``per_pattern`` computes each distinct pattern once and joins the answer back,
    which pays when features are expensive or patterns few; few patterns are
    broadcast, so the lines themselves are not shuffled. Without it, and for more patterns
    than can be broadcast if the default features do, everything is one narrow stage, for
    models that can be broadcast.
    """
    signed = annotate(lines)
    if not per_pattern:
        vectors = features(signed, featurizer)
        return assign_stable_cluster(vectors, model).drop("vec")
    patterns = signed.select("pattern").distinct()
    vectors = materialize(features(spread(materialize(patterns)), featurizer))
    found = assign_stable_cluster(vectors, model, "pattern")
    assigned = materialize(found.select("pattern", *_MATCH))
    if is_bounded(assigned):
        return signed.join(F.broadcast(assigned), "pattern")
    if featurizer is None and fits_broadcast(model):
        # Too many patterns: no line is shuffled if the model can go to the lines.
        return assign_stable_cluster(features(signed), model).drop("vec")
    return signed.join(assigned, "pattern")


def clustered_log(
    lines: DataFrame, model: Model, featurizer: Featurizer | None = None
) -> DataFrame:
    """The rows inference appends to the clustered-log table."""
    assigned = assign_lines(lines, model, featurizer).withColumn(
        "timestamp", F.current_timestamp()
    )
    return clustered_rows(assigned)
