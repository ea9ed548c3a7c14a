"""What the operators for training data share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is learned from if this is true; null ids are neither held out nor learned from.
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)"
LEARNED = "coalesce(crc32(cast(doc_id as string)) % 5 != 0, false)"

#: Bytes of text that a column function works on at once.
SLICE = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def per_text(work: Callable[[], Callable[[list[str]], pa.Array]], schema: str) -> Callable[[Column], Column]:
    """A column function that computes one struct per text, some hundred texts at a time.

    ``work()`` runs once per task and gives the function for a list of texts, so that
    caches live as long as the task; what is held beside an Arrow batch is bounded by the
    slice, not by the batch. Null texts count as empty. The result is marked
    nondeterministic only so that the optimizer evaluates it once instead of copying
    it into filters above.
    """

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compute = work()
        for batch in batches:
            for a, b in spans(batch, SLICE):
                yield compute([t or "" for t in batch.slice(a, b - a).to_pylist()])

    return run.asNondeterministic()


def structs(fields: list[tuple[str, pa.DataType]], columns: list[list]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def computed(df: DataFrame, column: Column) -> DataFrame:
    """``df`` with the fields of a struct column; they replace columns of the same name."""
    made = df.select("*", column.alias("_made"))
    names = made.schema["_made"].dataType.names
    return made.select(*[c for c in df.columns if c not in names], *[f"_made.{n}" for n in names])


def column_schema(**types: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in types.items())


def spans(texts: pa.Array, most_bytes: int, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``most_bytes`` of text or ``most_rows`` at most, so
    that what is held beside a batch does not grow with the batch."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += size
        if held >= most_bytes or i + 1 - start >= most_rows:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
