"""Row-wise operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Names of input expressions inside a batch; they don't clash with columns of users.
INPUT = "__nw_in_{}"
#: Rows that are Python objects at one time.
ROWS = 2048


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int | None = None) -> Iterator[None]:
    """Batches of fewer rows, and of size bytes, for what is run inside: wide rows, as sets of shingles are, need less memory at a time."""
    name, bound = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {name: spark.conf.get(name)}
    given = int(before[name])
    spark.conf.set(name, str(min(given, rows) if given > 0 else rows))
    if size:
        before[bound] = spark.conf.get(bound)
        spark.conf.set(bound, str(size))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def annotate(
    df: DataFrame,
    inputs: list[Column | str],
    added: T.StructType,
    start: Callable[[], Callable[..., Iterable[tuple[Any, ...]]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns (those in keep) and new ones that Python computes from inputs.

    An input that is the name of a kept string column travels once; other names are read as strings.

    start() runs once a task and returns a function of one list for each input (None for null) that
    gives a tuple of new values for each row, in order. A column of df named like a new one is replaced.
    """
    new = set(added.fieldNames())
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    places, extra = [], []
    for e in inputs:
        if isinstance(e, str) and e in kept and df.schema[e].dataType == T.StringType():
            places.append(kept.index(e))
        else:
            places.append(len(kept) + len(extra))
            extra.append((F.col(f"`{e}`").cast("string") if isinstance(e, str) else e).alias(INPUT.format(len(extra))))
    base = df.select(*(F.col(f"`{c}`") for c in kept), *extra)
    schema = T.StructType([*(base.schema[c] for c in kept), *added.fields])
    arrow = to_arrow_schema(added)
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows = list(compute(*(batch.column(i).to_pylist() for i in places)))
            columns = list(zip(*rows, strict=True))
            made = [pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)]
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n_kept)), *made], names=[*kept, *new_names])

    new_names = added.fieldNames()
    return base.mapInArrow(run, schema)
