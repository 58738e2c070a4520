"""Walks over groups in order, row by row, with a small state and never a whole group in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ROWS = 10_000
#: Arrow's kind for each kind of column that a walk may yield.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC")}


def walk_groups(rows: DataFrame, keys: list[str], order: list[str], walk: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``walk`` over each group of ``rows`` (its columns as tuples, sorted by ``order``); what it yields are rows of ``schema``.

    One shuffle brings a group to one task, sorted on disk where need be; batches pass
    through, so a group of any size takes the memory of the walk's own state. Values reach
    the walk as they are, nulls as None; rows whose key is null are one group, as in a
    grouping.
    """
    fields = [(f.name, KINDS[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out = (x for _, group in groupby(every, key=lambda r: r[: len(keys)]) for x in walk(group))
        while part := list(islice(out, ROWS)):
            columns = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])

    others = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
