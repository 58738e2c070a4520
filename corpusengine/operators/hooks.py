"""Functions from outside (scorers, embedders, summarisers, judges) over rows: batched calls, failures kept by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusengine.operators.ordered import KINDS

#: What a hook may answer with, besides the plain kinds.
ANSWERS = KINDS | {"array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def call_rows(rows: DataFrame, fn: Callable[..., list[Any]], inputs: list[str], output: str, kind: str = "string", tries: int = 2, size: int = 256) -> DataFrame:
    """``rows`` with ``output`` (of SQL type ``kind``) and ``error``: ``fn`` gets one list for each of ``inputs``, of the same rows, and answers with one list.

    At most ``size`` rows go in one call. Where a call raises, or answers with another number
    of values or with values of another type, its rows are asked one by one, each at most
    ``tries`` times; one that still fails has a null answer and the failure's text, and costs
    no other row. Rows keep their order; nulls reach ``fn`` as None. Columns of the names
    ``output`` and ``error`` are replaced.
    """
    if tries < 1 or size < 1:
        raise ValueError("tries and size must be one at least")
    answer = ANSWERS[kind]
    rest = rows.drop(output, "error")
    schema = f"{rest._jdf.schema().toDDL()}, `{output}` {kind}, error string"
    at = [rest.columns.index(c) if c in rest.columns else None for c in inputs]
    if None in at:
        raise ValueError(f"inputs {inputs} are not all among {rest.columns}")

    def ask(given: list[list[Any]], n: int) -> pa.Array:
        got = fn(*given)
        if len(got) != n:
            raise ValueError(f"{len(got)} answers for {n} rows")
        return pa.array(got, type=answer)

    def alone(one: list[list[Any]]) -> tuple[Any, str | None]:
        for left in reversed(range(tries)):
            try:
                return ask(one, 1)[0].as_py(), None
            except Exception as e:  # noqa: BLE001  the row's failure is data here
                if not left:
                    return None, repr(e)
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                given = [batch.column(i).to_pylist() for i in at]
                try:
                    answers, errors = ask(given, batch.num_rows), pa.nulls(batch.num_rows, pa.string())
                except Exception:  # noqa: BLE001  which rows failed shows row by row
                    done = [alone([[x] for x in one]) for one in zip(*given, strict=True)]
                    answers, errors = pa.array([a for a, _ in done], type=answer), pa.array([e for _, e in done], type=pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, answers, errors], names=[*batch.schema.names, output, "error"])

    return rest.mapInArrow(run, schema)
