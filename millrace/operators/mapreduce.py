"""User-defined map, group and reduce over any number of inputs.

A map or a reduce is best given as DataFrame code, which Catalyst plans. Arbitrary Python runs through Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Lift = Callable[[DataFrame], DataFrame]
#: Rows of a partition in (as dicts), rows out (as tuples). It is called once a partition, so it can hold state.
Mapper = Callable[[Iterator[dict]], Iterator[tuple]]
#: A group's key values and its rows (as dicts), which come as a stream; rows out.
Reducer = Callable[[tuple, Iterator[dict]], Iterator[tuple]]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def map_rows(df: DataFrame, mapper: Mapper, schema: str | T.StructType) -> DataFrame:
    out = _schema(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(mapper(row for b in batches for row in b.to_pylist()), arrow)

    return df.mapInArrow(run, out)


def reduce_groups(df: DataFrame, keys: list[str], reducer: Reducer, schema: str | T.StructType) -> DataFrame:
    """Runs ``reducer`` once a key. A group streams through in batches; it meets in one task, so prefer aggregate columns
    (``Pipeline.reduce``), which combine before the shuffle, wherever they can express the reduction."""
    out = _schema(schema)
    arrow = to_arrow_schema(out)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(reducer(tuple(k.as_py() for k in key), (row for b in batches for row in b.to_pylist())), arrow)

    return df.groupBy(*keys).applyInArrow(run, out)


class Pipeline:
    """Inputs, each with a lift to the common shape; a map; a group and reduce. Lazy: every step is a DataFrame.

    ``Pipeline().input(df).map(...).reduce(...).frame`` chains into the next pipeline without writing anything.
    """

    def __init__(self) -> None:
        self._inputs: list[DataFrame] = []
        self._steps: list[Callable[[DataFrame], DataFrame]] = []

    def input(self, df: DataFrame, lift: Lift | None = None, tag: str | None = None) -> Pipeline:
        """Another input; ``tag`` names it in a column ``tag`` of the union."""
        lifted = lift(df) if lift else df
        self._inputs.append(lifted.withColumn("tag", F.lit(tag)) if tag is not None else lifted)
        return self

    def map(self, step: Lift | Mapper, schema: str | T.StructType | None = None) -> Pipeline:
        """DataFrame code, or with ``schema`` a Python mapper."""
        self._steps.append((lambda df: map_rows(df, step, schema)) if schema is not None else step)  # type: ignore[arg-type]
        return self

    def reduce(self, keys: list[str], *aggregates: Column, reducer: Reducer | None = None, schema: str | T.StructType | None = None) -> Pipeline:
        """Aggregate columns, or a Python reducer with its schema."""
        if reducer:
            self._steps.append(lambda df: reduce_groups(df, keys, reducer, schema))  # type: ignore[arg-type]
        else:
            self._steps.append(lambda df: df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct())
        return self

    @property
    def frame(self) -> DataFrame:
        if not self._inputs:
            raise ValueError("a pipeline needs an input")
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self._inputs)
        for step in self._steps:
            df = step(df)
        return df


def union(*inputs: DataFrame) -> DataFrame:
    """UNION ALL by name."""
    pipe: Any = Pipeline()
    for df in inputs:
        pipe.input(df)
    return pipe.frame
