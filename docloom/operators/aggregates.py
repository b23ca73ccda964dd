"""Table functions over ordered partitions and Python aggregates whose states merge, in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

State = dict[str, Any]


@dataclass(frozen=True)
class Aggregate:
    """An aggregate in Python: ``add`` makes a state of some rows, ``merge`` one state of several, ``finish`` the result of a state.

    ``state`` and ``result`` are their columns as DDL.  ``merge`` has to give the same for any grouping and order of the states.
    """

    state: str
    result: str
    add: Callable[[pa.Table], State]
    merge: Callable[[list[State]], State]
    finish: Callable[[State], State] = lambda state: state


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def grouped(rows: DataFrame, keys: list[str], how: Aggregate, most: int = 50_000, fan_in: int = 256) -> DataFrame:
    """``(keys, result)``: one row for each group, null keys being a group; without rows none.

    Rows become states where they are read, at most ``most`` of them held by a task at a time, and only states are shuffled: first merged
    in ``fan_in`` parts of a key, then in one.  So a key that holds most of the rows never comes together as rows.
    """
    kept = T.StructType([rows.schema[k] for k in keys])
    states = T.StructType([*kept.fields, *T.StructType.fromDDL(how.state).fields])
    parted = T.StructType([*states.fields, T.StructField("_part", T.IntegerType())])
    results = T.StructType([*kept.fields, *T.StructType.fromDDL(how.result).fields])
    names = [f.name for f in states.fields[len(keys) :]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema = TaskContext.get().partitionId() % fan_in, _arrow(parted)
        held: dict[tuple, State] = {}
        out = lambda: pa.Table.from_pylist([dict(zip(keys, key)) | state | {"_part": part} for key, state in held.items()], schema).to_batches()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            places = table.select(keys).append_column("_row", pa.array(range(len(table)))).group_by(keys).aggregate([("_row", "list")])
            for group in places.to_pylist():
                key, new = tuple(group[k] for k in keys), how.add(table.take(group["_row_list"]))
                held[key] = how.merge([held[key], new]) if key in held else new
            if len(held) >= most:
                yield from out()
                held.clear()
        yield from out()

    def merged(schema: T.StructType, last: Callable[[State], State], *more: str) -> Callable[[tuple, pa.Table], pa.Table]:
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            state = last(how.merge(table.select(names).to_pylist()))
            return pa.Table.from_pylist([dict(zip([*keys, *more], (k.as_py() for k in key))) | state], _arrow(schema))

        return merge

    parts = rows.mapInArrow(partial, parted)
    parts = parts.groupBy(*keys, "_part").applyInArrow(merged(parted, lambda s: s, "_part"), parted)
    return parts.drop("_part").groupBy(*keys).applyInArrow(merged(results, how.finish), results)


def by_table_function(rows: DataFrame, function, partition_by: Iterable[str] = (), order_by: Iterable[str] = (), params: dict[str, Any] | None = None) -> DataFrame:
    """The rows that a table function (``udtf``) gives for ``rows``, one partition after another, each in its order.

    A partition's rows pass one by one, so its size isn't bounded by memory.  Without ``partition_by`` the function sees the rows as they lie, task
    by task, and an order can't be asked for.  ``params`` are constants by name.
    """
    table, partition_by, order_by = rows.asTable(), list(partition_by), list(order_by)
    if partition_by:
        table = table.partitionBy(*partition_by)
        table = table.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order_by]) if order_by else table
    elif order_by:
        raise ValueError("An order needs a partition")
    return function(table, **{k: F.lit(v) for k, v in (params or {}).items()})
