"""Commands in order through a state machine, a key at a time: for guards that depend on what was accepted before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def replayed(commands: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], list[dict]], schema: str) -> DataFrame:
    """Rows that ``step(state, command)`` gives for each command; ``start()`` is the state of a key before its first one.

    What a command may do depends on which of those before it were accepted, so this is no window or aggregate.  Keys are dealt
    out and sorted by Spark; a task reads them as a stream and holds one key's state, not its commands, however many they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start()
        for batch in batches:
            out = []
            for command in decoded(batch):
                if command[key] != now:
                    now, state = command[key], start()
                out += step(state, command)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return in_order(commands, key, order).mapInArrow(run, schema)


def folded(commands: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], Any], end: Callable[[Any, Any], list[dict]], schema: str) -> DataFrame:
    """Rows that ``end(key, state)`` gives for each key after its last command: as ``replayed``, where only the last state counts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for command in decoded(batch):
                if command[key] != now:
                    out += end(now, state) if now is not None else []
                    now, state = command[key], start()
                step(state, command)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if now is not None and (out := end(now, state)):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return in_order(commands, key, order).mapInArrow(run, schema)


def decoded(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, taken out a column at a time: a value at a time costs more than most steps."""

    def values(column: pa.Array) -> list:
        if pa.types.is_string(column.type) or (not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type))):
            return column.to_numpy(zero_copy_only=False).tolist()
        return column.to_pylist()

    names = batch.schema.names
    return (dict(zip(names, row, strict=True)) for row in zip(*map(values, batch.columns), strict=True))


def in_order(commands: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Commands dealt out by key, those of a key one after the other in their order."""
    return commands.where(f"{key} is not null").repartition(key).sortWithinPartitions(key, *order)
