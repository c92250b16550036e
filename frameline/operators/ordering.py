"""Places and running totals over all rows in order, without a task that sees all rows or all rows of a group.

The rows are dealt once into ranges of (group, order), each range is numbered as it is written, and the ranges' first and last rows, one of each
a partition, say how much to add to the numbers of each range. As the boundaries are those of the written table, nothing is sampled twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.storage import written


def _differs(column: pa.Array, before: pa.Array) -> np.ndarray:
    """Where a value is another one than that before it; nulls are equal, and so are NaNs."""
    other = pc.fill_null(pc.not_equal(column, before), False)
    if pa.types.is_floating(column.type):
        other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(column), pc.is_nan(before)), False))
    return np.asarray(pc.or_(other, pc.xor(pc.is_null(column), pc.is_null(before))))


def _number_range(group: list[str], totals: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to sorted rows of one task: the task, the row's number, its group's number, its place in the group and the totals before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, groups = TaskContext.get().partitionId(), 0, -1
        last: dict[str, pa.Array] = {}
        start = np.zeros(1 + len(totals), np.int64)  # the row and the running totals at which the present group began
        summed = np.zeros(len(totals), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for g in group:
                column = batch.column(g)
                new |= _differs(column, pa.concat_arrays([last.get(g, column.slice(0, 1)), column.slice(0, n - 1)]))
                last[g] = pa.concat_arrays([column.slice(n - 1, 1)])
            new[0] |= groups < 0
            here = np.cumsum(new)
            rows = np.arange(seen, seen + n)
            running = [rows]
            for k, t in enumerate(totals):
                values = batch.column(t).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = summed[k] + np.cumsum(values)
                running.append(upto - values)
                summed[k] = upto[-1]
            begins = [np.concatenate([start[k : k + 1], r[new]]) for k, r in enumerate(running)]
            within = [r - b[here] for r, b in zip(running, begins, strict=True)]
            start = np.array([b[-1] for b in begins])
            made = [pa.array(np.full(n, part, np.int32)), pa.array(rows), pa.array(groups + here), *map(pa.array, within)]
            groups += int(here[-1])
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "__part", "__row", "__group", "__at", *(f"__{t}_before" for t in totals)])

    return run


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], totals: Sequence[str] = (), label: str = "in-order") -> DataFrame:
    """Adds ``group_at``, the number from 0 of the row's group among all groups in order, ``row_at``, its place from 0 in its group, and for
    each x of ``totals`` the sum ``x_before`` over the rows before it in its group (integers; null counts as 0).

    Groups are columns of plain types, in rising order, nulls first. Rows that ``order`` leaves equal follow each other in any order, so it should name
    what tells them apart; rows equal in everything are dealt to one range. An empty table stays empty. What goes through the driver is a first and a last
    row of each partition.
    """
    group, totals = list(group), list(totals)
    key = [*group, *order]
    extra = [("__part", T.IntegerType()), *((n, T.LongType()) for n in ("__row", "__group", "__at", *(f"__{t}_before" for t in totals)))]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, kind) for n, kind in extra)])
    spread = rows.repartitionByRange(*key).sortWithinPartitions(*key) if key else rows
    placed = written(spread.mapInArrow(_number_range(group, totals), schema), label)
    first = F.struct(*[F.col(g) for g in group] or [F.lit(0).alias("all")])
    sums = [(F.col(f"__{t}_before") + F.coalesce(F.col(t), F.lit(0))).alias(t) for t in totals]
    ends = placed.groupBy("__part").agg(
        F.min_by(first, "__row").alias("first"), F.max_by(F.struct(first.alias("key"), F.col("__group").alias("group"), (F.col("__at") + 1).alias("rows"), F.array(*[s.cast("long") for s in sums] or [F.lit(0).cast("long")]).alias("sums")), "__row").alias("last")
    )
    offsets, known, number, carried = [], None, 0, [0] * (1 + len(totals))
    for end in sorted(ends.collect(), key=lambda r: r["__part"]):
        goes_on = known is not None and known == end["first"]
        number, carried = (number - 1, carried) if goes_on else (number, [0] * (1 + len(totals)))
        offsets.append((end["__part"], number, *carried))
        tail = [end["last"]["rows"], *end["last"]["sums"][: len(totals)]]
        carried = tail if end["last"]["group"] else [a + b for a, b in zip(carried, tail, strict=True)]
        number, known = number + end["last"]["group"] + 1, end["last"]["key"]
    # A constant array for each number, by partition: a table of them would be a broadcast of its own for each job that reads the result.
    by_part = {o[0]: o[1:] for o in offsets}

    def shift(k: int) -> Column:
        numbers = ",".join(str(by_part[p][k] if p in by_part else 0) for p in range(max(by_part, default=0) + 1))
        return F.get(F.split(F.lit(numbers), ",").cast("array<bigint>"), F.col("__part"))

    begun = lambda k: F.when(F.col("__group") == 0, shift(k)).otherwise(0)
    return placed.select(
        *[placed[c] for c in rows.columns], (F.col("__group") + shift(0)).alias("group_at"), (F.col("__at") + begun(1)).alias("row_at"),
        *[(F.col(f"__{t}_before") + begun(2 + k)).alias(f"{t}_before") for k, t in enumerate(totals)],
    )
