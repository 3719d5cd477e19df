"""Ids without gaps, handed out by all tasks at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molinete.session import durable

#: ``monotonically_increasing_id`` holds the partition above this bit and the row's place in it below.
_PLACE_BITS = 33


def dense_ids(df: DataFrame, order: Sequence[str], out: str = "id", *, start: int = 1, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: ``start``, ``start + 1``, ... without a gap, in ascending ``order`` (nulls first).

    Two passes and no window over the whole table. The rows are dealt to ranges of ``order``, sorted there and written once with their
    range and their place in it; then the counts of the ranges, one row each, are summed up to the range before, and a row's id is that sum plus
    its place. The written places stay what they are when a task is run again, so ids never collide or leave a gap.

    ``order`` should tell all rows apart: rows that agree in it are numbered next to one another in any order, and must fit one task. Reruns
    on the same rows then agree. An empty table stays empty. A column of ``df`` named ``out`` is replaced.
    """
    columns = [c for c in df.columns if c != out]
    kept = df.select(*columns, *([F.col(out).alias("_was")] if out in df.columns and out in order else []))
    by = ["_was" if c == out and "_was" in kept.columns else c for c in order]
    dealt = kept.repartitionByRange(partitions, *by) if partitions else kept.repartitionByRange(*by)
    placed = durable(dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    range_ = F.shiftright("_at", _PLACE_BITS)
    sizes = placed.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row for each range: as many as there were tasks, whatever the table holds.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    numbered = placed.join(F.broadcast(starts), range_ == F.col("_range"))
    return numbered.select(*columns, (F.col("_before") + place + F.lit(start)).cast("bigint").alias(out))


def next_id(current: DataFrame, key: str = "id") -> int:
    """The id after the largest one in use: one number to the driver."""
    return int(current.agg(F.max(key)).first()[0] or 0) + 1


def insert_ids(
    headers: DataFrame, children: Mapping[str, tuple[DataFrame, Sequence[str]]], order: Sequence[str], *, request: str = "request_id", link: str, starts: Mapping[str, int], name: str
) -> dict[str, DataFrame]:
    """New rows with the ids an auto-increment would give them: ``name`` the headers, and ``children`` that name their header's new id in ``link``.

    Headers are numbered in ``order``. Children, given as ``(rows, order)`` with the header's ``request`` in each row, are numbered header by
    header and within it in their order. ``starts`` has the first id of each table (:func:`next_id`). Children without a header are left out.
    """
    numbered = dense_ids(headers, order, start=starts[name])
    new = numbered.select(request, F.col("id").alias(link))
    out = {name: numbered}
    for child, (rows, by) in children.items():
        out[child] = dense_ids(rows.join(new, request), [link, *by], start=starts[child])
    return out
