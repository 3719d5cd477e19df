"""Running values kept up to date: a late batch is worked in from the nearest mark before it, not from the beginning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.operators.running import HOT_ROWS, Running, running
from molinete.session import durable

#: Rows of a key between two marks at most.
EVERY = 10_000


@dataclass(frozen=True)
class Kept:
    """``values``: rows with their running sum ``name``. ``marks``: ``(keys, period, at, value, no)``, the sums at chosen rows (``at`` is the row's place in
    the order, ``no`` its number within the key): the last of each key and period, and every so many rows between."""

    values: DataFrame
    marks: DataFrame


@dataclass(frozen=True)
class Advance:
    """What a late batch changes. ``changed``: the batch and all later rows of its keys, with their new sums. ``marks``: the new marks, all keys.
    ``read``: the stored rows that had to be read for it. ``since``: the first period of them."""

    changed: DataFrame
    marks: DataFrame
    read: DataFrame
    since: object


def period_of(column: str) -> Column:
    """The month: stored rows are partitioned by it, so that a batch opens the months from its first row on."""
    return F.date_trunc("month", column).cast("date")


def _marks(valued: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, every: int) -> DataFrame:
    mark = F.struct(F.struct(*order).alias("at"), F.col(name).alias("value"), F.col("_no").alias("no"))
    dated = valued.withColumn("period", period_of(order[0]))
    last = dated.groupBy(*keys, "period").agg(F.max(mark).alias("_m"))
    between = dated.filter(F.col("_no") % every == 0).select(*keys, "period", mark.alias("_m"))
    return last.unionByName(between).distinct().select(*keys, "period", "_m.*")


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def keep_running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, *, every: int = EVERY, hot_rows: int = HOT_ROWS) -> Kept:
    """The running sum of ``value`` per key in ``order`` (a timestamp first, then what tells rows apart), by a full pass, with its marks."""
    valued = durable(running(rows, keys, order, {name: Running("sum", value), "_no": Running("count")}, hot_rows=hot_rows))
    return Kept(valued.drop("_no"), durable(_marks(valued, keys, order, name, every)))


def advance_running(
    stored: DataFrame, marks: DataFrame, late: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, *, every: int = EVERY, hot_rows: int = HOT_ROWS
) -> Advance:
    """Work ``late`` rows, back-dated ones too, into sums that :func:`keep_running` made of ``stored``.

    For each key of the batch, all before its first new row stays as it is. Its sums go on from the last mark before that row. Every month in which a
    key has rows ends with a mark, so what lies between mark and row is in that row's own month: only months from the batch's first one on are read
    (a filter on the order's timestamp, which prunes partitions and row groups), of them only rows of the batch's keys behind their marks. A key
    that owns a third of all rows is read from its nearest mark, at most ``every`` rows back.

    ``stored`` needs the columns of ``late``; other columns of it are not read. An empty batch changes nothing.
    """
    late = durable(late)
    place = F.struct(*order)
    first = late.groupBy(*keys).agg(F.min(place).alias("_first"))
    behind = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    near = marks.join(behind, _same(keys)).filter(F.col("at") < F.col("_first"))
    near = near.groupBy(*keys).agg(F.max(F.struct("at", "value", "no")).alias("_mark"))
    starts = durable(
        behind.join(near, _same(keys), "left").select(
            *[f"_k_{k}" for k in keys], "_first", F.col("_mark.at").alias("_at"), F.col("_mark.value").alias("_value"), F.coalesce("_mark.no", F.lit(0)).alias("_before")
        )
    )
    since = late.agg(F.min(period_of(order[0]))).first()[0]
    since = "9999-12-01" if since is None else str(since)
    recent = stored.select(*late.columns).filter(F.col(order[0]) >= F.lit(since).cast(stored.schema[order[0]].dataType))
    read = recent.join(starts, _same(keys)).filter(F.col("_at").isNull() | (place > F.col("_at"))).select(*late.columns)
    sums = durable(running(read.unionByName(late), keys, order, {name: Running("sum", value), "_no": Running("count")}, hot_rows=hot_rows))
    joined = sums.join(starts, _same(keys))
    kind = sums.schema[name].dataType
    total = (F.col(name) + F.coalesce(F.col("_value").cast(kind), F.lit(0).cast(kind))).cast(kind)
    moved = durable(joined.select(*late.columns, total.alias(name), (F.col("_no") + F.col("_before")).alias("_no"), "_first"))
    changed = moved.filter(place >= F.col("_first")).drop("_no", "_first")
    gone = marks.join(starts.select(*[f"_k_{k}" for k in keys], "_first"), _same(keys), "left")
    kept = gone.filter(F.col("_first").isNull() | (F.col("at") < F.col("_first"))).select(*marks.columns)
    new = _marks(moved.filter(place >= F.col("_first")), keys, order, name, every)
    fitting = new.select(*[F.col(c).cast(marks.schema[c].dataType) for c in marks.columns])
    return Advance(changed, durable(kept.unionByName(fitting)), read, since)
