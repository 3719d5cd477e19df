"""Ordered running values that hold when one key owns a third of the rows.

A plain window sends every row of a key to one task. That is right for keys of
ordinary size and is what is used for them. A key above the hot threshold is cut
into consecutive slices of its own order; each slice is a window group of its
own, slice totals are small, and a slice starts from the total of those before
it. The big side is shuffled once, on ``(keys, slice)``, in either case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.functions.scalars import epoch_micros
from molinete.session import durable

HOT_ROWS = 2_000_000  # a window group below this is one ordinary task
HOT_SHARE = 10_000  # hot keys hold > 1/10,000 of the rows each, so there are fewer than 10,000
SLICES = 256  # slices per hot key
TIE_SLICES = 64  # slices of one order value held by > 1/256 of a hot key's rows


@dataclass(frozen=True)
class Running:
    """``kind`` of ``value`` over the rows before this one, with this one if ``inclusive``."""

    kind: str  # sum | max | min | count
    value: Column | None = None
    inclusive: bool = True


_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _aggregate(spec: Running) -> Column:
    return _AGG[spec.kind](spec.value if spec.value is not None else F.lit(1))


def _combine(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "max":
        return F.greatest(earlier, here)
    if kind == "min":
        return F.least(earlier, here)
    return F.coalesce(earlier + here, here, earlier)


def key_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; counted map-side, so a hot key moves one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def size_probe(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> tuple[int, int]:
    """(rows, rows of the largest key): one column-pruned pass, two numbers to the driver.

    ``weight`` counts a row as that many, where each gives rise to several later.
    """
    sizes = key_sizes(df, keys) if weight is None else df.groupBy(*keys).agg(F.sum(weight).alias("_n"))
    row = sizes.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    return int(row["total"] or 0), int(row["largest"] or 0)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, Running],
    *,
    hot_rows: int = HOT_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add running columns per key in ascending ``order``.

    ``order[0]`` is a number, date, timestamp or text; the columns after it break ties.
    ``sizes`` is a :func:`size_probe` of the same keys, where a cheaper input has them.
    """
    total, largest = sizes or size_probe(df, keys)
    threshold = max(hot_rows, total // HOT_SHARE)
    if largest <= threshold:
        return _windowed(df, keys, order, outputs)
    return _sliced(df, keys, order, outputs, threshold)


def _windowed(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], outputs: dict[str, Running]
) -> DataFrame:
    by = Window.partitionBy(*groups).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns(
        {name: _aggregate(spec).over(upto if spec.inclusive else before) for name, spec in outputs.items()}
    )


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    if kind == "timestamp":
        return F.unix_micros(column).cast("double")
    if kind == "timestamp_ntz":  # wall clock: a zone's clock change must not reorder it
        return epoch_micros(column).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "string":  # the first six bytes, in byte order
        return _head(column, F.lit(0))
    return F.col(column).cast("double")


def _head(column: str, skipped: Column) -> Column:
    """Six bytes of a text behind the ``skipped`` ones, as a number in byte order."""
    head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), skipped + 1, F.lit(6))), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _common_bytes(a: Column, b: Column) -> Column:
    """How many bytes two texts have in common from the front; of a smallest and a largest, what all between them share."""
    first, second = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(first), F.length(second)) / 2, F.lit(1)).cast("int"))
    same = F.filter(places, lambda i: F.substring(first, F.lit(1), 2 * i) == F.substring(second, F.lit(1), 2 * i))
    return F.when(F.length(first) * F.length(second) > 0, F.size(same)).otherwise(F.lit(0))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def _tie(df: DataFrame, order: Sequence[str]) -> Column | None:
    """What orders the rows of one value of ``order[0]``'s number: the next bytes of a text, else the column behind it."""
    if df.schema[order[0]].dataType.typeName() == "string":
        return _head(order[0], F.col("_skip") + 6)
    if len(order) > 1 and df.schema[order[1]].dataType.typeName() in ("long", "integer", "string", "date", "timestamp", "timestamp_ntz"):
        return _number(df, order[1])
    return None


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with a ``_slice`` column (0 for ordinary keys), and the hot keys alone.

    Slices end at quantiles of the key's order. A value that fills whole slices (an instant that a bulk load shares, texts with a common
    beginning) is cut further at quantiles of what orders the rows within that very value.
    """
    is_text = df.schema[order[0]].dataType.typeName() == "string"
    at, tie = _head(order[0], F.col("_skip")) if is_text else _number(df, order[0]), _tie(df, order)
    # What all texts of a key begin with says nothing of their order.
    skip = _common_bytes(F.min(order[0]), F.max(order[0])) if is_text else F.lit(0)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), skip.alias("_skip"))
    hot = sizes.filter(F.col("_n") > threshold).select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_skip")
    hot_keys = [f"_h_{k}" for k in keys]
    at_key = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    marks = [i / SLICES for i in range(1, SLICES)]
    # Written once: the rows and the totals must be cut at the very same marks, in a retried task too.
    bounds = durable(
        df.join(F.broadcast(hot), at_key)
        .groupBy(*hot_keys, "_skip")
        .agg(F.percentile_approx(at, marks, 20 * SLICES).alias("_marks"))
        .withColumn("_cuts", F.array_distinct("_marks"))
        .withColumn("_heavy", F.filter("_cuts", lambda c: F.size(F.filter(F.col("_marks"), lambda m: m == c)) > 1))
        .drop("_marks")
    )
    helpers = [*hot_keys, "_skip", "_cuts", "_heavy"]
    slice_ = F.size(F.filter("_cuts", lambda c: c <= at)) * F.lit(TIE_SLICES + 1)
    if tie is not None:
        # At most SLICES / 2 values of a key are heavy, so this stays as bounded as the keys.
        steps = [i / TIE_SLICES for i in range(1, TIE_SLICES)]
        heavy = durable(
            df.join(F.broadcast(bounds), at_key)
            .filter(F.array_contains("_heavy", at))
            .groupBy(*hot_keys, at.alias("_at"))
            .agg(F.array_distinct(F.percentile_approx(tie, steps, 20 * TIE_SLICES)).alias("_ties"))
            .select(*[F.col(c).alias(f"_t{c}") for c in hot_keys], "_at", "_ties")
        )
        same_value = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in hot_keys]) & (at == F.col("_at"))
        # Rows behind a heavy value and before the next cut come after all of its slices.
        slice_ = slice_ + F.when(F.col("_ties").isNull(), F.lit(TIE_SLICES)).otherwise(F.size(F.filter("_ties", lambda c: c <= tie)))
        helpers += [*(f"_t{c}" for c in hot_keys), "_at", "_ties"]

    def marked(how: str) -> DataFrame:
        joined = df.join(F.broadcast(bounds), at_key, how)
        if tie is not None:
            joined = joined.join(F.broadcast(heavy), same_value, "left")
        return joined.withColumn("_slice", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(slice_)).drop(*helpers)

    return marked("left"), marked("inner")


def _sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: dict[str, Running], threshold: int
) -> DataFrame:
    cut, hot_only = _cut(df, keys, order, threshold)
    totals = hot_only.groupBy(*keys, "_slice").agg(*[_aggregate(s).alias(f"_t_{n}") for n, s in outputs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    fold_totals = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    starts = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_k__slice"),
        *[fold_totals[s.kind](f"_t_{n}").over(earlier).alias(f"_s_{n}") for n, s in outputs.items()],
    )
    groups = [*keys, "_slice"]
    here = _windowed(cut, groups, order, outputs)
    joined = here.join(starts, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in groups]), "left")
    values = {n: _combine(s.kind, F.col(f"_s_{n}"), F.col(n)) for n, s in outputs.items()}
    kept = [c for c in df.columns if c not in values]
    return joined.select(*kept, *[v.alias(n) for n, v in values.items()])


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no", *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1, 2, 3 ... per key in ascending ``order``."""
    return running(df, keys, order, {name: Running("count")}, hot_rows=hot_rows)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    column: str,
    name: str,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``column`` of the row just before: the greatest earlier ``(order, column)``."""
    carried = F.struct(*[F.col(c) for c in order], F.col(column).alias("_value"))
    out = running(df, keys, order, {"_before": Running("max", carried, inclusive=False)}, hot_rows=hot_rows)
    return out.withColumn(name, F.col("_before._value")).drop("_before")
