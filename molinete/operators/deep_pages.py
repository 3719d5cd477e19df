"""Pages deep in an order, found by counting instead of sorting all that comes before."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.operators.running import _number

#: Parts the order is cut into; a part above this many rows of one single value is cut again by what orders the rows within it.
PARTS, BIG = 128, 100_000


@dataclass(frozen=True)
class Page:
    """``rows`` of the page in order, the ``total`` of all pages, and how many rows were ``sorted`` for it."""

    rows: DataFrame
    total: int
    sorted: int


def seek_page(df: DataFrame, order: Sequence[str], page: int, limit: int = 10, *, descending: bool = True, big: int = BIG) -> Page:
    """The rows of one page of ``df`` in ``order`` (all columns descending, nulls last, or all ascending, nulls first).

    One pass takes quantiles of the first column, a second counts the rows between them: at most ``PARTS`` numbers each, summed up in every
    task. The page lies in the one or two parts its offset falls into, and only these rows are read and sorted; the filter on the
    bare column prunes row groups. The total comes from the same counts. Neither pass shuffles rows, however deep the page.
    ``order`` should tell rows apart, or a page is not determined.
    """
    page, limit = max(1, int(page)), max(1, int(limit))
    return _seek(df, list(order), (page - 1) * limit, limit, descending, big)


def _seek(df: DataFrame, order: list[str], offset: int, limit: int, descending: bool, big: int) -> Page:
    ordered = [F.desc(c) if descending else F.asc(c) for c in order]
    kind = df.schema[order[0]].dataType
    # Texts are placed by what they begin with; rows that agree in that stay in one part.
    text = kind.typeName() == "string"
    key = _number(df, order[0]) if text else F.col(order[0])
    literal = (lambda v: F.lit(float(v))) if text else (lambda v: F.lit(str(v)).cast(kind))
    marks = df.agg(F.percentile_approx(key, [i / PARTS for i in range(1, PARTS)], 20 * PARTS)).first()[0]
    cuts = [literal(v) for v in sorted(set(marks or []))]
    at = F.when(key.isNull(), -1).otherwise(F.size(F.filter(F.array(*cuts), lambda c: c <= key)) if cuts else F.lit(0))
    parts = df.groupBy(at.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    total, before, found = sum(p["n"] for p in parts), 0, []
    for part in sorted(parts, key=lambda p: -p["part"] if descending else p["part"]):
        if before + part["n"] > offset and before < offset + limit:
            found.append((part, before))
        before += part["n"]
    if not found:
        return Page(df.limit(0).orderBy(*ordered), total, 0)
    first = found[0][1]
    only = found[0][0] if len(found) == 1 else None
    if only is not None and only["n"] > big and len(order) > 1 and not text and only["lo"] == only["hi"]:
        same = key.isNull() if only["part"] == -1 else key == literal(only["lo"])
        inner = _seek(df.filter(same), order[1:], offset - first, limit, descending, big)
        return Page(inner.rows, total, inner.sorted)
    here = _between(key, cuts, [p["part"] for p, _ in found])
    rows = df.filter(here).orderBy(*ordered).offset(offset - first).limit(limit)
    return Page(rows, total, sum(p["n"] for p, _ in found))


def _between(key: Column, cuts: list[Column], parts: list[int]) -> Column:
    """The rows of neighbouring parts, as a filter on the bare key."""
    numbered = [p for p in parts if p >= 0]
    out = F.lit(False)
    if numbered:
        out = key.isNotNull()
        if min(numbered) > 0:
            out = out & (key >= cuts[min(numbered) - 1])
        if max(numbered) < len(cuts):
            out = out & (key < cuts[max(numbered)])
    return out | key.isNull() if -1 in parts else out
