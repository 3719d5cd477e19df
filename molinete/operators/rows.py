"""Row-level relational operators: latest per key, enrichment, documents, pages, updates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molinete.operators.running import Running, running, size_probe

DOCUMENT_ITEMS = 10_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, k: int = 1) -> DataFrame:
    """The last ``k`` rows of each key in ``order``.

    Spark keeps only ``k`` rows per key and task before the shuffle
    (WindowGroupLimit), so a hot key does not arrive whole anywhere.
    """
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= k).drop("_rn")


def enrich(df: DataFrame, dim: DataFrame, key: str, columns: Mapping[str, str], *, how: str = "left") -> DataFrame:
    """``df`` plus renamed columns of a dimension keyed by ``id``."""
    side = dim.select(F.col("id").alias("_dim_id"), *[F.col(c).alias(a) for c, a in columns.items()])
    return df.join(side, F.col(key) == F.col("_dim_id"), how).drop("_dim_id")


@dataclass(frozen=True)
class Details:
    """Rows gathered under a header: ``fields`` of ``rows`` in ``order``. ``sizes``: a cheaper table with the same keys, if there is one."""

    rows: DataFrame
    order: Sequence[str]
    fields: Sequence[str]
    sizes: DataFrame | None = None


def nest(header: DataFrame, key: str, details: Mapping[str, Details], *, items: int = DOCUMENT_ITEMS) -> DataFrame:
    """Header rows by ``part`` (from 0), each kind of details as an ordered array of structs (empty if none).

    Details are matched by ``key`` to ``header.id`` and numbered within their header; part ``p`` holds those from ``p * items`` on, at most
    ``items`` of each kind. The grain is (header, part) whatever the sizes: a header has as many parts as its most numerous
    kind needs, at least one, and every detail stands in exactly one of them.
    """
    parts = None
    for name, d in details.items():
        ordered = running(d.rows, [key], d.order, {"_no": Running("count")}, sizes=size_probe(d.rows if d.sizes is None else d.sizes, [key]))
        entry = F.struct(F.struct(*d.order).alias("o"), F.struct(*d.fields).alias("e"))
        # Gathering does not shrink the data, so it is moved once, by header and part, and gathered where it lands.
        gathered = (
            ordered.withColumn("part", F.floor((F.col("_no") - 1) / items).cast("bigint"))
            .repartition(key, "part")
            .groupBy(key, "part")
            .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias(name))
        )
        parts = gathered if parts is None else parts.join(gathered, [key, "part"], "full")
    empty = {name: F.array().cast(parts.schema[name].dataType) for name in details}
    joined = header.join(parts.withColumnRenamed(key, "_doc_id"), F.col("id") == F.col("_doc_id"), "left").drop("_doc_id")
    return joined.withColumns(
        {"part": F.coalesce("part", F.lit(0).cast("bigint")), **{name: F.coalesce(F.col(name), none) for name, none in empty.items()}}
    )


def paginate(df: DataFrame, order: Sequence[Column], page: int | None = 1, limit: int | None = 10) -> DataFrame:
    """One page; ``page >= 1`` and ``1 <= limit <= 100``; all rows, ordered, when either is missing."""
    ordered = df.orderBy(*order)
    if page is None or limit is None:
        return ordered
    page, limit = max(1, int(page)), min(100, max(1, int(limit)))
    return ordered.offset((page - 1) * limit).limit(limit)


def page_info(df: DataFrame, page: int = 1, limit: int = 10) -> DataFrame:
    """``page, limit, total, total_pages`` of the filtered set: one row."""
    page, limit = max(1, int(page)), min(100, max(1, int(limit)))
    pages = F.greatest(F.ceil(F.col("total") / limit), F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        "total",
        pages.cast("bigint").alias("total_pages"),
    )


def page_after(df: DataFrame, ts: str, last: tuple | None, limit: int = 10) -> DataFrame:
    """Keyset page, newest first: the ``limit`` rows after ``(ts, id)`` of the last one seen.

    Its cost does not grow with the depth of the page, as an offset's does.
    """
    if last is not None:
        seen_ts, seen_id = F.lit(str(last[0])).cast("timestamp_ntz"), F.lit(last[1])
        df = df.filter((F.col(ts) < seen_ts) | ((F.col(ts) == seen_ts) & (F.col("id") < seen_id)))
    return df.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(limit)


def top_k(df: DataFrame, measure: str, key: str, k: int = 100) -> DataFrame:
    """Largest ``k`` by ``measure``; equal measures by key ascending."""
    return df.orderBy(F.col(measure).desc(), F.col(key).asc()).limit(k)


def settle_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str] = (), *, overwrite: bool = False) -> DataFrame:
    """One change per key, as if all of a key were made one after the other in ``order`` (without one: by their values).

    A column ends with the last value that is not NULL, with ``overwrite`` with that of the last change. The ``order`` columns are left out.
    """
    fields = [c for c in changes.columns if c not in keys and c not in order]
    if not fields:
        return changes.select(*keys).distinct()
    at = F.struct(*(order or fields), *(fields if order else []))
    if overwrite:
        return changes.groupBy(*keys).agg(F.max_by(F.struct(*fields), at).alias("_last")).select(*keys, "_last.*")
    return changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields])


def apply_updates(
    current: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    *,
    overwrite: bool = False,
    order: Sequence[str] = (),
    settled: bool = False,
) -> DataFrame:
    """A new snapshot of ``current`` with changed columns taken from ``changes``.

    A NULL in ``changes`` leaves the column as it is, unless ``overwrite``. Several changes of a key are settled in ``order``
    (:func:`settle_changes`; ``settled``: there is one at most); rows without a match in ``current`` are ignored.
    """
    if not settled:
        changes = settle_changes(changes, keys, order, overwrite=overwrite)
    fields = [c for c in changes.columns if c not in keys]
    side = changes.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).cast(current.schema[c].dataType).alias(f"_new_{c}") for c in fields]
    )

    def value(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        new = F.col(f"_new_{c}")
        return (F.when(F.col("_hit"), new).otherwise(F.col(c)) if overwrite else F.coalesce(new, F.col(c))).alias(c)

    return current.join(side, list(keys), "left").select(*[value(c) for c in current.columns])


def delete_matching(df: DataFrame, key: str, doomed: DataFrame) -> DataFrame:
    """Rows whose key is not in the one-column ``doomed`` (delete by join)."""
    return df.join(doomed.select(F.col(doomed.columns[0]).alias(key)), key, "left_anti")


def split_by_existence(df: DataFrame, key: str, uses: DataFrame, use_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows still used elsewhere, rows free to change)."""
    used = uses.select(F.col(use_key).alias(key))
    return df.join(used, key, "left_semi"), df.join(used, key, "left_anti")
