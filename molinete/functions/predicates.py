"""Row predicates shared by every plan (FLT-*)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from unicodedata import normalize

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.scalars import day, days_remaining


def opt_filter(df: DataFrame, **params) -> DataFrame:
    """One AND per parameter that was given."""
    for column, value in params.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def in_period(
    df: DataFrame, ts: str, date_from: date | str | None = None, date_to: date | str | None = None
) -> DataFrame:
    """Whole days, both ends included; the column stays bare so Parquet statistics prune."""
    if date_from is not None:
        df = df.filter(F.col(ts) >= F.lit(str(date_from)).cast("timestamp_ntz"))
    if date_to is not None:
        df = df.filter(F.col(ts) < F.date_add(day(date_to), 1).cast("timestamp_ntz"))
    return df


def enum_filter(df: DataFrame, column: str, value: str | None, domain: Iterable[str]) -> DataFrame:
    """A value outside the domain is ignored, not an error."""
    return df.filter(F.col(column) == value) if value in tuple(domain) else df


def is_active(as_of: date | str) -> Column:
    d = day(as_of)
    return (F.col("status") == "active") & (F.col("start_date") <= d) & (F.col("end_date") >= d)


def is_expired(as_of: date | str) -> Column:
    return (F.col("status") == "expired") | (F.col("end_date") < day(as_of))


def is_stale(as_of: date | str) -> Column:
    return (F.col("status") == "active") & (F.col("end_date") < day(as_of))


def ends_in(as_of: date | str, days: int) -> Column:
    return is_active(as_of) & (days_remaining(as_of) == days)


def by_keys(df: DataFrame, key: str, keys: DataFrame | Iterable) -> DataFrame:
    """Rows whose key is in a list of literals or in a one-column DataFrame; either way a semi join."""
    if not isinstance(keys, DataFrame):
        kind = df.schema[key].dataType.simpleString()
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` {kind}")
    return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")


def visible(df: DataFrame, mode: str = "active") -> DataFrame:
    """Soft-delete visibility: ``active``, ``inactive`` or ``all``."""
    if mode == "all":
        return df
    return df.filter(F.col("active") == F.lit(mode != "inactive"))


def debt_filter(df: DataFrame, mode: str = "all") -> DataFrame:
    """``with_debt`` keeps positive balances, ``al_day`` the others; anything else keeps all."""
    if mode == "with_debt":
        return df.filter(F.col("balance") > 0)
    if mode == "al_day":
        return df.filter(F.col("balance").isNull() | (F.col("balance") <= 0))
    return df


# Letters that the collation of unique values (UNICODE_CI_AI) takes for plain ones, though they are not letters with marks; letters it takes for two.
_STROKED = ("ðđħŀłøſ", "ddhllos")
_DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without; then the combining marks, which stand for nothing."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = normalize("NFD", letter)[0]
        if letter.lower() == letter and base != letter:
            marked.append(letter)
            plain.append(base)
    return "".join(marked) + _STROKED[0] + "".join(map(chr, range(0x300, 0x370))), "".join(plain) + _STROKED[1]


_MARKED, _PLAIN = _accents()


def fold(c: str | Column) -> Column:
    """Lower case without accents: texts that uniqueness takes for the same letters are the same."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), _DOUBLE, F.translate(F.lower(c), _MARKED, _PLAIN))


def matches(columns: Iterable[str], term: str) -> Column:
    """``LIKE %term%`` on any column, ignoring case and accents; ``%`` and ``_`` are wildcards. One comparison for all terms."""
    pattern = F.concat(F.lit("%"), fold(F.lit(term)), F.lit("%"))
    return reduce(lambda a, b: a | b, [F.coalesce(F.like(fold(c), pattern), F.lit(False)) for c in columns])


def text_search(df: DataFrame, columns: Iterable[str], term: str | None) -> DataFrame:
    text = (term or "").strip()
    return df.filter(matches(columns, text)) if text else df
