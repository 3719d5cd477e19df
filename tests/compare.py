"""Order-insensitive comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return ("n", v.normalize() + 0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", Decimal(v).normalize() + 0)
    if isinstance(v, float):
        return ("n", Decimal("NaN") if math.isnan(v) else Decimal(repr(v)).normalize())
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_plain(x) for x in v))
    return ("s", v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    want_names, want = rows_of([d[0] for d in result.description], result.fetchall())
    got_names, got = rows_of(spark_df.columns, spark_df.collect())
    out = []
    if got_names != want_names:
        out.append(f"columns {got_names} != {want_names}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        extra = sorted(set(got) - set(want), key=repr)[:3]
        missing = sorted(set(want) - set(got), key=repr)[:3]
        out.append(f"only in Spark {extra}; only in SQL {missing}")
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    sql_types = {d[0]: str(d[1]) for d in result.description} if result.description else {}
    out.extend(type_notes(types, sql_types) if not out else [])
    return out


_SAME = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
    "double": {"DOUBLE"},
}


def type_notes(got: dict[str, str], want: dict[str, str]) -> list[str]:
    notes = []
    for name, g in got.items():
        w = want.get(name, "")
        ok = (g.startswith("decimal") and w.upper() == g.upper()) or w in _SAME.get(g, set()) or g.startswith("array")
        if not ok:
            notes.append(f"type of {name}: {g} / {w}")
    return notes
