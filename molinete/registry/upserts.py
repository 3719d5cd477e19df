"""Upserts of every dimension but clients: changes of a third of the rows, and new rows of which some want a value that is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.operators.numbering import next_id
from molinete.plans import dims as X
from molinete.registry.core import query
from molinete.sources.roles import Roles


def _changes(rows: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Every third row changes its ``key`` (every seventh of them to a blank); a quarter comes back as new rows a day later, half of these with the key they had."""
    old = F.col("id")
    changed = rows.filter(old % 3 == 0).select(
        "id", F.lit("2024-01-01").cast("timestamp_ntz").alias("requested_at"), F.when(old % 7 == 0, " ").otherwise(F.concat(F.lit("upd"), old.cast("string"))).alias(key), *_named(fields)
    )
    again = F.when(old % 8 == 1, F.col(key)).otherwise(F.concat(F.lit("new"), old.cast("string")))
    fresh = rows.filter(old % 4 == 1).select((old + next_id(rows)).alias("id"), F.lit("2024-01-02").cast("timestamp_ntz").alias("requested_at"), again.alias(key), *_named(fields))
    return changed.unionByName(fresh)


def _named(fields: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in fields.items()]


def _answers(rows: DataFrame, key: str, fields: dict[str, Column], spec: X.Spec) -> DataFrame:
    out = X.upsert_dimension(rows.select("id", *spec.columns, "active"), _changes(rows, key, fields), spec)
    table = out["table"].select("id", F.col(key).alias("value"), "active", F.lit(None).cast("string").alias("reason"))
    refused = out["rejected"].select("id", F.lit(None).cast("string").alias("value"), F.lit(None).cast("boolean").alias("active"), "reason")
    return table.unionByName(refused)


def _sql(table: str, key: str, reason: str, *, unique: bool = True, blank_keeps: bool = False, bad: str = "false") -> str:
    """``bad``: which changes and new rows fail for another reason than their key, as ``reason``."""
    blank = "false" if blank_keeps else "id % 3 = 0 AND id % 7 = 0"
    taken = (
        f"""n.wanted IS NOT NULL AND (EXISTS (SELECT 1 FROM moved m WHERE lower(m.{key}) = lower(n.wanted) AND NOT m.gives)
            OR row_number() OVER (PARTITION BY lower(n.wanted), n.bad ORDER BY n.id) > 1 AND NOT n.bad)"""
        if unique
        else "false"
    )
    kept = f"CASE WHEN id % 7 = 0 THEN {key} ELSE 'upd' || id END" if blank_keeps else "'upd' || id"
    return f"""WITH top AS (SELECT max(id) + 1 AS t FROM {table}),
    moved AS (SELECT id, {key}, active, id % 3 = 0 AS asked, id % 3 = 0 AND id % 7 <> 0 AND NOT ({bad}) AS gives,
            CASE WHEN id % 3 <> 0 THEN NULL WHEN {blank} THEN '{key}_required' WHEN {bad} THEN '{reason}' END AS refused FROM {table}),
    n AS (SELECT id, id + t AS new_id, CASE WHEN id % 8 = 1 THEN {key} ELSE 'new' || id END AS wanted, {bad} AS bad FROM {table}, top WHERE id % 4 = 1),
    fresh AS (SELECT n.new_id, n.wanted, CASE WHEN n.bad THEN '{reason}' WHEN {taken} THEN '{key}_taken' END AS refused FROM n)
    SELECT id, CASE WHEN asked AND refused IS NULL THEN {kept} ELSE {key} END AS value,
        CASE WHEN asked AND refused IS NULL THEN true ELSE active END AS active, NULL AS reason FROM moved
    UNION ALL SELECT new_id, wanted, true, NULL FROM fresh WHERE refused IS NULL
    UNION ALL SELECT id, NULL, NULL, refused FROM moved WHERE refused IS NOT NULL
    UNION ALL SELECT new_id, NULL, NULL, refused FROM fresh WHERE refused IS NOT NULL"""


@query("upsert_instructors", _sql("instructors", "dni", "", blank_keeps=True))
def _(r: Roles):
    return _answers(r.instructors, "dni", {"name": F.lit(" Ana "), "phone": F.lit(None).cast("string")}, X.SPECS["instructors"])


@query("upsert_categories", _sql("categories", "name", ""))
def _(r: Roles):
    return _answers(r.categories, "name", {"description": F.lit(" ")}, X.SPECS["categories"])


@query("upsert_plans", _sql("plans", "name", ""))
def _(r: Roles):
    return _answers(r.plans, "name", {"duration_days": F.lit(30), "price": F.lit("10.50").cast("decimal(10,2)"), "description": F.lit(None).cast("string")}, X.SPECS["plans"])


@query("upsert_users", _sql("users", "username", "role_invalid", bad="id % 5 = 2"))
def _(r: Roles):
    role = F.when(F.col("id") % 5 == 2, "jefe").otherwise("empleado")
    return _answers(r.users, "username", {"name": F.lit("Ana"), "email": F.lit(" "), "role": role}, X.SPECS["users"])


@query("upsert_classes", _sql("classes", "name", "day_of_week_invalid", unique=False, bad="id % 5 = 2"))
def _(r: Roles):
    rows = r.classes.withColumns({"description": F.lit(None).cast("string"), "end_time": F.lit("23:00:00")})
    day = F.when(F.col("id") % 5 == 2, "Feriado").otherwise("Lunes")
    fields = {"day_of_week": day, "start_time": F.lit("08:00:00"), "end_time": F.lit("09:00:00"), "instructor": F.lit("Ana"), "description": F.lit(None).cast("string")}
    return _answers(rows, "name", {**fields, "capacity": F.lit(None).cast("int")}, X.SPECS["classes"])


@query("upsert_notices", _sql("notices", "title", "type_invalid", unique=False, bad="id % 5 = 2"))
def _(r: Roles):
    rows = r.notices.withColumn("content", F.lit("texto"))
    kind = F.when(F.col("id") % 5 == 2, "urgente").when(F.col("id") % 5 == 3, "warning")
    return _answers(rows, "title", {"content": F.lit("texto"), "type": kind}, X.SPECS["notices"])
