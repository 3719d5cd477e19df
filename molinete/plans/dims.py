"""Dimensions: lists, bulk upserts, guarded deletes (QRY-33 .. 37, JOB-15/16)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import visible
from molinete.functions.scalars import blank_to_null, is_email, weekday_rank
from molinete.operators.rows import Details, enrich, nest
from molinete.operators.unique import last_requested, settle_claims
from molinete.schema import FOREIGN_KEYS, ROLES, WEEKDAYS, ForeignKey
from molinete.session import durable


def plans_with_instructors(
    plans: DataFrame, plan_instructors: DataFrame, instructors: DataFrame, *, items: int = 10_000
) -> DataFrame:
    """Active plans by duration and ``part``, each with its active instructors by name."""
    detail = enrich(
        plan_instructors, visible(instructors), "instructor_id", {"name": "name", "dni": "dni", "phone": "phone"}, how="inner"
    ).withColumnRenamed("instructor_id", "id")
    names = Details(detail, ["name", "id"], ["id", "name", "dni", "phone"], sizes=plan_instructors)
    return nest(visible(plans), "plan_id", {"instructors": names}, items=items).orderBy("duration_days", "id", "part")


def weekly_schedule(classes: DataFrame, users: DataFrame) -> DataFrame:
    """Active classes in weekday order, then by start; a day outside the week comes first."""
    rows = enrich(visible(classes), users, "created_by", {"name": "created_by_name"})
    ranked = rows.withColumn("weekday_no", weekday_rank("day_of_week", WEEKDAYS))
    return ranked.orderBy("weekday_no", "start_time", "id")


def active_notices(notices: DataFrame, users: DataFrame) -> DataFrame:
    rows = enrich(visible(notices), users, "created_by", {"name": "created_by_name"})
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def list_categories(categories: DataFrame, *, active_only: bool = False) -> DataFrame:
    return visible(categories, "active" if active_only else "all").orderBy("name", "id")


def list_instructors(instructors: DataFrame) -> DataFrame:
    return instructors.select("id", "name", "dni", "phone", "active").orderBy("name", "id")


def list_staff(users: DataFrame) -> DataFrame:
    """Staff without credentials, newest first."""
    shown = ["id", "username", "name", "email", "role", "active", "created_at"]
    return users.select(*shown).orderBy(F.desc("created_at"), F.desc("id"))


# --- upserts -----------------------------------------------------------------


@dataclass(frozen=True)
class Spec:
    """How rows of one dimension are cleaned, checked and merged."""

    columns: tuple[str, ...]
    required: tuple[str, ...] = ()
    trimmed: tuple[str, ...] = ()
    nullable_text: tuple[str, ...] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)
    domains: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    keeps_missing: bool = False  # an update leaves columns it does not name
    email: str | None = None


# The columns, defaults and uniqueness of each dimension.
SPECS = {
    "clients": Spec(
        columns=("username", "name", "phone", "dni", "address", "emergency_contact", "emergency_phone"),
        required=("username", "name", "dni"),
        unique=("username", "dni"),
    ),
    "users": Spec(
        columns=("username", "name", "email", "role"),
        required=("username", "name", "role"),
        nullable_text=("email",),
        domains={"role": ROLES},
        unique=("username", "email"),
        email="email",
    ),
    "plans": Spec(
        columns=("name", "duration_days", "price", "description"),
        required=("name", "duration_days", "price"),
        unique=("name",),
    ),
    "instructors": Spec(
        columns=("name", "dni", "phone"),
        required=("name", "dni"),
        trimmed=("name", "dni"),
        nullable_text=("phone",),
        unique=("dni",),
        keeps_missing=True,
    ),
    "categories": Spec(
        columns=("name", "description"),
        required=("name",),
        trimmed=("name",),
        nullable_text=("description",),
        unique=("name",),
    ),
    "classes": Spec(
        columns=("name", "description", "instructor", "day_of_week", "start_time", "end_time", "capacity"),
        required=("name", "day_of_week", "start_time", "end_time"),
        defaults={"capacity": 20},
        domains={"day_of_week": WEEKDAYS},
    ),
    "notices": Spec(
        columns=("title", "content", "type"),
        required=("title", "content"),
        defaults={"type": "info"},
        domains={"type": ("info", "warning", "success")},
    ),
}


def same_text(c: str | Column) -> Column:
    """A text as uniqueness sees it: case, accents and trailing blanks do not count."""
    return F.collate(F.rtrim(c), "UNICODE_CI_AI")


def _clean(changes: DataFrame, spec: Spec) -> DataFrame:
    def column(c: str) -> Column:
        value = F.col(c) if c in changes.columns else F.lit(None)
        if c in spec.nullable_text:
            value = blank_to_null(value)
        elif c in spec.trimmed:
            value = F.trim(value)
        if c in spec.defaults:
            value = F.coalesce(value, F.lit(spec.defaults[c]))
        return value.alias(c)

    extras = [c for c in ("active", "deleted", "created_by") if c in changes.columns]
    return changes.select("id", "requested_at", *extras, *[column(c) for c in spec.columns])


def _values(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """One row per unique column that is not null: its ``place`` among them and its ``key``."""
    stacked = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), key.alias("key")) for i, key in enumerate(columns.values())]))
    return rows.withColumn("_value", stacked).select("*", "_value.place", "_value.key").drop("_value").filter("key IS NOT NULL")


def upsert_dimension(current: DataFrame, changes: DataFrame, spec: Spec) -> dict[str, DataFrame]:
    """Create, update and soft-delete rows of a dimension in bulk.

    ``changes``: ``id, requested_at``, the spec's columns, and optionally ``active`` (missing means
    true), ``deleted`` (true keeps the row, inactive) and ``created_by``. Of several changes of an id the last requested counts,
    the others are rejected as ``superseded``. A unique value is taken if another row has it, inactive ones too, and no accepted earlier
    change gave it up, or if an accepted earlier change took it; a rejected change takes and frees nothing.
    """
    rows, superseded = last_requested(_clean(changes, spec))
    changes = rows
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in rows.columns else F.lit(False)
    wanted_active = F.coalesce("active", F.lit(True)) if "active" in rows.columns else F.lit(True)
    old = current.select(
        "id",
        F.lit(True).alias("_exists"),
        F.col("active").alias("_old_active"),
        *[F.col(c).alias(f"_old_{c}") for c in spec.columns],
    )
    merged = rows.withColumn("_deleted", deleted).withColumn("_active", wanted_active).join(old, "id", "left")
    if spec.keeps_missing:
        kept = {
            c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).cast(rows.schema[c].dataType), F.col(f"_old_{c}"))
            for c in spec.columns
        }
        merged = merged.withColumns(kept)
    checks = [
        (~F.col("_deleted") & F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)), f"{c}_required")
        for c in spec.required
    ]
    checks += [
        (~F.col("_deleted") & F.col(c).isNotNull() & ~F.col(c).isin(*domain), f"{c}_invalid")
        for c, domain in spec.domains.items()
    ]
    if spec.email:
        checks.append((~F.col("_deleted") & F.col(spec.email).isNotNull() & ~is_email(spec.email), f"{spec.email}_invalid"))
    checks.append((F.col("_deleted") & F.col("_exists").isNull(), "not_found"))
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])
    merged = merged.withColumn("_reason", reason)
    if spec.unique:
        live = merged.filter("_reason IS NULL AND NOT _deleted")
        asked = {c: same_text(c) for c in spec.unique}
        claims = _values(live, asked).select("id", "requested_at", "place", "key")
        mine = live.select(F.col("id").alias("_change"), "requested_at", *[asked[c].alias(f"_now_{i}") for i, c in enumerate(spec.unique)])
        have = _values(current.join(mine, current["id"] == F.col("_change"), "left"), asked)
        news = F.element_at(F.array(*[F.col(f"_now_{i}") for i in range(len(spec.unique))]), F.col("place") + 1)
        held = have.select("id", "requested_at", "place", "key", (F.col("_change").isNotNull() & ~news.eqNullSafe(F.col("key"))).alias("moves"))
        taken = settle_claims(claims, held).groupBy(F.col("id").alias("_loser")).agg(F.min("place").alias("_place"))
        names = F.coalesce(*[F.when(F.col("_place") == i, F.lit(f"{c}_taken")) for i, c in enumerate(spec.unique)])
        merged = merged.join(taken, F.col("id") == F.col("_loser"), "left").withColumn("_reason", F.coalesce("_reason", names)).drop("_loser", "_place")
    good = merged.filter("_reason IS NULL")
    written = good.select(
        "id",
        *[
            F.when(F.col("_deleted"), F.col(f"_old_{c}")).otherwise(F.col(c)).cast(current.schema[c].dataType).alias(c)
            for c in spec.columns
        ],
        F.when(F.col("_deleted"), F.lit(False)).otherwise(F.col("_active")).alias("active"),
    )
    carried = [c for c in current.columns if c not in written.columns]
    if carried:
        written = written.join(current.select("id", *carried), "id", "left")
        filled = [c for c in ("created_by",) if c in carried and c in changes.columns]
        for c in filled:
            mine = changes.select("id", F.col(c).alias("_mine"))
            written = written.join(mine, "id", "left").withColumn(c, F.coalesce(c, "_mine")).drop("_mine")
    kept_rows = current.join(good.select("id"), "id", "left_anti")
    return {
        "table": kept_rows.unionByName(written.select(*current.columns)),
        "rejected": merged.filter("_reason IS NOT NULL").select("id", F.col("_reason").alias("reason")).unionByName(superseded),
    }


def replace_bridge(bridge: DataFrame, changes: DataFrame, *, key: str, ids: str, child: str) -> DataFrame:
    """Bridge rows of changed keys replaced by their id arrays (ids below 1 are dropped, a NULL array clears)."""
    kept = bridge.join(changes.select(key), key, "left_anti")
    fresh = changes.select(key, F.explode(ids).alias(child)).filter(F.col(child) > 0).distinct()
    return kept.select(key, child).unionByName(fresh)


def deactivate_plans(plans: DataFrame, doomed: DataFrame, in_force: DataFrame) -> dict[str, DataFrame]:
    """Soft-delete plans unless a membership in force uses them. ``doomed``: one column of plan ids."""
    ids = doomed.select(F.col(doomed.columns[0]).alias("id"))
    used = in_force.select(F.col("plan_id").alias("id"))
    known = ids.join(plans.select("id"), "id", "left_semi")
    free = known.join(used, "id", "left_anti").withColumn("_off", F.lit(True))
    table = plans.join(free, "id", "left").withColumn("active", F.col("active") & F.col("_off").isNull()).drop("_off")
    blocked = known.join(used, "id", "left_semi").select("id", F.lit("plan_in_use").alias("reason"))
    missing = ids.join(plans.select("id"), "id", "left_anti").select("id", F.lit("not_found").alias("reason"))
    return {"table": table.select(*plans.columns), "rejected": blocked.unionByName(missing)}


# --- guarded hard delete --------------------------------------------------------


def _in_order(table: str, tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> list[tuple[str, list[ForeignKey]]]:
    """The tables that a deletion from ``table`` may reach, each after all that hand rows on to it, with the keys it is reached by.

    Only CASCADE keys hand on; a table that RESTRICT keys alone lead to is an end.
    """
    handing = {table}
    while more := {k.child for k in keys if k.on_delete == "CASCADE" and k.parent in handing and k.child in tables} - handing:
        handing |= more
    met = {t: [k for k in keys if k.child == t and k.parent in handing and k.on_delete in ("CASCADE", "RESTRICT")] for t in tables}
    done, out = {table}, []
    while waiting := [t for t, k in met.items() if k and t not in done]:
        ready = [t for t in waiting if all(k.parent in done for k in met[t])]
        if not ready:
            raise ValueError(f"foreign keys of {waiting} go round")
        out += [(t, met[t]) for t in ready]
        done |= set(ready)
    return out


def _key_of(df: DataFrame, table: str) -> list[str]:
    return ["id"] if "id" in df.columns else ["plan_id", "instructor_id"]


def _reached(
    tables: Mapping[str, DataFrame], table: str, roots: DataFrame, foreign_keys: Sequence[ForeignKey]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """For each table the rows that go with ``roots`` (``id``), as ``root`` and the row's key, and the roots that are held: ``(id, table, column)``.

    Tables are taken in the order of their keys, so each is read once, whatever number of paths lead to it: all its keys are looked up
    in one frontier of what its parents lose.
    """
    frontiers = {table: durable(roots.select(F.col("id").alias("root"), "id"))}
    held = []
    for name, keys in _in_order(table, tables, foreign_keys):
        child, goes = tables[name], any(k.on_delete == "CASCADE" for k in keys)
        own = _key_of(child, name) if goes else []
        links = F.array(
            *[
                F.struct(F.lit(k.column).alias("_column"), F.lit(k.parent).alias("_parent"), F.lit(k.on_delete == "CASCADE").alias("_goes"), F.col(k.column).cast("bigint").alias("_key"))
                for k in keys
            ]
        )
        lost = reduce(
            DataFrame.unionByName,
            [frontiers[p].select("root", F.lit(p).alias("_parent"), F.col("id").cast("bigint").alias("_key")) for p in sorted({k.parent for k in keys})],
        )
        rows = child.select(*own, F.explode(links).alias("_link")).select(*own, "_link.*").filter("_key IS NOT NULL")
        met = durable(rows.join(lost, ["_parent", "_key"]).select("root", "_column", "_goes", *own))
        if goes:
            frontiers[name] = met.filter("_goes").select("root", *own).distinct()
        held.append(met.filter("NOT _goes").select(F.col("root").alias("id"), F.lit(name).alias("table"), F.col("_column").alias("column")).distinct())
    none = roots.limit(0).select("id", F.lit("").alias("table"), F.lit("").alias("column"))
    return frontiers, reduce(DataFrame.unionByName, held, none)


def delete_with_propagation(
    tables: Mapping[str, DataFrame],
    table: str,
    doomed: DataFrame,
    *,
    foreign_keys: Sequence[ForeignKey] = FOREIGN_KEYS,
) -> dict[str, DataFrame]:
    """Delete rows by id, following the foreign keys: CASCADE, SET NULL, RESTRICT.

    An id is refused when a RESTRICT key holds it or anything that would go with it. What goes with each id is found once and serves
    both the refusals and the deletion. Returns the new snapshot of every given table, plus ``blocked`` (id, table, column).
    """
    roots = tables[table].join(doomed.select(F.col(doomed.columns[0]).alias("id")), "id", "left_semi").select("id")
    frontiers, blocked = _reached(tables, table, roots, foreign_keys)
    refused = blocked.select(F.col("id").alias("root")).distinct()
    gone = {name: rows.join(refused, "root", "left_anti").drop("root").distinct() for name, rows in frontiers.items()}
    out = {}
    for name, df in tables.items():
        if name in gone:
            df = df.join(gone[name], _key_of(tables[name], name), "left_anti")
        for key in foreign_keys:
            if key.child != name or key.on_delete != "SET NULL" or key.parent not in gone:
                continue
            lost = gone[key.parent].select(F.col("id").alias("_gone"))
            df = (
                df.join(lost, F.col(key.column) == F.col("_gone"), "left")
                .withColumn(key.column, F.when(F.col("_gone").isNull(), F.col(key.column)))
                .drop("_gone")
            )
        out[name] = df.select(*tables[name].columns)
    return {**out, "blocked": blocked}
