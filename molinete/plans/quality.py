"""Validation rule sets and integrity audits (V-1 .. V-14, V-18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.scalars import Money, at_least_zero, is_email, money
from molinete.operators.rows import enrich
from molinete.plans.dims import same_text
from molinete.schema import DOMAINS, DRAWER_METHODS, FOREIGN_KEYS, PAYMENT_METHODS, ROLES, STOCK_TYPES, UNIQUE_COLUMNS, UNITS

TOTAL = "decimal(38,2)"


@dataclass(frozen=True)
class Rule:
    field: str
    message: str | Column  # a column where the message names what is at fault
    fails: Column


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``errors``: every failed rule as ``(field, message)``, in rule order; empty when valid."""
    failed = F.array(
        *[
            F.when(
                F.coalesce(r.fails, F.lit(True)),
                F.struct(F.lit(r.field).alias("field"), (F.lit(r.message) if isinstance(r.message, str) else r.message).alias("message")),
            )
            for r in rules
        ]
    )
    return df.withColumn("errors", F.array_compact(failed))


def first_error(errors: str = "errors") -> Column:
    """The message a request would have been answered with, NULL when valid."""
    return F.get(errors, F.lit(0))["message"]


def blank(c: str | Column) -> Column:
    """NULL, empty or only blanks."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(col.cast("string")) == "", F.lit(True))


def not_positive(c: str) -> Column:
    return F.coalesce(F.col(c) <= 0, F.lit(True))


def outside(c: str | Column, domain: Sequence[str]) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(col.isin(*domain), F.lit(False))


def bad_number(c: str) -> Column:
    """Not a number, or negative. An empty text and a NULL count as zero."""
    n = F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("0")).try_cast("double")
    return n.isNull() | F.isnan(n) | (n < 0)


def _bad_payment(p: Column) -> Column:
    return outside(p["payment_method"], PAYMENT_METHODS) | F.coalesce(p["amount"] <= 0, F.lit(True))


def _has(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


# The messages below are fixed values.


def staff_profile_rules() -> list[Rule]:
    return [
        Rule("username", "El nombre de usuario es requerido", blank("username")),
        Rule("name", "El nombre es requerido", blank("name")),
        Rule("email", "El email no es válido", F.coalesce((F.col("email") != "") & ~is_email("email"), F.lit(False))),
    ]


def staff_rules() -> list[Rule]:
    return [
        Rule("username", "El nombre de usuario es requerido", blank("username")),
        Rule("name", "El nombre es requerido", blank("name")),
        Rule("role", "El rol debe ser 'admin' o 'empleado'", outside("role", ROLES)),
    ]


def client_rules() -> list[Rule]:
    return [
        Rule("username", "El nombre de usuario es requerido", blank("username")),
        Rule("name", "El nombre es requerido", blank("name")),
        Rule("dni", "El DNI es requerido", blank("dni")),
    ]


def plan_rules() -> list[Rule]:
    return [
        Rule("name", "El nombre del plan es requerido", blank("name")),
        Rule("duration_days", "La duración debe ser mayor a 0 días", not_positive("duration_days")),
        Rule("price", "El precio debe ser mayor a 0", not_positive("price")),
    ]


def instructor_rules() -> list[Rule]:
    return [
        Rule("name", "El nombre del instructor es requerido", blank("name")),
        Rule("dni", "El DNI del instructor es requerido", blank("dni")),
    ]


def instructor_update_rules() -> list[Rule]:
    """A column that is not given (NULL) is not checked."""
    return [
        Rule("name", "El nombre del instructor no puede estar vacío", F.col("name").isNotNull() & blank("name")),
        Rule("dni", "El DNI del instructor no puede estar vacío", F.col("dni").isNotNull() & blank("dni")),
    ]


def _needs_client_and_plan() -> list[Rule]:
    return [
        Rule("client_id", "El ID del cliente es requerido", F.coalesce(F.col("client_id") == 0, F.lit(True))),
        Rule("plan_id", "El ID del plan es requerido", F.coalesce(F.col("plan_id") == 0, F.lit(True))),
    ]


def membership_basic_rules() -> list[Rule]:
    return _needs_client_and_plan()


def membership_rules() -> list[Rule]:
    split = _has("payments")
    start = F.col("start_date")
    return [
        *_needs_client_and_plan(),
        Rule("payments", "Cada pago debe tener método válido y monto mayor a 0", split & F.exists("payments", _bad_payment)),
        Rule(
            "payment_method",
            "El método de pago debe ser 'cash', 'transfer', 'credit_card' o 'current_account'",
            ~split & outside("payment_method", PAYMENT_METHODS),
        ),
        Rule("start_date", "La fecha de inicio es requerida", blank("start_date")),
        Rule(
            "start_date",
            "La fecha de inicio no es válida. Usá formato AAAA-MM-DD.",
            ~blank("start_date") & start.try_cast("date").isNull(),
        ),
    ]


def open_session_rules() -> list[Rule]:
    amount = F.col("opening_amount")
    return [
        Rule("opening_amount", "El monto inicial es requerido", amount.isNull()),
        Rule("opening_amount", "El monto inicial no puede ser negativo", F.coalesce(amount < 0, F.lit(False))),
    ]


def close_session_rules() -> list[Rule]:
    amount = F.col("closing_amount")
    return [
        Rule("closing_amount", "El monto de cierre es requerido", amount.isNull()),
        Rule("closing_amount", "El monto de cierre no puede ser negativo", F.coalesce(amount < 0, F.lit(False))),
    ]


def cash_movement_rules() -> list[Rule]:
    return [
        Rule("type", "El tipo debe ser 'income' o 'expense'", outside("type", ("income", "expense"))),
        Rule(
            "payment_method",
            "El método de pago debe ser 'cash', 'transfer' o 'credit_card'",
            outside("payment_method", DRAWER_METHODS),
        ),
        Rule("amount", "El monto debe ser mayor a 0", not_positive("amount")),
        Rule("description", "La descripción es requerida", blank("description")),
    ]


def product_rules(*, creating: bool = True) -> list[Rule]:
    rules = [
        Rule("name", "El nombre del producto es requerido", blank("name")),
        Rule("code", "El código del producto es requerido", blank("code")),
        Rule("sale_price", "El precio de venta debe ser un número mayor o igual a 0", bad_number("sale_price")),
        Rule("cost_price", "El precio de costo debe ser un número mayor o igual a 0", bad_number("cost_price")),
        Rule("min_stock", "El stock mínimo debe ser un número mayor o igual a 0", bad_number("min_stock")),
        Rule(
            "unit",
            "La unidad de medida debe ser 'kg' o 'unidad'",
            F.coalesce((F.col("unit") != "") & outside("unit", UNITS), F.lit(False)),
        ),
    ]
    if creating:
        rules.append(
            Rule("stock_inicial", "El stock inicial debe ser un número mayor o igual a 0", bad_number("stock_inicial"))
        )
    return rules


def category_rules() -> list[Rule]:
    return [Rule("name", "El nombre de la categoría es requerido", blank("name"))]


def sale_rules() -> list[Rule]:
    """The first item at fault is named by its number; ``item_errors`` has all of them."""
    split = _has("payments")
    no_client = F.coalesce(F.col("client_id") == 0, F.lit(True))
    on_account = F.when(split, F.exists("payments", lambda p: p["payment_method"] == "current_account")).otherwise(
        F.col("payment_method") == "current_account"
    )
    no_client_text = "Para venta a cuenta corriente es obligatorio indicar el cliente (client_id)"
    return [
        Rule("items", "La venta debe incluir al menos un producto", ~_has("items")),
        Rule(
            "items",
            F.get(item_errors(), F.lit(0)),
            _has("items") & F.exists("items", lambda i: _no_product(i) | _no_quantity(i)),
        ),
        Rule(
            "payments",
            "Cada pago debe tener método válido (cash, transfer, credit_card, current_account) y monto mayor a 0",
            split & F.exists("payments", _bad_payment),
        ),
        Rule(
            "payment_method",
            "El método de pago debe ser cash, transfer, credit_card o current_account",
            ~split & outside("payment_method", PAYMENT_METHODS),
        ),
        Rule("client_id", no_client_text, F.coalesce(on_account, F.lit(False)) & no_client),
    ]


def _no_product(i: Column) -> Column:
    return F.coalesce(i["product_id"] == 0, F.lit(True))


def _no_quantity(i: Column) -> Column:
    return F.coalesce(i["quantity"] <= 0, F.lit(True))


def item_errors(items: str = "items") -> Column:
    """One message per faulty item, with its number."""

    def message(i: Column, n: Column) -> Column:
        head = F.concat(F.lit("El item "), (n + 1).cast("string"))
        return F.when(_no_product(i), F.concat(head, F.lit(" debe tener product_id"))).when(
            _no_quantity(i), F.concat(head, F.lit(" debe tener cantidad mayor a 0"))
        )

    return F.array_compact(F.transform(items, message))


def stock_movement_rules() -> list[Rule]:
    q = F.col("quantity").try_cast("double")
    return [
        Rule("product_id", "El ID del producto es requerido", F.coalesce(F.col("product_id") == 0, F.lit(True))),
        Rule("type", "El tipo debe ser 'entrada', 'salida' o 'ajuste'", outside("type", STOCK_TYPES)),
        Rule(
            "quantity",
            "La cantidad debe ser un número distinto de cero",
            F.coalesce(F.isnan(q) | (q == 0), F.lit(True)),
        ),
    ]


# --- audits over stored tables -----------------------------------------------


def uniqueness_conflicts(df: DataFrame, column: str, *, key: str = "id") -> DataFrame:
    """Rows sharing a value that must be unique (case, accents and trailing blanks ignored; NULLs allowed)."""
    texts = df.filter(F.col(column).isNotNull()).select(F.col(key), F.col(column), same_text(column).alias("_text"))
    shared = texts.groupBy("_text").agg(F.count(F.lit(1)).alias("rows_sharing")).filter("rows_sharing > 1")
    return texts.join(shared, "_text").select(key, column, "rows_sharing")


def uniqueness_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Values of the declared unique columns that several rows have, as ``(table, column, value, rows_sharing)``; each table is read once.

    ``value`` is the smallest spelling (case, accents and trailing blanks ignored; NULLs allowed).
    """
    parts = []
    for name in dict.fromkeys(n for n, c in UNIQUE_COLUMNS if n in tables and c in tables[n].columns):
        entries = [
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for n, c in UNIQUE_COLUMNS
            if n == name and c in tables[name].columns
        ]
        parts.append(_stacked(tables[name], entries))
    held = reduce(DataFrame.unionByName, parts).filter("value IS NOT NULL")
    shared = held.groupBy("table", "column", same_text("value").alias("_text")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("rows_sharing"))
    return shared.filter("rows_sharing > 1").select("table", "column", "value", "rows_sharing")


def conflicts_with_state(changes: DataFrame, state: DataFrame, column: str, *, key: str = "id") -> DataFrame:
    """Changes whose value is held by another row of the stored table."""
    held = state.select(F.col(key).alias("_holder"), same_text(column).alias("_held"))
    mine = changes.withColumn("_text", same_text(column))
    clash = (F.col("_text") == F.col("_held")) & (F.col(key) != F.col("_holder"))
    return mine.join(held, clash, "left_semi").drop("_text")


def unchecked(tables: Mapping[str, DataFrame]) -> dict[str, list[tuple[str, str]]]:
    """The declared foreign keys and domains, as (table, column), that :func:`fk_audit` and :func:`domain_audit` cannot check with these tables."""
    has = lambda table, column: table in tables and column in tables[table].columns
    return {
        "foreign_keys": [(k.child, k.column) for k in FOREIGN_KEYS if k.parent not in tables or not has(k.child, k.column)],
        "domains": [(name, column) for name, column in DOMAINS if not has(name, column)],
    }


def _stacked(table: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """The table read once, one row per entry."""
    return table.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def fk_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Values of declared foreign keys without a parent row, and how many rows hold each; see :func:`unchecked` for what is left out.

    Each table is read once as a child, all its keys stacked and reduced to distinct values before they are shuffled, and once as a parent.
    """
    skipped = set(unchecked(tables)["foreign_keys"])
    checked = [k for k in FOREIGN_KEYS if (k.child, k.column) not in skipped]
    values = []
    for child in dict.fromkeys(k.child for k in checked):
        keys = [
            F.struct(F.lit(child).alias("child"), F.lit(k.column).alias("column"), F.lit(k.parent).alias("parent"), F.col(k.column).cast("bigint").alias("value"))
            for k in checked
            if k.child == child
        ]
        values.append(_stacked(tables[child], keys))
    held = reduce(DataFrame.unionByName, values).filter("value IS NOT NULL").groupBy("child", "column", "parent", "value").agg(F.count(F.lit(1)).alias("rows_affected"))
    parents = [tables[p].select(F.lit(p).alias("parent"), F.col("id").cast("bigint").alias("value")) for p in dict.fromkeys(k.parent for k in checked)]
    orphans = held.join(reduce(DataFrame.unionByName, parents), ["parent", "value"], "left_anti")
    return orphans.select("child", "column", "parent", "value", "rows_affected")


def domain_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Values outside their declared domain, and how many rows hold each; each table is read once."""
    skipped = set(unchecked(tables)["domains"])
    parts = []
    for name in dict.fromkeys(n for n, c in DOMAINS if (n, c) not in skipped):
        entries = [
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.when(~F.col(c).isin(*domain), F.col(c).cast("string")).alias("value"))
            for (n, c), domain in DOMAINS.items()
            if n == name and (n, c) not in skipped
        ]
        parts.append(_stacked(tables[name], entries).filter("value IS NOT NULL").groupBy("table", "column", "value").agg(F.count(F.lit(1)).alias("rows_affected")))
    return reduce(DataFrame.unionByName, parts)


def membership_payment_audit(memberships: DataFrame, payments: DataFrame, plans: DataFrame) -> DataFrame:
    """Memberships whose payment rows do not add up to price less discount (within a cent)."""
    paid = payments.groupBy(F.col("membership_id").alias("_m")).agg(F.sum("amount").cast(TOTAL).alias("paid_total"))
    priced = enrich(memberships, plans, "plan_id", {"price": "plan_price"}, how="inner")
    due = at_least_zero(money(F.col("plan_price") - F.coalesce("discount", F.lit(0))))
    return (
        priced.join(paid, F.col("id") == F.col("_m"))
        .withColumn("amount_due", due)
        .filter(F.abs(F.col("paid_total") - F.col("amount_due")) > F.lit("0.01").cast(Money))
        .select("id", "amount_due", "paid_total")
    )
