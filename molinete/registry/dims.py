"""Dimension, data-quality and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from molinete.functions.scalars import epoch_seconds
from molinete.operators.rows import apply_updates, delete_matching, split_by_existence
from molinete.plans import dims as X
from molinete.plans import quality as Q
from molinete.functions.predicates import is_active
from molinete.registry.core import query
from molinete.registry.roles_sql import AS_OF as D
from molinete.session import durable, work_folder
from molinete.sources.roles import AS_OF, Roles
from molinete.sources.store import Store
from molinete.streaming import streams as T

ACTIVE = f"status = 'active' AND start_date <= {D} AND end_date >= {D}"


@query(
    "plans_with_instructors",
    """SELECT p.id, CAST(0 AS BIGINT) AS part, p.name, p.duration_days, p.price, coalesce(i.instructors, '') AS instructors FROM plans p
    LEFT JOIN (SELECT b.plan_id, string_agg(i.id || ':' || i.name || ':' || i.phone, ';' ORDER BY i.name, i.id) AS instructors
        FROM plan_instructors b JOIN instructors i ON i.id = b.instructor_id AND i.active GROUP BY b.plan_id) i ON i.plan_id = p.id
    WHERE p.active""",
)
def _(r: Roles):
    documents = X.plans_with_instructors(r.plans, r.plan_instructors, r.instructors)
    text = F.transform("instructors", lambda i: F.concat_ws(":", i["id"].cast("string"), i["name"], i["phone"]))
    return documents.select("id", "part", "name", "duration_days", "price", F.array_join(text, ";").alias("instructors"))


@query(
    "weekly_schedule",
    """SELECT c.id, c.name, c.day_of_week, c.start_time, u.name AS created_by_name, CAST(coalesce(list_position(['Lunes', 'Martes',
        'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo'], c.day_of_week), 0) AS INTEGER) AS weekday_no
    FROM classes c LEFT JOIN users u ON u.id = c.created_by WHERE c.active""",
)
def _(r: Roles):
    out = X.weekly_schedule(r.classes, r.users)
    return out.select("id", "name", "day_of_week", "start_time", "created_by_name", "weekday_no")


@query(
    "active_notices",
    "SELECT n.*, u.name AS created_by_name FROM notices n LEFT JOIN users u ON u.id = n.created_by WHERE n.active",
)
def _(r: Roles):
    return X.active_notices(r.notices, r.users)


@query("list_categories", "SELECT * FROM categories WHERE active")
def _(r: Roles):
    return X.list_categories(r.categories, active_only=True)


@query("list_instructors", "SELECT id, name, dni, phone, active FROM instructors")
def _(r: Roles):
    return X.list_instructors(r.instructors)


@query("list_staff", "SELECT id, username, name, email, role, active, created_at FROM users")
def _(r: Roles):
    return X.list_staff(r.users)


@query(
    "plans_in_use",
    f"""SELECT id, id IN (SELECT plan_id FROM memberships WHERE {ACTIVE}) AS in_use FROM plans""",
)
def _(r: Roles):
    used, free = split_by_existence(
        r.plans.select("id"), "id", r.memberships.filter(is_active(AS_OF)), "plan_id"
    )
    return used.withColumn("in_use", F.lit(True)).unionByName(free.withColumn("in_use", F.lit(False)))


@query(
    "deactivate_plans",
    f"""SELECT id, name, active AND (id % 2 <> 0 OR id IN (SELECT plan_id FROM memberships WHERE {ACTIVE})) AS active FROM plans""",
)
def _(r: Roles):
    doomed = r.plans.filter("id % 2 = 0").select("id")
    out = X.deactivate_plans(r.plans, doomed, r.memberships.filter(is_active(AS_OF)))["table"]
    return out.select("id", "name", "active")


@query(
    "delete_by_join",
    "SELECT m.id, m.client_id FROM memberships m WHERE m.client_id NOT IN (SELECT id FROM clients WHERE username LIKE 'customer_%7')",
)
def _(r: Roles):
    doomed = r.clients.filter(F.col("username").like("customer_%7")).select("id")
    return delete_matching(r.memberships, "client_id", doomed).select("id", "client_id")


def _client_changes(r: Roles):
    """Two changes per client: of the client itself (every third) or of one that is not there yet; user names clash with others now and then."""
    key, own = F.col("c_custkey"), ~F.col("_new") & (F.col("c_custkey") % 3 == 0)
    both = r.raw("customer").select(key, "c_mktsegment").withColumn("_new", F.explode(F.array(F.lit(False), F.lit(True))))
    top = r.raw("customer").agg(F.max("c_custkey") + 1).scalar()
    return both.select(
        (key + F.when(F.col("_new"), top).when(own, F.lit(0)).otherwise(2 * top)).alias("id"),
        F.lit("2001-06-15 09:00:00").cast("timestamp_ntz").alias("requested_at"),
        F.when((key % 17 == 0) & (~F.col("_new") | (key % 2 == 0)), F.lit(" "))
        .when(F.col("_new") & ((key % 5 == 0) | (key % 10 == 9)), F.concat(F.lit("CUSTOMER_"), F.lpad(key.cast("string"), 9, "0")))
        .otherwise(F.concat(F.when(F.col("_new"), "nuevo").otherwise("viejo"), key.cast("string")))
        .alias("username"),
        F.col("c_mktsegment").alias("name"),
        F.concat(F.when(F.col("_new"), "N").otherwise("V"), key.cast("string")).alias("dni"),
        F.lit(None).cast("string").alias("phone"),
        (key % 7 != 0).alias("active"),
        # Clients deleted in the same batch keep their user names, which new ones ask for.
        ((key % 10 == 9) & (~F.col("_new") | (key % 20 == 19))).alias("deleted"),
    )


_CLIENT_SQL = """top AS (SELECT max(c_custkey) + 1 AS t FROM customer),
    ch AS (SELECT c_custkey + CASE WHEN n THEN t WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 * t END AS id,
            CASE WHEN c_custkey % 17 = 0 AND (NOT n OR c_custkey % 2 = 0) THEN ' '
                WHEN n AND (c_custkey % 5 = 0 OR c_custkey % 10 = 9) THEN 'CUSTOMER_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
                ELSE (CASE WHEN n THEN 'nuevo' ELSE 'viejo' END) || c_custkey END AS username, c_mktsegment AS name,
            (CASE WHEN n THEN 'N' ELSE 'V' END) || c_custkey AS dni, c_custkey % 7 <> 0 AS active,
            c_custkey % 10 = 9 AND (NOT n OR c_custkey % 20 = 19) AS deleted, n OR c_custkey % 3 <> 0 AS fresh
        FROM customer, top, (VALUES (false), (true)) v(n)),
    judged AS (SELECT ch.*, CASE WHEN NOT deleted AND trim(username) = '' THEN 'username_required'
            WHEN deleted AND fresh THEN 'not_found'
            -- Only clients renamed by a change that is itself accepted have given their name up.
            WHEN NOT deleted AND lower(username) IN (SELECT lower(username) FROM clients WHERE id NOT IN
                (SELECT id FROM ch WHERE NOT fresh AND NOT deleted AND trim(username) <> ''))
            THEN 'username_taken' END AS reason FROM ch)"""

_SLIM = ("id", "username", "name", "dni", "phone", "active")


def _upserted_clients(r: Roles):
    slim = X.Spec(
        columns=("username", "name", "dni", "phone"), required=("username", "name", "dni"), unique=("username", "dni")
    )
    return X.upsert_dimension(r.clients.select(*_SLIM), _client_changes(r), slim)


@query(
    "upsert_clients",
    f"""WITH {_CLIENT_SQL} SELECT j.id, CASE WHEN j.deleted THEN c.username ELSE j.username END AS username,
        CASE WHEN j.deleted THEN c.name ELSE j.name END AS name, CASE WHEN j.deleted THEN c.dni ELSE j.dni END AS dni,
        CASE WHEN j.deleted THEN c.phone END AS phone, j.active AND NOT j.deleted AS active
    FROM judged j LEFT JOIN clients c ON c.id = j.id WHERE j.reason IS NULL
    UNION ALL SELECT id, username, name, dni, phone, active FROM clients WHERE id NOT IN (SELECT id FROM judged WHERE reason IS NULL)""",
)
def _(r: Roles):
    return _upserted_clients(r)["table"]


@query("upsert_clients_rejected", f"WITH {_CLIENT_SQL} SELECT id, reason FROM judged WHERE reason IS NOT NULL")
def _(r: Roles):
    return _upserted_clients(r)["rejected"]


@query(
    "replace_plan_instructors",
    """SELECT plan_id, instructor_id FROM plan_instructors WHERE plan_id % 4 <> 0
    UNION ALL SELECT id, id % 9 FROM plans WHERE id % 4 = 0 AND id % 9 > 0
    UNION ALL SELECT id, 9 FROM plans WHERE id % 4 = 0""",
)
def _(r: Roles):
    changes = r.plans.filter("id % 4 = 0").select(
        F.col("id").alias("plan_id"), F.array(F.col("id") % 9, F.lit(9), F.lit(9)).alias("ids")
    )
    return X.replace_bridge(r.plan_instructors, changes, key="plan_id", ids="ids", child="instructor_id")


@query(
    "apply_updates",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'cancelled' ELSE status END AS status,
        CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'pending' ELSE payment_status END AS payment_status FROM memberships""",
)
def _(r: Roles):
    changes = r.memberships.filter("id % 3 = 0").select(
        "id",
        F.lit("cancelled").alias("status"),
        F.when(F.col("id") % 2 == 0, "pending").alias("payment_status"),
    )
    return apply_updates(r.memberships, changes, ["id"]).select("id", "status", "payment_status")


def _deleted(r: Roles):
    tables = {
        "clients": r.clients,
        "memberships": r.memberships,
        "membership_payments": r.membership_payments.withColumn("id", F.col("membership_id")),
        "client_entries": r.client_entries,
        "sales": r.sales,
        "current_account": r.ledger_moves,
    }
    return X.delete_with_propagation(tables, "clients", r.clients.filter("id % 3 = 0").select("id"))


@query("delete_clients_memberships", "SELECT id, client_id FROM memberships WHERE client_id % 3 <> 0")
def _(r: Roles):
    return _deleted(r)["memberships"].select("id", "client_id")


@query(
    "delete_clients_entries",
    """SELECT id, client_id, membership_id FROM client_entries WHERE client_id % 3 <> 0
    AND membership_id NOT IN (SELECT id FROM memberships WHERE client_id % 3 = 0)""",
)
def _(r: Roles):
    return _deleted(r)["client_entries"].select("id", "client_id", "membership_id")


@query(
    "delete_clients_sales",
    "SELECT id, CASE WHEN client_id % 3 <> 0 THEN client_id END AS client_id, total FROM sales",
)
def _(r: Roles):
    return _deleted(r)["sales"].select("id", "client_id", "total")


@query(
    "delete_products_blocked",
    """SELECT id, 'sale_items' AS "table", 'product_id' AS "column" FROM products
    WHERE id % 2 = 0 AND id IN (SELECT CASE WHEN quantity > 49 THEN product_id END FROM sale_items)""",
)
def _(r: Roles):
    tables = {
        "products": r.products,
        # small lines name no product, so that some products are free
        "sale_items": r.sale_items.withColumn("product_id", F.when(F.col("quantity") > 49, F.col("product_id"))),
        "stock_movements": r.stock_movements.withColumn("id", F.col("source_id")),
    }
    return X.delete_with_propagation(tables, "products", r.products.filter("id % 2 = 0").select("id"))["blocked"]


# --- data quality ------------------------------------------------------------------


@query(
    "uniqueness_conflicts",
    """SELECT id, name, count(*) OVER (PARTITION BY lower(name)) AS rows_sharing FROM plans
    QUALIFY count(*) OVER (PARTITION BY lower(name)) > 1""",
)
def _(r: Roles):
    return Q.uniqueness_conflicts(r.plans, "name")


_UNIQUE = ("clients.username", "clients.dni", "users.username", "users.email", "products.code", "plans.name", "categories.name", "instructors.dni")


@query(
    "uniqueness_audit",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", min(CAST({c} AS VARCHAR)) AS value, count(*) AS rows_sharing
        FROM {t} WHERE {c} IS NOT NULL GROUP BY lower(CAST({c} AS VARCHAR)) HAVING count(*) > 1"""
        for t, c in (x.split(".") for x in _UNIQUE)
    )
    + ")",
)
def _(r: Roles):
    return Q.uniqueness_audit({t: getattr(r, t) for t in ("clients", "users", "products", "plans", "categories", "instructors")})


@query(
    "conflicts_with_state",
    """SELECT e.id, e.code FROM (SELECT event_id AS id, ' p' || user_id AS code FROM events) e
    WHERE EXISTS (SELECT 1 FROM products p WHERE upper(p.code) = upper(trim(e.code)) AND p.id <> e.id)""",
)
def _(r: Roles):
    changes = r.raw("events").select(
        F.col("event_id").alias("id"), F.concat(F.lit(" p"), F.col("user_id").cast("string")).alias("code")
    )
    trimmed = changes.withColumn("_raw", F.col("code")).withColumn("code", F.ltrim("code"))
    return Q.conflicts_with_state(trimmed, r.products, "code").select("id", F.col("_raw").alias("code"))


def _audited(r: Roles):
    return {
        "users": r.users,
        "clients": r.clients,
        "plans": r.plans,
        "instructors": r.instructors,
        "plan_instructors": r.plan_instructors,
        "notices": r.notices,
        "classes": r.classes,
        "memberships": r.memberships,
        "membership_payments": r.membership_payments,
        "cash_sessions": r.cash_sessions,
        "cash_movements": r.cash_movements,
        "client_entries": r.client_entries,
        "current_account": r.ledger_moves,
        "sales": r.sales,
        "sale_payments": r.sale_payments,
        "sale_items": r.sale_items,
        "products": r.products,
        "stock_movements": r.stock_movements,
    }


def _fk_sql(rows):
    return " UNION ALL ".join(
        f"""SELECT '{child}' AS child, '{column}' AS "column", '{parent}' AS parent, CAST({column} AS BIGINT) AS value,
        count(*) AS rows_affected FROM {'ledger_moves' if child == 'current_account' else child} c
        WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{column}) GROUP BY {column}"""
        for child, column, parent in rows
    )


@query(
    "fk_audit",
    _fk_sql(
        [
            ("clients", "created_by", "users"),
            ("notices", "created_by", "users"),
            ("classes", "created_by", "users"),
            ("plan_instructors", "plan_id", "plans"),
            ("plan_instructors", "instructor_id", "instructors"),
            ("cash_sessions", "user_id", "users"),
            ("cash_movements", "cash_session_id", "cash_sessions"),
            ("cash_movements", "created_by", "users"),
            ("memberships", "client_id", "clients"),
            ("memberships", "plan_id", "plans"),
            ("memberships", "instructor_id", "instructors"),
            ("memberships", "created_by", "users"),
            ("memberships", "cash_movement_id", "cash_movements"),
            ("membership_payments", "membership_id", "memberships"),
            ("membership_payments", "cash_movement_id", "cash_movements"),
            ("client_entries", "client_id", "clients"),
            ("client_entries", "membership_id", "memberships"),
            ("client_entries", "created_by", "users"),
            ("current_account", "client_id", "clients"),
            ("current_account", "membership_id", "memberships"),
            ("current_account", "created_by", "users"),
            ("stock_movements", "product_id", "products"),
            ("stock_movements", "created_by", "users"),
            ("sales", "user_id", "users"),
            ("sales", "client_id", "clients"),
            ("sales", "cash_session_id", "cash_sessions"),
            ("sales", "cash_movement_id", "cash_movements"),
            ("sale_payments", "sale_id", "sales"),
            ("sale_payments", "cash_movement_id", "cash_movements"),
            ("sale_items", "sale_id", "sales"),
            ("sale_items", "product_id", "products"),
        ]
    ),
)
def _(r: Roles):
    return Q.fk_audit(_audited(r))


@query(
    "domain_audit",
    """SELECT 'classes' AS "table", 'day_of_week' AS "column", day_of_week AS value, count(*) AS rows_affected FROM classes
    WHERE day_of_week NOT IN ('Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo') GROUP BY day_of_week""",
)
def _(r: Roles):
    return Q.domain_audit(_audited(r))


@query(
    "membership_payment_audit",
    """WITH paid AS (SELECT membership_id, CAST(sum(amount) AS DECIMAL(38,2)) AS paid_total FROM membership_payments GROUP BY 1)
    SELECT * FROM (SELECT m.id, CAST(greatest(0, p.price - m.discount) AS DECIMAL(12,2)) AS amount_due, d.paid_total
        FROM memberships m JOIN plans p ON p.id = m.plan_id JOIN paid d ON d.membership_id = m.id)
    WHERE abs(paid_total - amount_due) > 0.01""",
)
def _(r: Roles):
    return Q.membership_payment_audit(r.memberships, r.membership_payments, r.plans)


def _errors(df, *keys):
    text = F.transform("errors", lambda e: F.concat_ws("=", e["field"], e["message"]))
    return df.select(*keys, F.array_join(text, ";").alias("errors"), Q.first_error().alias("message"))


# The messages in the SQL of this section are fixed values.


def _error_sql(source: str, key: str, rules: list[tuple[str, str, str]]) -> str:
    """``rules``: (field, message, condition under which it fails)."""
    parts = ", ".join(f"CASE WHEN {bad} THEN '{field}={message}' END" for field, message, bad in rules)
    first = " ".join(f"WHEN {bad} THEN '{message}'" for _, message, bad in rules)
    return f"SELECT {key}, concat_ws(';', {parts}) AS errors, CASE {first} END AS message FROM ({source})"


@query(
    "validate_staff",
    _error_sql(
        "SELECT id, username, CASE WHEN id % 4 = 0 THEN ' ' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN 'jefe' ELSE role END AS role FROM users",
        "id",
        [
            ("username", "El nombre de usuario es requerido", "trim(username) = ''"),
            ("name", "El nombre es requerido", "trim(name) = ''"),
            ("role", "El rol debe ser ''admin'' o ''empleado''", "role NOT IN ('admin', 'empleado')"),
        ],
    ),
)
def _(r: Roles):
    rows = r.users.withColumn("name", F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("name"))).withColumn(
        "role", F.when(F.col("id") % 3 == 0, "jefe").otherwise(F.col("role"))
    )
    return _errors(Q.apply_rules(rows, Q.staff_rules()), "id")


@query(
    "validate_profiles",
    _error_sql(
        "SELECT id, username, name, email FROM users",
        "id",
        [("email", "El email no es válido", "NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')")],
    ),
)
def _(r: Roles):
    return _errors(Q.apply_rules(r.users, Q.staff_profile_rules()), "id")


@query(
    "validate_clients",
    _error_sql(
        """SELECT id, CASE WHEN id % 9 <> 0 THEN username END AS username, CASE WHEN id % 8 = 0 THEN '  ' ELSE name END AS name, dni FROM clients""",
        "id",
        [
            ("username", "El nombre de usuario es requerido", "username IS NULL"),
            ("name", "El nombre es requerido", "trim(name) = ''"),
        ],
    ),
)
def _(r: Roles):
    rows = r.clients.withColumn("username", F.when(F.col("id") % 9 != 0, F.col("username"))).withColumn(
        "name", F.when(F.col("id") % 8 == 0, "  ").otherwise(F.col("name"))
    )
    return _errors(Q.apply_rules(rows, Q.client_rules()), "id")


@query(
    "validate_plans",
    _error_sql(
        "SELECT id, name, duration_days - 5 AS duration_days, price - 950 AS price FROM plans",
        "id",
        [
            ("duration_days", "La duración debe ser mayor a 0 días", "duration_days <= 0"),
            ("price", "El precio debe ser mayor a 0", "price <= 0"),
        ],
    ),
)
def _(r: Roles):
    rows = r.plans.withColumn("duration_days", F.col("duration_days") - 5).withColumn("price", F.col("price") - 950)
    return _errors(Q.apply_rules(rows, Q.plan_rules()), "id")


@query(
    "validate_instructors",
    _error_sql(
        "SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE name END AS name, CASE WHEN id % 3 <> 0 THEN dni END AS dni FROM instructors",
        "id",
        [
            ("name", "El nombre del instructor es requerido", "name = ''"),
            ("dni", "El DNI del instructor es requerido", "dni IS NULL"),
        ],
    ),
)
def _(r: Roles):
    return _errors(Q.apply_rules(_instructors(r), Q.instructor_rules()), "id")


def _instructors(r: Roles):
    return r.instructors.withColumn("name", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("name"))).withColumn(
        "dni", F.when(F.col("id") % 3 != 0, F.col("dni"))
    )


@query(
    "validate_instructor_updates",
    _error_sql(
        "SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE name END AS name FROM instructors",
        "id",
        [("name", "El nombre del instructor no puede estar vacío", "name = ''")],
    ),
)
def _(r: Roles):
    return _errors(Q.apply_rules(_instructors(r), Q.instructor_update_rules()), "id")


@query(
    "validate_cash_movements",
    _error_sql(
        "SELECT *, CASE WHEN id % 11 = 0 THEN ' ' ELSE description END AS text, amount - 1 AS less FROM cash_movements",
        "id",
        [
            ("type", "El tipo debe ser ''income'' o ''expense''", "type NOT IN ('income', 'expense')"),
            ("amount", "El monto debe ser mayor a 0", "less <= 0"),
            ("description", "La descripción es requerida", "text = ' '"),
        ],
    ),
)
def _(r: Roles):
    rows = r.cash_movements.withColumn(
        "description", F.when(F.col("id") % 11 == 0, " ").otherwise(F.col("description"))
    ).withColumn("amount", F.col("amount") - 1)
    return _errors(Q.apply_rules(rows, Q.cash_movement_rules()), "id")


@query(
    "validate_sessions",
    """SELECT id, CASE WHEN id % 5 = 0 THEN 'El monto inicial es requerido' WHEN id % 5 = 1 THEN 'El monto inicial no puede ser negativo' END
        AS opening, CASE WHEN closing_amount IS NULL THEN 'El monto de cierre es requerido' WHEN closing_amount < 3000
        THEN 'El monto de cierre no puede ser negativo' END AS closing FROM cash_sessions""",
)
def _(r: Roles):
    rows = r.cash_sessions.withColumn(
        "opening_amount", F.when(F.col("id") % 5 == 1, F.lit(-1)).when(F.col("id") % 5 != 0, F.col("opening_amount"))
    ).withColumn("closing_amount", F.col("closing_amount") - 3000)
    opened = Q.apply_rules(rows, Q.open_session_rules()).withColumn("opening", Q.first_error()).drop("errors")
    closed = Q.apply_rules(opened, Q.close_session_rules()).withColumn("closing", Q.first_error())
    return closed.select("id", "opening", "closing")


@query(
    "validate_products",
    _error_sql(
        """SELECT id, sale_price, CASE WHEN id % 6 = 0 THEN 'gratis' END AS bad, stock, CASE WHEN id % 5 = 0 THEN 'litro' ELSE unit END AS unit
        FROM products""",
        "id",
        [
            ("sale_price", "El precio de venta debe ser un número mayor o igual a 0", "bad IS NOT NULL"),
            ("min_stock", "El stock mínimo debe ser un número mayor o igual a 0", "stock < 0"),
            ("unit", "La unidad de medida debe ser ''kg'' o ''unidad''", "unit NOT IN ('kg', 'unidad')"),
        ],
    ),
)
def _(r: Roles):
    rows = r.products.select(
        "id",
        "name",
        "code",
        F.when(F.col("id") % 6 == 0, "gratis").otherwise(F.col("sale_price").cast("string")).alias("sale_price"),
        "cost_price",
        F.col("stock").alias("min_stock"),
        F.when(F.col("id") % 5 == 0, "litro").otherwise(F.col("unit")).alias("unit"),
        F.lit("").alias("stock_inicial"),
    )
    return _errors(Q.apply_rules(rows, Q.product_rules()), "id")


@query(
    "validate_categories",
    _error_sql(
        "SELECT id, CASE WHEN id % 2 = 0 THEN ' ' ELSE name END AS name FROM categories",
        "id",
        [("name", "El nombre de la categoría es requerido", "trim(name) = ''")],
    ),
)
def _(r: Roles):
    rows = r.categories.withColumn("name", F.when(F.col("id") % 2 == 0, " ").otherwise(F.col("name")))
    return _errors(Q.apply_rules(rows, Q.category_rules()), "id")


@query(
    "validate_stock_movements",
    """SELECT event_id AS id, concat_ws(';', CASE WHEN user_id = 0 THEN 'product_id=El ID del producto es requerido' END,
        CASE WHEN event_type NOT IN ('view', 'click') THEN 'type=El tipo debe ser ''entrada'', ''salida'' o ''ajuste''' END,
        CASE WHEN floor(value) = 0 THEN 'quantity=La cantidad debe ser un número distinto de cero' END) AS errors FROM events""",
)
def _(r: Roles):
    kind = F.col("event_type")
    rows = r.raw("events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("product_id"),
        F.when(kind == "view", "entrada").when(kind == "click", "salida").otherwise(kind).alias("type"),
        F.floor("value").alias("quantity"),
    )
    return _errors(Q.apply_rules(rows, Q.stock_movement_rules()), "id").drop("message")


# The messages are fixed values.
_SALE_RULES = """SELECT s.request_id, concat_ws(';', CASE WHEN n = 0 THEN 'items=La venta debe incluir al menos un producto' END,
        CASE WHEN fault IS NOT NULL THEN 'items=El item ' || fault || CASE WHEN nameless THEN ' debe tener product_id' ELSE ' debe tener cantidad mayor a 0' END END,
        CASE WHEN split AND request_id % 12 = 0 THEN
            'payments=Cada pago debe tener método válido (cash, transfer, credit_card, current_account) y monto mayor a 0' END,
        CASE WHEN NOT split AND k NOT IN ('1', '2', '3', '4') THEN 'payment_method=El método de pago debe ser cash, transfer, credit_card o current_account' END,
        CASE WHEN CASE WHEN split THEN request_id % 8 = 0 ELSE k = '4' END AND coalesce(client_id, 0) = 0
            THEN 'client_id=Para venta a cuenta corriente es obligatorio indicar el cliente (client_id)' END) AS errors
    FROM (SELECT o_orderkey AS request_id, substr(o_orderpriority, 1, 1) AS k, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS client_id,
        o_orderkey % 4 = 0 AS split, coalesce(n, 0) AS n, fault, nameless FROM orders LEFT JOIN (
            SELECT request_id, count(*) AS n, min(no) FILTER (bad) AS fault, arg_min(product_id = 0, no) FILTER (bad) AS nameless FROM (
                SELECT request_id, product_id, product_id = 0 OR (product_id % 17 = 5 AND request_id % 3 = 0) AS bad,
                    row_number() OVER (PARTITION BY request_id ORDER BY product_id) AS no FROM sale_request_lines) GROUP BY request_id) l ON l.request_id = o_orderkey) s"""


def _faulty_requests(r: Roles):
    """Sale requests of which some have items without a quantity, and a quarter is paid in two parts, some of them wrong."""
    from molinete.registry.sales import sale_requests

    key = F.col("request_id")
    nothing = key % 3 == 0
    items = F.transform(
        "items",
        lambda i: F.struct(i["product_id"].alias("product_id"), F.when(nothing & (i["product_id"] % 17 == 5), F.lit(0)).otherwise(i["quantity"]).cast("decimal(12,3)").alias("quantity")),
    )
    pay = lambda method, amount: F.struct(method.alias("payment_method"), amount.cast("decimal(12,2)").alias("amount"))
    second = pay(F.when(key % 8 == 0, "current_account").otherwise("transfer"), F.when(key % 12 == 0, F.lit(0)).otherwise(F.lit(5)))
    parts = F.array(pay(F.lit("cash"), F.lit(10)), second)
    return sale_requests(r).withColumn("items", items).withColumn("payments", F.when(key % 4 == 0, parts).otherwise(F.col("payments")))


@query("validate_sales", _SALE_RULES)
def _(r: Roles):
    return _errors(Q.apply_rules(_faulty_requests(r), Q.sale_rules()), "request_id").drop("message")


@query(
    "validate_memberships",
    """SELECT o_orderkey AS request_id, concat_ws(';', CASE WHEN o_custkey = 0 THEN 'client_id=El ID del cliente es requerido' END,
        CASE WHEN o_orderkey % 200 = 0 THEN 'plan_id=El ID del plan es requerido' END,
        CASE WHEN k = '4' THEN 'payments=Cada pago debe tener método válido y monto mayor a 0' END,
        CASE WHEN k = '5' THEN 'payment_method=El método de pago debe ser ''cash'', ''transfer'', ''credit_card'' o ''current_account''' END,
        CASE WHEN o_orderkey % 23 = 0 THEN 'start_date=La fecha de inicio no es válida. Usá formato AAAA-MM-DD.' END) AS errors
    FROM (SELECT *, substr(o_orderpriority, 1, 1) AS k FROM orders JOIN part ON p_partkey = o_orderkey % 200)""",
)
def _(r: Roles):
    from molinete.registry.members import enrol_requests

    return _errors(Q.apply_rules(enrol_requests(r), Q.membership_rules()), "request_id").drop("message")


# --- streams: each must equal its batch twin -------------------------------------------


def _event_stream(r: Roles):
    return T.read_stream(r.spark, r.folder, r.raw("events").schema, name_filter="events.parquet")


class _Streamed(Roles):
    """The same roles with ``events`` arriving as a stream."""

    def raw(self, name: str):
        return _event_stream(Roles(self.spark, self.folder)) if name == "events" else super().raw(name)


@query(
    "stream_drawer_totals",
    """SELECT cash_session_id, count(*) AS movements_count,
        CAST(sum(CASE WHEN type IN ('income', 'membership_payment', 'sale') THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS total_income,
        CAST(sum(CASE WHEN type = 'expense' THEN amount ELSE 0 END) AS DECIMAL(38,2)) AS total_expenses
    FROM cash_movements GROUP BY cash_session_id""",
)
def _(r: Roles):
    moves = _Streamed(r.spark, r.folder).cash_movements
    return T.run_available(T.drawer_totals(moves), mode="update", keys=["cash_session_id"])


@query(
    "stream_tumbling_counts",
    """SELECT CAST(date_trunc('day', created_at) AS TIMESTAMP) AS window_start,
        CAST(date_trunc('day', created_at) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, count(*) AS count,
        CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM cash_movements GROUP BY ALL""",
)
def _(r: Roles):
    moves = _Streamed(r.spark, r.folder).cash_movements
    counts = T.tumbling_counts(moves, "created_at", "1 day", amount="amount")
    return T.run_available(counts, mode="update", keys=["window_start", "window_end"])


@query(
    "stream_balances",
    """SELECT client_id, CAST(sum(CASE WHEN type = 'debit' THEN amount ELSE -amount END) AS DECIMAL(38,2)) AS balance
    FROM ledger_moves GROUP BY client_id""",
)
def _(r: Roles):
    moves = _Streamed(r.spark, r.folder).ledger_moves
    return T.run_available(T.stream_balances(moves), mode="update", keys=["client_id"])


#: Swipes by arrival: three parts in order of time, then a tenth of all, which is late. Some are of clients that nobody knows.
_ARRIVED = """SELECT id, CASE WHEN id % 37 = 0 THEN -1 - client_id ELSE client_id END AS client_id, entered_at,
        CASE WHEN id % 10 = 0 THEN 4 ELSE 1 + 3 * (CAST(epoch(entered_at) AS BIGINT) - lo) // (hi - lo + 1) END AS arrival
    FROM client_entries, (SELECT CAST(epoch(min(entered_at)) AS BIGINT) AS lo, CAST(epoch(max(entered_at)) AS BIGINT) AS hi FROM client_entries)"""


def _arrived(r: Roles):
    swipes = r.client_entries.select("id", "client_id", "entered_at")
    sec = epoch_seconds("entered_at")
    span = swipes.agg(F.min(sec).alias("lo"), F.max(sec).alias("hi"))
    part = F.expr("1 + 3 * (sec - lo) div (hi - lo + 1)").cast("int")
    return swipes.withColumn("sec", sec).join(F.broadcast(span)).select(
        "id",
        F.when(F.col("id") % 37 == 0, -1 - F.col("client_id")).otherwise(F.col("client_id")).alias("client_id"),
        "entered_at",
        F.when(F.col("id") % 10 == 0, 4).otherwise(part).alias("arrival"),
    )


@query(
    "stream_entry_gate",
    f"""WITH RECURSIVE arrived AS ({_ARRIVED}),
    able AS (SELECT e.id, e.client_id, e.arrival, CAST(epoch(e.entered_at) AS BIGINT) AS sec, m.id AS membership_id FROM arrived e
        JOIN clients c ON c.id = e.client_id JOIN memberships m ON m.client_id = e.client_id AND m.status = 'active'
        AND m.start_date <= CAST(e.entered_at AS DATE) AND m.end_date >= CAST(e.entered_at AS DATE)
        QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY m.end_date DESC, m.id DESC) = 1),
    g AS (SELECT client_id, list(struct_pack(sec := sec, id := id) ORDER BY arrival, sec, id) AS rows FROM able GROUP BY client_id),
    walk AS (SELECT client_id, rows, 1 AS i, CAST(NULL AS BIGINT) AS before, rows[1].sec AS last, true AS ok FROM g
        UNION ALL SELECT client_id, rows, i + 1, last,
            CASE WHEN rows[i + 1].sec >= last + 1800 THEN rows[i + 1].sec ELSE last END, rows[i + 1].sec >= last + 1800
        FROM walk WHERE i < len(rows)),
    done AS (SELECT rows[i].id AS id, before, ok FROM walk)
    SELECT e.id, e.client_id, e.entered_at, a.membership_id, coalesce(d.ok, false) AS accepted,
        CASE WHEN d.ok THEN NULL WHEN d.id IS NOT NULL THEN 'cooldown' WHEN c.id IS NULL THEN 'client_not_found' ELSE 'no_active_membership' END AS reason,
        CASE WHEN NOT d.ok THEN make_timestamp((before + 1800) * 1000000) END AS next_allowed_at
    FROM arrived e LEFT JOIN able a ON a.id = e.id LEFT JOIN done d ON d.id = e.id LEFT JOIN clients c ON c.id = e.client_id""",
)
def _(r: Roles):
    """The gate over four arrivals, stopped after each and started again from its checkpoint; the last arrival is late."""
    base = f"{work_folder(r.spark)}/gate-{uuid.uuid4().hex}"
    arrived = durable(_arrived(r))
    store, fields = Store(r.spark, f"{base}/store"), ["id", "client_id", "entered_at"]
    for part in range(1, 5):
        arrived.filter(F.col("arrival") == part).select(fields).write.mode("append").parquet(f"{base}/swipes")
        swipes = T.read_stream(r.spark, f"{base}/swipes", arrived.select(fields).schema, files_per_trigger=100_000)
        T.gate_batches(swipes, r.clients, r.memberships, store, f"{base}/checkpoint").awaitTermination()
    return store.read("entries").select("id", "client_id", "entered_at", "membership_id", "accepted", "reason", "next_allowed_at")
