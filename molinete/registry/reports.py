"""Report queries (QRY-1 .. QRY-14)."""

from __future__ import annotations

from molinete.plans import reports as R
from molinete.registry.core import query
from molinete.registry.roles_sql import AS_OF as D
from molinete.sources.roles import AS_OF, Roles

FROM, TO = "1996-01-01", "2000-06-30"
_IN = "created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-07-01'"
_ENTRY_IN = "entered_at >= TIMESTAMP '2001-06-02' AND entered_at < TIMESTAMP '2001-06-26'"


@query(
    "memberships_by_plan",
    f"""SELECT p.id AS plan_id, p.name AS plan_name, count(*) AS count FROM memberships m JOIN plans p ON p.id = m.plan_id
    WHERE m.{_IN.replace('AND ', 'AND m.')} GROUP BY p.id, p.name""",
)
def _(r: Roles):
    return R.memberships_by_plan(r.memberships, r.plans, date_from=FROM, date_to=TO)


@query(
    "memberships_by_instructor",
    """SELECT i.id AS instructor_id, i.name AS instructor_name, count(*) AS count
    FROM memberships m JOIN instructors i ON i.id = m.instructor_id GROUP BY ALL""",
)
def _(r: Roles):
    return R.memberships_by_instructor(r.memberships, r.instructors)


@query(
    "memberships_by_instructor_with_null",
    f"""SELECT m.instructor_id, coalesce(i.name, 'Sin asignar') AS instructor_name, count(*) AS count
    FROM memberships m LEFT JOIN instructors i ON i.id = m.instructor_id
    WHERE m.{_IN.replace('AND ', 'AND m.')} GROUP BY ALL""",
)
def _(r: Roles):
    return R.memberships_by_instructor(r.memberships, r.instructors, date_from=FROM, date_to=TO, include_null=True)


@query(
    "top_clients_by_entries",
    f"""SELECT c.id AS client_id, c.name AS client_name, count(*) AS entries_count
    FROM client_entries e JOIN clients c ON c.id = e.client_id WHERE {_ENTRY_IN}
    GROUP BY ALL ORDER BY entries_count DESC, client_id LIMIT 100""",
)
def _(r: Roles):
    return R.top_clients_by_entries(r.client_entries, r.clients, date_from="2001-06-02", date_to="2001-06-25")


_SUMMARY = """WITH e AS (SELECT client_id, count(*) AS n FROM client_entries GROUP BY client_id),
    t AS (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM e) AS total,
          (SELECT {count} FROM e JOIN clients c ON c.id = e.client_id) AS n)
    SELECT (SELECT count(*) FROM memberships) AS total_memberships_in_period,
        (SELECT count(*) FROM memberships WHERE status = 'active' AND start_date <= {d} AND end_date >= {d})
            AS active_memberships_total,
        total AS total_entries_in_period,
        CAST(((20 * total + n) // (2 * n)) / 10.0 AS DECIMAL(18,1)) AS avg_entries_per_client FROM t"""


@query("membership_summary", _SUMMARY.format(count="least(count(*), 100)", d=D))
def _(r: Roles):
    return R.membership_summary(r.memberships, r.client_entries, r.clients, as_of=AS_OF)


@query("membership_summary_true_mean", _SUMMARY.format(count="count(*)", d=D))
def _(r: Roles):
    return R.membership_summary(r.memberships, r.client_entries, r.clients, as_of=AS_OF, cap=None)


_TRAILING = "{ts} >= CAST({d} - INTERVAL 12 MONTH AS TIMESTAMP) AND {ts} < CAST({d} + 1 AS TIMESTAMP)"


@query(
    "memberships_per_month",
    f"""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS count FROM memberships
    WHERE {_TRAILING.format(ts='created_at', d=D)} GROUP BY 1""",
)
def _(r: Roles):
    return R.memberships_per_month(r.memberships, as_of=AS_OF)


@query(
    "entries_per_month",
    f"""SELECT strftime(entered_at, '%Y-%m') AS month, count(*) AS count FROM client_entries
    WHERE {_TRAILING.format(ts='entered_at', d=D)} GROUP BY 1""",
)
def _(r: Roles):
    return R.entries_per_month(r.client_entries, as_of=AS_OF)


@query(
    "memberships_by_status",
    f"SELECT status, count(*) AS count FROM memberships WHERE {_IN} AND plan_id = 17 GROUP BY status",
)
def _(r: Roles):
    return R.memberships_by_status(r.memberships, date_from=FROM, date_to=TO, plan_id=17)


@query(
    "top_products",
    f"""SELECT i.product_id, i.product_name, i.product_code, CAST(sum(i.quantity) AS DECIMAL(38,3)) AS total_quantity,
        CAST(sum(i.subtotal) AS DECIMAL(38,2)) AS total_revenue, count(DISTINCT s.id) AS sales_count
    FROM sale_items i JOIN sales s ON s.id = i.sale_id
    WHERE s.status = 'completed' AND s.{_IN.replace('AND ', 'AND s.')} GROUP BY ALL
    ORDER BY total_quantity DESC, product_id, product_name, product_code LIMIT 100""",
)
def top_products(r: Roles):
    return R.top_products(r.sale_items, r.sales, date_from=FROM, date_to=TO)


@query(
    "sales_by_payment_method",
    f"""SELECT payment_method, count(*) AS count, CAST(sum(total) AS DECIMAL(38,2)) AS total_revenue FROM sales
    WHERE status = 'completed' AND {_IN} GROUP BY payment_method""",
)
def _(r: Roles):
    return R.sales_by_payment_method(r.sales, date_from=FROM, date_to=TO)


@query(
    "top_clients_by_spend",
    """SELECT c.id AS client_id, c.name AS client_name, count(*) AS sales_count,
        CAST(sum(s.total) AS DECIMAL(38,2)) AS total_revenue FROM sales s JOIN clients c ON c.id = s.client_id
    WHERE s.status = 'completed' GROUP BY ALL ORDER BY total_revenue DESC, client_id LIMIT 100""",
)
def _(r: Roles):
    return R.top_clients_by_spend(r.sales, r.clients)


@query(
    "sales_summary",
    f"""SELECT count(*) AS total_sales, CAST(coalesce(sum(total), 0) AS DECIMAL(38,2)) AS total_revenue,
        CAST(coalesce(sum(discount), 0) AS DECIMAL(38,2)) AS total_discount FROM sales
    WHERE status = 'completed' AND payment_method = 'cash' AND {_IN}""",
)
def _(r: Roles):
    return R.sales_summary(r.sales, date_from=FROM, date_to=TO, payment_method="cash")


@query(
    "sales_by_status",
    f"""SELECT status, count(*) AS count, CAST(sum(total) AS DECIMAL(38,2)) AS total_revenue FROM sales
    WHERE {_IN} GROUP BY status""",
)
def _(r: Roles):
    return R.sales_by_status(r.sales, date_from=FROM, date_to=TO)


@query(
    "sales_per_month",
    f"""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS count, CAST(sum(total) AS DECIMAL(38,2)) AS revenue
    FROM sales WHERE status = 'completed' AND {_TRAILING.format(ts='created_at', d=D)} GROUP BY 1""",
)
def _(r: Roles):
    return R.sales_per_month(r.sales, as_of=AS_OF)
