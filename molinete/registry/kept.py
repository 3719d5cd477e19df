"""Structures that are kept beside the tables: marks of running values, deep pages, a text index, daily sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from molinete.functions.scalars import signed_amount
from molinete.operators.deep_pages import seek_page
from molinete.operators.kept import advance_running, keep_running
from molinete.operators.sketches import ERROR, daily_sketches, distinct_over
from molinete.operators.trigrams import build_index, indexed_search
from molinete.registry.core import query
from molinete.sources.roles import Roles


@query(
    "kept_balances",
    """SELECT id, client_id, created_at, CAST(sum(CASE WHEN type = 'debit' THEN amount ELSE -amount END) OVER (
        PARTITION BY client_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM ledger_moves""",
)
def _(r: Roles):
    """Balances of all but a twentieth of the ledger, which comes late and back-dated; worked in, they equal those of a full pass."""
    moves = r.current_account.select("id", "client_id", "type", "amount", "created_at")
    late = F.col("id") % 20 == 3
    keys, order = ["client_id"], ["created_at", "id"]
    kept = keep_running(moves.filter(~late), keys, order, signed_amount(), "balance", every=100)
    step = advance_running(kept.values, kept.marks, moves.filter(late), keys, order, signed_amount(), "balance", every=100)
    same = kept.values.join(step.changed.select("id"), "id", "left_anti")
    return same.unionByName(step.changed).select("id", "client_id", "created_at", F.col("balance").cast("decimal(18,2)").alias("balance"))


@query(
    "deep_page",
    """SELECT id, client_id, entered_at, (SELECT count(*) FROM client_entries) AS total, (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM client_entries) AS total_pages
    FROM (SELECT * FROM client_entries ORDER BY entered_at DESC, id DESC LIMIT 10 OFFSET 990)""",
)
def _(r: Roles):
    found = seek_page(r.client_entries.select("id", "client_id", "entered_at"), ["entered_at", "id"], 100, 10)
    return found.rows.withColumns({"total": F.lit(found.total).cast("bigint"), "total_pages": F.lit(-(-found.total // 10)).cast("bigint")})


@query(
    "indexed_search",
    """SELECT 'r_d' AS term, id, name, code FROM products WHERE lower(name) LIKE '%r_d%' OR lower(code) LIKE '%r_d%'
    UNION ALL SELECT 'SMALL', id, name, code FROM products WHERE lower(name) LIKE '%small%' OR lower(code) LIKE '%small%'
    UNION ALL SELECT 'p11', id, name, code FROM products WHERE lower(name) LIKE '%p11%' OR lower(code) LIKE '%p11%'
    UNION ALL SELECT 'hot%ge', id, name, code FROM products WHERE lower(name) LIKE '%hot%ge%' OR lower(code) LIKE '%hot%ge%'""",
)
def _(r: Roles):
    products = r.products.select("id", "name", "code")
    index = build_index(products, "id", ["name", "code"])
    out = None
    for term in ("r_d", "SMALL", "p11", "hot%ge"):
        rows = indexed_search(index, products, term).select(F.lit(term).alias("term"), "id", "name", "code")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "distinct_clients_by_month",
    """SELECT CAST(date_trunc('month', entered_at) AS DATE) AS period, count(DISTINCT client_id) AS exact, count(*) AS n, true AS within_bound
    FROM client_entries GROUP BY ALL""",
)
def _(r: Roles):
    """Estimates from daily sketches, held against the exact counts."""
    entries = r.client_entries.select("client_id", "entered_at")
    month = F.date_trunc("month", "day").cast("date")
    estimates = distinct_over(daily_sketches(entries, "entered_at", "client_id"), month)
    exact = entries.groupBy(F.date_trunc("month", "entered_at").cast("date").alias("period")).agg(F.countDistinct("client_id").alias("exact"))
    within = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), F.lit(ERROR) * F.col("exact"))
    return estimates.join(exact, "period").select("period", "exact", "n", within.alias("within_bound"))
