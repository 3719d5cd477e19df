"""Membership, attendance and sales reports (QRY-1 .. QRY-14).

Facts are reduced to one row per key before a name is joined to them, so the
join sees as many rows as there are keys, not facts.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import in_period, is_active, opt_filter
from molinete.functions.scalars import day, half_up_ratio, month_label, months_before
from molinete.operators.rows import top_k

Day = date | str | None
TOTAL = "decimal(38,2)"
UNASSIGNED = "Sin asignar"


def rows_count() -> Column:
    return F.count(F.lit(1))


def revenue(column: str = "total") -> Column:
    return F.coalesce(F.sum(column).cast(TOTAL), F.lit(0).cast(TOTAL))


def _period_memberships(
    memberships: DataFrame, date_from: Day, date_to: Day, plan_id: int | None, instructor_id: int | None
) -> DataFrame:
    rows = in_period(memberships, "created_at", date_from, date_to)
    return opt_filter(rows, plan_id=plan_id, instructor_id=instructor_id)


def memberships_by_plan(
    memberships: DataFrame,
    plans: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    plan_id: int | None = None,
    instructor_id: int | None = None,
) -> DataFrame:
    counts = _period_memberships(memberships, date_from, date_to, plan_id, instructor_id).groupBy("plan_id").agg(
        rows_count().alias("count")
    )
    names = plans.select(F.col("id").alias("plan_id"), F.col("name").alias("plan_name"))
    return counts.join(names, "plan_id").select("plan_id", "plan_name", "count").orderBy(F.desc("count"), "plan_id")


def memberships_by_instructor(
    memberships: DataFrame,
    instructors: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    plan_id: int | None = None,
    instructor_id: int | None = None,
    include_null: bool = False,
) -> DataFrame:
    """Assigned memberships only, or with a bucket for those without an instructor."""
    counts = (
        _period_memberships(memberships, date_from, date_to, plan_id, instructor_id)
        .groupBy("instructor_id")
        .agg(rows_count().alias("count"))
    )
    names = instructors.select(F.col("id").alias("instructor_id"), F.col("name").alias("instructor_name"))
    if include_null:
        named = counts.join(names, "instructor_id", "left").withColumn(
            "instructor_name", F.coalesce("instructor_name", F.lit(UNASSIGNED))
        )
    else:
        named = counts.join(names, "instructor_id")
    return named.select("instructor_id", "instructor_name", "count").orderBy(F.desc("count"), "instructor_id")


def top_clients_by_entries(
    entries: DataFrame, clients: DataFrame, *, date_from: Day = None, date_to: Day = None, k: int | None = 100
) -> DataFrame:
    counts = in_period(entries, "entered_at", date_from, date_to).groupBy("client_id").agg(rows_count().alias("entries_count"))
    names = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    ranked = counts.join(names, "client_id").select("client_id", "client_name", "entries_count")
    if k is None:
        return ranked.orderBy(F.desc("entries_count"), "client_id")
    return top_k(ranked, "entries_count", "client_id", k)


def membership_summary(
    memberships: DataFrame,
    entries: DataFrame,
    clients: DataFrame,
    *,
    as_of: date | str,
    date_from: Day = None,
    date_to: Day = None,
    plan_id: int | None = None,
    instructor_id: int | None = None,
    cap: int | None = 100,
) -> DataFrame:
    """One row. The average divides by at most ``cap`` clients (the ranking's length); ``None`` is the true mean."""
    total = _period_memberships(memberships, date_from, date_to, plan_id, instructor_id).agg(rows_count().alias("n"))
    active = memberships.filter(is_active(as_of)).agg(rows_count().alias("n"))
    per_client = in_period(entries, "entered_at", date_from, date_to).groupBy("client_id").agg(rows_count().alias("n"))
    known = clients.select(F.col("id").alias("client_id"), F.lit(1).alias("_known"))
    counted = per_client.join(known, "client_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries_in_period"), F.count("_known").alias("_listed")
    )
    listed = F.col("_listed") if cap is None else F.least(F.col("_listed"), F.lit(cap).cast("bigint"))
    return counted.select(
        total.scalar().alias("total_memberships_in_period"),
        active.scalar().alias("active_memberships_total"),
        "total_entries_in_period",
        half_up_ratio(F.col("total_entries_in_period"), listed).alias("avg_entries_per_client"),
    )


def monthly(df: DataFrame, ts: str, *, as_of: date | str, months: int = 12, **aggs: Column) -> DataFrame:
    """Per calendar month over the trailing ``months``; up to ``months + 1`` labels, empty months absent."""
    recent = df.filter(
        (F.col(ts) >= months_before(as_of, months).cast("timestamp_ntz"))
        & (F.col(ts) < F.date_add(day(as_of), 1).cast("timestamp_ntz"))
    )
    measures = aggs or {"count": rows_count()}
    return recent.groupBy(month_label(ts).alias("month")).agg(*[a.alias(n) for n, a in measures.items()]).orderBy("month")


def memberships_per_month(memberships: DataFrame, *, as_of: date | str) -> DataFrame:
    return monthly(memberships, "created_at", as_of=as_of)


def entries_per_month(entries: DataFrame, *, as_of: date | str) -> DataFrame:
    return monthly(entries, "entered_at", as_of=as_of)


def memberships_by_status(
    memberships: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    plan_id: int | None = None,
    instructor_id: int | None = None,
) -> DataFrame:
    rows = _period_memberships(memberships, date_from, date_to, plan_id, instructor_id)
    return rows.groupBy("status").agg(rows_count().alias("count")).orderBy(F.desc("count"), "status")


def _period_sales(
    sales: DataFrame, date_from: Day, date_to: Day, payment_method: str | None, status: str | None
) -> DataFrame:
    rows = in_period(sales, "created_at", date_from, date_to)
    return opt_filter(rows, status=status, payment_method=payment_method)


def top_products(
    items: DataFrame,
    sales: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    payment_method: str | None = None,
    status: str | None = "completed",
    k: int = 100,
) -> DataFrame:
    """By quantity sold; grouped on the line's own name and code, so a renamed product is listed twice.

    Lines are first reduced per (sale, product) in the partitioning the join
    leaves them in; that makes the distinct sale count a plain count and costs
    one small shuffle instead of one of every line.
    """
    wanted = _period_sales(sales, date_from, date_to, payment_method, status).select(F.col("id").alias("sale_id"))
    product = ["product_id", "product_name", "product_code"]
    per_sale = (
        items.join(wanted, "sale_id")
        .groupBy("sale_id", *product)
        .agg(F.sum("quantity").alias("q"), F.sum("subtotal").alias("r"))
    )
    totals = per_sale.groupBy(*product).agg(
        F.sum("q").cast("decimal(38,3)").alias("total_quantity"),
        F.sum("r").cast(TOTAL).alias("total_revenue"),
        rows_count().alias("sales_count"),
    )
    return totals.orderBy(F.desc("total_quantity"), *product).limit(k)


def sales_by_payment_method(
    sales: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    payment_method: str | None = None,
    status: str | None = "completed",
) -> DataFrame:
    rows = _period_sales(sales, date_from, date_to, payment_method, status)
    return (
        rows.groupBy("payment_method")
        .agg(rows_count().alias("count"), revenue().alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "payment_method")
    )


def top_clients_by_spend(
    sales: DataFrame,
    clients: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    payment_method: str | None = None,
    status: str | None = "completed",
    k: int = 100,
) -> DataFrame:
    """Sales without a client are left out."""
    spent = (
        _period_sales(sales, date_from, date_to, payment_method, status)
        .filter(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(rows_count().alias("sales_count"), revenue().alias("total_revenue"))
    )
    names = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    ranked = spent.join(names, "client_id").select("client_id", "client_name", "sales_count", "total_revenue")
    return top_k(ranked, "total_revenue", "client_id", k)


def sales_summary(
    sales: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    payment_method: str | None = None,
    status: str | None = "completed",
) -> DataFrame:
    """One row, zeros when nothing matches."""
    return _period_sales(sales, date_from, date_to, payment_method, status).agg(
        rows_count().alias("total_sales"), revenue().alias("total_revenue"), revenue("discount").alias("total_discount")
    )


def sales_by_status(sales: DataFrame, *, date_from: Day = None, date_to: Day = None) -> DataFrame:
    """Date filters only; status and method filters do not apply here."""
    rows = in_period(sales, "created_at", date_from, date_to)
    return (
        rows.groupBy("status")
        .agg(rows_count().alias("count"), revenue().alias("total_revenue"))
        .orderBy(F.desc("count"), "status")
    )


def sales_per_month(sales: DataFrame, *, as_of: date | str) -> DataFrame:
    completed = sales.filter("status = 'completed'")
    return monthly(completed, "created_at", as_of=as_of, count=rows_count(), revenue=revenue())
