"""Sales: lists, documents, posting and cancelling in bulk (QRY-26/27, JOB-1/2, V-17)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import enum_filter, in_period
from molinete.functions.scalars import Money, at_least_zero, blank_to_null, line_subtotal, money, payment_label, posted_id
from molinete.operators.admission import admit
from molinete.operators.rows import Details, apply_updates, enrich, nest, paginate
from molinete.operators.running import HOT_ROWS, row_numbers, size_probe
from molinete.plans.cash import open_session
from molinete.plans.ledger import post_to_ledger, with_keys
from molinete.schema import DRAWER_METHODS, HEADER_METHODS, PAYMENT_METHODS, SALE_STATUSES
from molinete.session import durable

Day = date | str | None
TOTAL = "decimal(38,2)"
CENT = "0.01"
ITEM_FIELDS = ("line_no", "product_id", "product_name", "product_code", "quantity", "unit", "unit_price", "subtotal")
PAYMENT_FIELDS = ("payment_method", "amount")


def list_sales(
    sales: DataFrame,
    users: DataFrame,
    clients: DataFrame,
    *,
    date_from: Day = None,
    date_to: Day = None,
    payment_method: str | None = None,
    status: str | None = None,
    page: int | None = 1,
    limit: int | None = 10,
) -> DataFrame:
    """Newest first; names are looked up for the page alone."""
    rows = in_period(sales, "created_at", date_from, date_to)
    rows = enum_filter(rows, "payment_method", payment_method, HEADER_METHODS)
    rows = enum_filter(rows, "status", status, SALE_STATUSES)
    newest = [F.desc("created_at"), F.desc("id")]
    if page is not None and limit is not None:
        rows = paginate(rows, newest, page, limit)
    rows = enrich(rows, users, "user_id", {"name": "user_name"})
    return enrich(rows, clients, "client_id", {"name": "client_name"}).orderBy(*newest)


def sale_documents(
    sales: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    users: DataFrame,
    clients: DataFrame,
    *,
    item_order: tuple[str, ...] = ("line_no", "product_id", "quantity", "subtotal"),
    payment_order: tuple[str, ...] = ("payment_method", "amount"),
    part: int = 10_000,
) -> DataFrame:
    """Each sale by ``part`` with its items and payments as arrays of at most ``part`` entries."""
    header = enrich(sales, users, "user_id", {"name": "user_name"})
    header = enrich(header, clients, "client_id", {"name": "client_name"})
    details = {"items": Details(items, item_order, ITEM_FIELDS), "payments": Details(payments, payment_order, PAYMENT_FIELDS)}
    return nest(header, "sale_id", details, items=part)


def _usable_payments() -> Column:
    return F.filter(
        F.transform(
            "payments",
            lambda p: F.struct(F.trim(p["payment_method"]).alias("payment_method"), money(p["amount"]).alias("amount")),
        ),
        lambda p: p["payment_method"].isin(*PAYMENT_METHODS) & (p["amount"] > 0),
    )


def price_lines(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Request lines with the product's name, code, unit and price as of the sale.

    Lines without a product or a positive quantity are passed over; a product that is
    unknown or inactive stays in with a NULL ``product_name``.
    """
    lines = requests.select("request_id", F.posexplode("items").alias("_pos", "_item")).select(
        "request_id",
        (F.col("_pos") + 1).alias("line_no"),
        F.col("_item.product_id").alias("product_id"),
        F.col("_item.quantity").try_cast("decimal(12,3)").alias("quantity"),
    )
    product = products.filter("active").select(
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        F.col("code").alias("product_code"),
        "unit",
        F.col("sale_price").cast(Money).alias("unit_price"),
    )
    return (
        lines.filter("product_id IS NOT NULL AND product_id <> 0 AND quantity > 0")
        .join(product, "product_id", "left")
        .withColumn("subtotal", line_subtotal("unit_price", "quantity"))
    )


def judge_sales(
    requests: DataFrame,
    lines: DataFrame,
    clients: DataFrame,
    products: DataFrame,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Requests without their lists, but with total, payments and ``reason`` (NULL = accepted)."""
    sums = lines.groupBy("request_id").agg(
        F.sum("subtotal").cast(TOTAL).alias("_subtotal"),
        F.bool_or(F.col("product_name").isNull()).alias("_unknown"),
    )
    asked = F.size(F.filter(F.coalesce("items", F.array().cast(requests.schema["items"].dataType)), lambda i: F.coalesce(i["product_id"], F.lit(0)) != 0))
    off = at_least_zero(F.coalesce(F.col("discount").cast(Money), F.lit(0).cast(Money)))
    client = clients.filter("active").select(F.col("id").alias("_client"), F.lit(True).alias("_client_active"))
    split = F.size(F.coalesce("payments", F.array().cast(requests.schema["payments"].dataType))) > 0
    zero = F.lit(0).cast(TOTAL)
    rows = (
        requests.join(sums, "request_id", "left")
        .join(client, F.col("client_id") == F.col("_client"), "left")
        .withColumn("subtotal", F.coalesce("_subtotal", zero))
        .withColumn("discount_amount", off)
        .withColumn("total", (F.col("subtotal") - F.col("discount_amount")).cast(TOTAL))
        .withColumn("_split", split)
        .withColumn(
            "paid_with",
            F.when(F.col("_split"), _usable_payments()).when(
                F.col("payment_method").isin(*PAYMENT_METHODS),
                F.array(F.struct(F.col("payment_method").alias("payment_method"), F.col("total").cast(Money).alias("amount"))),
            ),
        )
        .withColumn("methods", F.transform("paid_with", lambda p: p["payment_method"]))
    )
    paid = F.aggregate("paid_with", zero, lambda s, p: (s + p["amount"]).cast(TOTAL))
    on_account = F.array_contains("methods", "current_account")
    before_stock = F.when(asked == 0, "no_items").when(F.coalesce("_unknown", F.lit(False)), "product_not_found")
    after_stock = (
        F.when(F.col("_split") & ((F.size("paid_with") == 0) | (F.abs(paid - F.col("total")) > F.lit(CENT).cast(Money))), "payments_do_not_sum")
        .when(F.col("paid_with").isNull(), "invalid_payment_method")
        .when(on_account & F.col("client_id").isNull(), "client_required")
        .when(on_account & F.col("_client_active").isNull(), "client_not_found")
    )
    rows = durable(
        rows.withColumn("_before", before_stock)
        .withColumn("_after", after_stock)
        .drop("_client", "_client_active", "_unknown", "_subtotal", "_split", "items", "payments")
    )
    # A request with a fault found after the stock check still meets that check, but takes nothing.
    takers = rows.filter("_before IS NULL").select("request_id", "requested_at", F.col("_after").isNotNull().alias("dry"))
    demand = (
        lines.groupBy("request_id", F.col("product_id").alias("item_id"))
        .agg((-F.sum("quantity")).alias("delta"))
        .join(takers, "request_id")
        .withColumn("guarded", F.lit(True))
    )
    verdicts = admit(demand, products.filter("active").select(F.col("id").alias("item_id"), "stock"), hot_rows=hot_rows)
    short = F.when(~F.coalesce("accepted", F.lit(True)), "insufficient_stock")
    return (
        rows.join(verdicts, "request_id", "left")
        .withColumn("reason", F.coalesce("_before", short, "_after"))
        .drop("_before", "_after", "accepted")
    )


def post_sales(
    requests: DataFrame,
    products: DataFrame,
    clients: DataFrame,
    sessions: DataFrame,
    ledger: DataFrame | None = None,
    *,
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Post sales from a request table; each is taken whole or rejected with a reason.

    ``requests``: ``request_id, requested_at, user_id, client_id, items array<struct<product_id, quantity>>,
    payment_method, payments array<struct<payment_method, amount>>, discount, notes``.
    The request id is the sale's key; its children have keys from it and their line (:func:`posted_id`), and payments and the sale
    itself name their drawer movement. A request with several faults is rejected for the first of: items, products, stock, payments, client.
    """
    lines = durable(price_lines(requests, products))  # read for sums, demand, items and stock
    judged = durable(judge_sales(requests, lines, clients, products, hot_rows=hot_rows))  # read for every table that is posted
    drawer = open_session(sessions).select("id").scalar()
    accepted = judged.filter("reason IS NULL").withColumn("cash_session_id", drawer)
    label = F.concat(F.lit("Venta #"), F.col("request_id").cast("string"))
    in_drawer = (
        F.col("payment_method").isin(*DRAWER_METHODS) & F.col("cash_session_id").isNotNull() & (F.col("amount") > 0)
    )
    line_id = posted_id("sale", "request_id", "line_no")
    drawer_line = F.array_position(F.transform("paid_with", lambda p: p["payment_method"].isin(*DRAWER_METHODS) & (p["amount"] > 0)), True)
    sales = accepted.select(
        F.col("request_id").alias("id"),
        "user_id",
        "client_id",
        "cash_session_id",
        F.when((drawer_line > 0) & F.col("cash_session_id").isNotNull(), posted_id("sale", "request_id", drawer_line)).alias("cash_movement_id"),
        payment_label(F.col("methods")).alias("payment_method"),
        "subtotal",
        F.col("discount_amount").alias("discount"),
        "total",
        F.lit("completed").alias("status"),
        blank_to_null("notes").alias("notes"),
        F.col("requested_at").alias("created_at"),
    )
    sold = lines.join(accepted.select("request_id", "user_id", "requested_at"), "request_id")
    items = sold.select(line_id.alias("id"), F.col("request_id").alias("sale_id"), *ITEM_FIELDS)
    stock_rows = sold.select(
        line_id.alias("id"),
        "product_id",
        F.lit("salida").alias("type"),
        (-F.col("quantity")).cast("decimal(12,3)").alias("quantity"),
        label.alias("notes"),
        F.col("user_id").alias("created_by"),
        F.col("requested_at").alias("created_at"),
        F.col("request_id").alias("source_id"),
        "line_no",
    )
    paid = (
        accepted.select(
            "request_id",
            "user_id",
            "client_id",
            "cash_session_id",
            "requested_at",
            F.posexplode("paid_with").alias("_pos", "_payment"),
        )
        .select("*", (F.col("_pos") + 1).alias("line_no"), "_payment.*")
        .drop("_pos", "_payment")
    )
    payments = paid.select(
        line_id.alias("id"),
        F.col("request_id").alias("sale_id"),
        "line_no",
        "payment_method",
        "amount",
        F.when(in_drawer, line_id).alias("cash_movement_id"),
        in_drawer.alias("in_drawer"),
    )
    movements = paid.filter(in_drawer).select(
        line_id.alias("id"),
        F.col("request_id").alias("source_id"),
        "line_no",
        "cash_session_id",
        F.lit("sale").alias("type"),
        "payment_method",
        "amount",
        label.alias("description"),
        F.col("user_id").alias("created_by"),
        F.col("requested_at").alias("created_at"),
    )
    debits = paid.filter("payment_method = 'current_account' AND client_id IS NOT NULL AND amount > 0").select(
        F.col("request_id").alias("source_id"),
        "line_no",
        "client_id",
        F.lit("debit").alias("type"),
        "amount",
        label.alias("description"),
        F.col("user_id").alias("created_by"),
        F.col("requested_at").alias("created_at"),
    )
    sizes = size_probe(requests, ["client_id"], F.greatest(F.coalesce(F.size("payments"), F.lit(1)), F.lit(1)))
    return {
        "sales": sales,
        "sale_items": items,
        "sale_payments": payments,
        "stock_movements": stock_rows,
        "products": apply_stock(products, stock_rows),
        "cash_movements": movements,
        "current_account": with_keys(post_to_ledger(debits, ledger, hot_rows=hot_rows, sizes=sizes), "sale"),
        "rejected": judged.filter("reason IS NOT NULL").select("request_id", "reason"),
    }


def apply_stock(products: DataFrame, movements: DataFrame) -> DataFrame:
    """New product snapshot: stock plus the signed movements."""
    moved = movements.groupBy(F.col("product_id").alias("_product")).agg(F.sum("quantity").alias("_moved"))
    stock = (F.col("stock") + F.coalesce("_moved", F.lit(0))).cast("decimal(18,3)")
    return (
        products.join(moved, F.col("id") == F.col("_product"), "left").withColumn("stock", stock).drop("_product", "_moved")
    )


def cancel_sales(
    requests: DataFrame,
    sales: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    movements: DataFrame,
    sessions: DataFrame,
    ledger: DataFrame | None = None,
    products: DataFrame | None = None,
    *,
    hot_rows: int = HOT_ROWS,
) -> dict[str, DataFrame]:
    """Cancel sales of the open session: stock comes back (``products`` gives the new snapshot), drawer and account payments are reversed.

    ``requests``: ``request_id, requested_at, sale_id, created_by``; of several for one sale the first counts.
    Sales without payment rows use their own header.
    """
    session = open_session(sessions).select("id").scalar()
    state = sales.select(
        F.col("id").alias("sale_id"),
        "client_id",
        "cash_session_id",
        F.col("cash_movement_id").alias("header_movement"),
        F.col("payment_method").alias("header_method"),
        F.col("total").alias("header_total"),
        "status",
    )
    firsts = requests.groupBy("sale_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_first"))
    judged = (
        requests.join(firsts, "sale_id")
        .join(state, "sale_id", "left")
        .withColumn("_open", session)
        .withColumn(
            "reason",
            F.when(F.col("status").isNull(), "sale_not_found")
            .when(F.col("status") == "cancelled", "sale_already_cancelled")
            .when(F.col("_open").isNull(), "no_open_session")
            .when(~F.col("cash_session_id").eqNullSafe(F.col("_open")), "session_closed")
            .when(F.col("request_id") != F.col("_first.request_id"), "sale_already_cancelled"),
        )
        .drop("_first", "_open")
    )
    accepted = judged.filter("reason IS NULL")
    label = F.concat(F.lit("Cancelación venta #"), F.col("sale_id").cast("string"))
    # A sale's rows in the order of their keys, or of their values where they have none, number what is reversed.
    returned = items.select("sale_id", "product_id", "quantity", *[c for c in ("id",) if c in items.columns]).join(accepted, "sale_id")
    returned = row_numbers(returned, ["sale_id"], [c for c in ("id", "product_id", "quantity") if c in returned.columns], "line_no", hot_rows=hot_rows)
    back = returned.select(
        posted_id("sale_cancellation", "sale_id", "line_no").alias("id"),
        "product_id",
        F.lit("entrada").alias("type"),
        "quantity",
        label.alias("notes"),
        "created_by",
        F.col("requested_at").alias("created_at"),
        F.col("sale_id").alias("source_id"),
    )
    detail = payments.select("sale_id", "payment_method", "amount", "cash_movement_id")
    columns = [
        "request_id",
        "requested_at",
        "sale_id",
        "client_id",
        "cash_session_id",
        "payment_method",
        "amount",
        "cash_movement_id",
        "created_by",
    ]
    from_rows = accepted.join(detail, "sale_id").select(*columns)
    from_header = (
        accepted.join(detail.select("sale_id"), "sale_id", "left_anti")
        .withColumn("payment_method", F.col("header_method"))
        .withColumn("amount", F.col("header_total"))
        .withColumn("cash_movement_id", F.col("header_movement"))
        .select(*columns)
    )
    paid = from_rows.unionByName(from_header)
    moved = movements.select(
        F.col("id").alias("_movement"),
        F.col("amount").alias("moved_amount"),
        F.coalesce("payment_method", F.lit("cash")).alias("moved_method"),
    )
    paid = row_numbers(paid, ["sale_id"], ["amount", "payment_method", "cash_movement_id"], "line_no", hot_rows=hot_rows)
    line_id = posted_id("sale_cancellation", "sale_id", "line_no")
    given_back = paid.join(moved, F.col("cash_movement_id") == F.col("_movement")).select(
        line_id.alias("id"),
        "sale_id",
        "cash_session_id",
        F.lit("expense").alias("type"),
        F.col("moved_method").alias("payment_method"),
        F.col("moved_amount").alias("amount"),
        label.alias("description"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    credits = paid.filter("payment_method = 'current_account' AND client_id IS NOT NULL AND amount > 0").select(
        F.col("request_id").alias("source_id"),
        "line_no",
        "sale_id",
        line_id.alias("id"),
        "client_id",
        F.lit("credit").alias("type"),
        "amount",
        label.alias("description"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    return {
        **({} if products is None else {"products": apply_stock(products, back)}),
        "cancelled": accepted.select("sale_id"),
        "stock_movements": back,
        "cash_movements": given_back,
        "current_account": post_to_ledger(credits, ledger, hot_rows=hot_rows),
        "rejected": judged.filter("reason IS NOT NULL").select("request_id", "reason"),
    }


def apply_cancellations(sales: DataFrame, cancelled: DataFrame) -> DataFrame:
    """New sales snapshot after :func:`cancel_sales`."""
    return apply_updates(
        sales, cancelled.select(F.col("sale_id").alias("id"), F.lit("cancelled").alias("status")), ["id"]
    )


def sale_audit(sales: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Sales whose items, discount or payments do not add up (payments within a cent)."""
    of_items = items.groupBy("sale_id").agg(F.sum("subtotal").cast(TOTAL).alias("items_total"))
    of_payments = payments.groupBy(F.col("sale_id").alias("_paid")).agg(F.sum("amount").cast(TOTAL).alias("paid_total"))
    zero = F.lit(0).cast(TOTAL)
    checked = (
        sales.select("id", "subtotal", "discount", "total")
        .join(of_items, F.col("id") == F.col("sale_id"), "left")
        .join(of_payments, F.col("id") == F.col("_paid"), "left")
        .withColumns({"items_total": F.coalesce("items_total", zero), "paid_total": F.coalesce("paid_total", zero)})
        .withColumn("items_ok", F.col("items_total") == F.col("subtotal"))
        .withColumn("total_ok", F.col("subtotal") - F.col("discount") == F.col("total"))
        .withColumn("payments_ok", F.abs(F.col("paid_total") - F.col("total")) <= F.lit(CENT).cast(Money))
    )
    return checked.filter("NOT (items_ok AND total_ok AND payments_ok)").select(
        "id", "subtotal", "items_total", "total", "paid_total", "items_ok", "total_ok", "payments_ok"
    )
