"""Products and stock (QRY-28 .. 31, JOB-12/14, WIN-6, V-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molinete.functions.predicates import by_keys, enum_filter, opt_filter, text_search, visible
from molinete.functions.scalars import blank_to_null, non_negative_or_zero, product_code
from molinete.operators.admission import admit
from molinete.operators.rows import enrich, paginate
from molinete.operators.unique import last_requested, settle_claims
from molinete.operators.running import HOT_ROWS, Running, running
from molinete.plans.sales import apply_stock
from molinete.schema import STOCK_TYPES, UNITS

QUANTITY = "decimal(18,3)"
NEAR_FACTOR = "1.2"
ALERTS = ("out", "low", "near")


def list_products(products: DataFrame, *, search: str | None = None, category: str | None = None) -> DataFrame:
    """Active products by name."""
    wanted = (category or "").strip() or None
    rows = opt_filter(text_search(visible(products), ("name", "code", "description"), search), category=wanted)
    return rows.orderBy("name", "id")


def alert_type() -> Column:
    """``out``: nothing left; ``low``: under the minimum; ``near``: under 1.2 times the minimum; else NULL."""
    stock, least = F.col("stock"), F.coalesce("min_stock", F.lit(0))
    return (
        F.when(stock <= 0, "out")
        .when((least > 0) & (stock < least), "low")
        .when((least > 0) & (stock < least * F.lit(NEAR_FACTOR).cast("decimal(2,1)")), "near")
    )


def stock_alerts(
    products: DataFrame, *, search: str | None = None, category: str | None = None, kind: str | None = None
) -> DataFrame:
    """Active products needing attention; ``kind`` keeps one alert type (an unknown one is ignored)."""
    rows = list_products(products, search=search, category=category).withColumn("alert_type", alert_type())
    rows = rows.filter("alert_type IS NOT NULL")
    return enum_filter(rows, "alert_type", kind.lower() if kind else None, ALERTS)


def alert_counts(products: DataFrame, *, search: str | None = None, category: str | None = None) -> DataFrame:
    """One row: how many products are out, low and near."""
    rows = stock_alerts(products, search=search, category=category)
    return rows.agg(*[F.count_if(F.col("alert_type") == a).alias(a) for a in ALERTS])


def list_stock_movements(
    movements: DataFrame,
    products: DataFrame,
    users: DataFrame,
    *,
    search: str | None = None,
    type_: str | None = None,
    product_id: int | None = None,
    page: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Movements of active products, newest first."""
    rows = opt_filter(enum_filter(movements, "type", type_, STOCK_TYPES), product_id=product_id)
    shown = {"name": "product_name", "code": "product_code", "unit": "product_unit"}
    rows = enrich(rows, visible(products), "product_id", shown, how="inner")
    rows = text_search(rows, ("product_name", "product_code"), search)
    newest = [F.desc("created_at"), F.desc("source_id"), F.desc("product_id"), "quantity"]
    if page is not None and limit is not None:
        rows = paginate(rows, newest, page, limit)
    return enrich(rows, users, "created_by", {"name": "created_by_name"}).orderBy(*newest)


def product_movements(movements: DataFrame, users: DataFrame, ids: DataFrame) -> DataFrame:
    """Movements of the products in the one-column ``ids``."""
    return enrich(by_keys(movements, "product_id", ids), users, "created_by", {"name": "created_by_name"})


def running_stock(movements: DataFrame, opening: DataFrame | None = None, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Stock after each movement, per product in ``(created_at, source_id, quantity)`` order.

    ``opening``: ``product_id, opening_stock``; zero where it has no row.
    """
    # The opening comes last: the size probe and the order then concern the bare movements, and the join finds them dealt by product already.
    out = running(
        movements,
        ["product_id"],
        ["created_at", "source_id", "quantity"],
        {"_moved": Running("sum", F.col("quantity"))},
        hot_rows=hot_rows,
    )
    if opening is None:
        return out.withColumn("running_stock", F.col("_moved").cast(QUANTITY)).drop("_moved")
    level = (F.coalesce("opening_stock", F.lit(0)) + F.col("_moved")).cast(QUANTITY)
    return out.join(opening, "product_id", "left").withColumn("running_stock", level).drop("_moved", "opening_stock")


def post_stock_movements(
    requests: DataFrame, products: DataFrame, *, hot_rows: int = HOT_ROWS
) -> dict[str, DataFrame]:
    """Post receipts (``entrada``), issues (``salida``) and corrections (``ajuste``) in request order.

    ``requests``: ``request_id, requested_at, product_id, type, quantity, notes, created_by``. The sign
    of a receipt or an issue follows its type; an issue or a correction may not leave less than zero.
    """
    quantity = F.col("quantity").try_cast("decimal(12,3)")
    delta = (
        F.when(F.col("type") == "entrada", F.abs(quantity)).when(F.col("type") == "salida", -F.abs(quantity)).otherwise(quantity)
    )
    known = products.filter("active").select(F.col("id").alias("_product"))
    judged = (
        requests.withColumn("delta", delta)
        .join(known, F.col("product_id") == F.col("_product"), "left")
        .withColumn(
            "_reason",
            F.when(F.col("_product").isNull(), "product_not_found").when(
                F.col("delta").isNull() | (F.col("delta") == 0), "quantity_is_zero"
            ),
        )
        .drop("_product")
    )
    lines = judged.filter("_reason IS NULL").select(
        "request_id",
        "requested_at",
        F.col("product_id").alias("item_id"),
        "delta",
        F.col("type").isin("salida", "ajuste").alias("guarded"),
    )
    stock = products.filter("active").select(F.col("id").alias("item_id"), "stock")
    verdicts = admit(lines, stock, single_line=True, hot_rows=hot_rows)
    decided = judged.join(verdicts, "request_id", "left").withColumn(
        "reason", F.coalesce("_reason", F.when(~F.col("accepted"), "insufficient_stock"))
    )
    posted = decided.filter("reason IS NULL").select(
        F.col("request_id").alias("id"),
        "product_id",
        "type",
        F.col("delta").cast("decimal(12,3)").alias("quantity"),
        blank_to_null("notes").alias("notes"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    return {
        "stock_movements": posted,
        "products": apply_stock(products, posted),
        "rejected": decided.filter("reason IS NOT NULL").select("request_id", "reason"),
    }


def upsert_products(changes: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Create or update products. Stock changes only through movements; a new product's initial stock is one.

    ``changes``: ``id, requested_at, name, code, description, category, sale_price, cost_price, stock_inicial,
    min_stock, unit, created_by`` (text numbers allowed). Of several changes of an id the last requested counts, the others are rejected as
    ``superseded``. A code is taken if another product has it and no accepted earlier change gave it up, or if an accepted earlier change took it.
    """
    changes, superseded = last_requested(changes)
    clean = changes.select(
        "id",
        "requested_at",
        "created_by",
        F.coalesce(F.trim("name"), F.lit("")).alias("name"),
        F.coalesce(product_code("code"), F.lit("")).alias("code"),
        blank_to_null("description").alias("description"),
        blank_to_null("category").alias("category"),
        non_negative_or_zero("sale_price").alias("sale_price"),
        non_negative_or_zero("cost_price").alias("cost_price"),
        non_negative_or_zero("stock_inicial", "decimal(12,3)").alias("initial_stock"),
        non_negative_or_zero("min_stock", "decimal(12,3)").alias("min_stock"),
        F.when(F.col("unit") == UNITS[1], UNITS[1]).otherwise(UNITS[0]).alias("unit"),
    )
    claims = clean.select("id", "requested_at", F.lit(0).alias("place"), F.col("code").alias("key"))
    mine = clean.select(F.col("id").alias("_change"), "requested_at", F.col("code").alias("_now"))
    held = products.join(mine, F.col("id") == F.col("_change"), "left").select(
        "id",
        "requested_at",
        F.lit(0).alias("place"),
        F.upper(F.trim("code")).alias("key"),
        (F.col("_change").isNotNull() & (F.col("_now") != F.upper(F.trim("code")))).alias("moves"),
    )
    taken = settle_claims(claims, held.filter("key IS NOT NULL")).select(F.col("id").alias("_loser")).distinct()
    judged = clean.join(taken, F.col("id") == F.col("_loser"), "left").withColumn("reason", F.when(F.col("_loser").isNotNull(), "code_taken")).drop("_loser")
    good = judged.filter("reason IS NULL")
    old = products.select(
        "id", F.col("stock").alias("_stock"), F.col("active").alias("_active"), F.lit(True).alias("_exists")
    )
    merged = good.join(old, "id", "left")
    written = merged.select(
        "id",
        "name",
        "code",
        "description",
        "category",
        "sale_price",
        "cost_price",
        F.when(F.col("_exists"), F.col("_stock")).otherwise(F.col("initial_stock")).cast("decimal(12,3)").alias("stock"),
        "min_stock",
        "unit",
        F.coalesce("_active", F.lit(True)).alias("active"),
    )
    kept = products.join(good.select("id"), "id", "left_anti").select(*written.columns)
    first_stock = merged.filter("_exists IS NULL AND initial_stock > 0").select(
        F.col("id").alias("product_id"),
        F.lit("entrada").alias("type"),
        F.col("initial_stock").alias("quantity"),
        F.lit("Stock inicial").alias("notes"),
        "created_by",
        F.col("requested_at").alias("created_at"),
    )
    return {
        "products": kept.unionByName(written),
        "stock_movements": first_stock,
        "rejected": judged.filter("reason IS NOT NULL").select("id", "reason").unionByName(superseded),
    }


def stock_audit(products: DataFrame, movements: DataFrame) -> DataFrame:
    """Products whose stock is not the sum of their movements."""
    moved = movements.groupBy(F.col("product_id").alias("_product")).agg(F.sum("quantity").cast(QUANTITY).alias("moved"))
    return (
        products.select("id", "code", "stock")
        .join(moved, F.col("id") == F.col("_product"), "left")
        .withColumn("moved", F.coalesce("moved", F.lit(0).cast(QUANTITY)))
        .filter("stock <> moved")
        .select("id", "code", "stock", "moved")
    )
