"""Business tables derived from the supplied star-schema tables.

Each role is a lazy DataFrame; nothing is read until a query uses it, and then
only the columns and rows that query needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molinete.functions.scalars import expense, income, money, signed_amount
from molinete.operators.running import Running, running

# The columns of the supplied tables, declared so that no scan starts with a job to infer them.
SUPPLIED = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

AS_OF = "2001-06-15"
FIRST_EVENT_DAY = "2024-01-01"
ENTRY_SHIFT_DAYS = 8250
PLAN_COUNT = 200
SESSION_COUNT = 30


def _method(priority: Column) -> Column:
    """Five order priorities, five payment methods."""
    digit = F.substring(priority, 1, 1)
    return (
        F.when(digit == "1", "cash")
        .when(digit == "2", "transfer")
        .when(digit == "3", "credit_card")
        .when(digit == "4", "current_account")
        .otherwise("combined")
    )


def _digits(key: str, width: int) -> Column:
    return F.lpad(F.col(key).cast("string"), width, "0")


def split_payments(headers: DataFrame, key: str) -> DataFrame:
    """One payment of the total; ``combined`` headers pay 40% cash and the rest by transfer."""
    cash = money(F.col("total") * F.lit("0.40").cast("decimal(3,2)"))
    whole = F.struct(F.col("payment_method").alias("method"), money(F.col("total")).alias("amount"))
    parts = F.array(
        F.struct(F.lit("cash").alias("method"), cash.alias("amount")),
        F.struct(F.lit("transfer").alias("method"), money(F.col("total") - cash).alias("amount")),
    )
    return headers.select(
        F.col("id").alias(key),
        F.inline(F.when(F.col("payment_method") == "combined", parts).otherwise(F.array(whole))),
    ).select(
        key,
        F.col("method").alias("payment_method"),
        "amount",
        F.when(F.col("method") != "current_account", F.col(key)).alias("cash_movement_id"),
    )


class Roles:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(SUPPLIED[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.raw("nation").select(
            key.cast("bigint").alias("id"),
            F.lower("n_name").alias("username"),
            F.col("n_name").alias("name"),
            F.when(key % 5 == 0, " ").otherwise(F.concat(F.lower("n_name"), F.lit("@example.org"))).alias("email"),
            F.when(key % 5 == 1, "admin").otherwise("empleado").alias("role"),
            (key % 6 != 0).alias("active"),
            F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_regionkey")).cast("timestamp_ntz").alias("created_at"),
        )

    @cached_property
    def clients(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id"),
            F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("username"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("381"), _digits("c_custkey", 7)).alias("phone"),
            _digits("c_custkey", 12).alias("dni"),
            (key % 10 != 0).alias("active"),
            F.date_add(F.lit("2000-01-01").cast("date"), (key % 500).cast("int")).cast("timestamp_ntz").alias("created_at"),
            F.when(key % 11 != 0, key % 25).alias("created_by"),
        )

    @cached_property
    def plans(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_size").alias("duration_days"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.col("p_type").alias("description"),
            (F.col("p_partkey") % 9 != 0).alias("active"),
        )

    @cached_property
    def instructors(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            _digits("s_suppkey", 12).alias("dni"),
            F.concat(F.lit("381"), _digits("s_suppkey", 7)).alias("phone"),
            (F.col("s_suppkey") % 4 != 0).alias("active"),
        )

    @cached_property
    def plan_instructors(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select(F.col("l_partkey").alias("plan_id"), F.col("l_suppkey").alias("instructor_id"))
            .distinct()
        )

    @cached_property
    def memberships(self) -> DataFrame:
        key = F.col("o_orderkey")
        plan = self.raw("part").select(F.col("p_partkey").alias("_plan"), "p_size")
        status = (
            F.when(F.col("o_orderstatus") == "P", "cancelled")
            .when((F.col("o_orderstatus") == "F") & (key % 2 != 0), "expired")
            .otherwise("active")
        )
        start = F.to_date("o_orderdate")
        method = _method(F.col("o_orderpriority"))
        return (
            self.raw("orders")
            .join(plan, key % PLAN_COUNT == F.col("_plan"))
            .select(
                key.alias("id"),
                F.col("o_custkey").alias("client_id"),
                F.col("_plan").alias("plan_id"),
                F.when(key % 7 != 0, key % 10).alias("instructor_id"),
                start.alias("start_date"),
                F.date_add(start, F.col("p_size")).alias("end_date"),
                status.alias("status"),
                method.alias("payment_method"),
                F.when(method == "current_account", "pending").otherwise("paid").alias("payment_status"),
                F.when(~method.isin("current_account", "combined"), key).alias("cash_movement_id"),
                (key % 5 * 10).cast("decimal(12,2)").alias("discount"),
                F.element_at(F.array(F.lit(""), F.lit("5"), F.lit("5,3"), F.lit("3")), (key % 4).cast("int") + 1).alias(
                    "reminder_sent_days"
                ),
                F.when(key % 11 != 0, key % 25).alias("created_by"),
                F.col("o_orderdate").alias("created_at"),
            )
        )

    @cached_property
    def membership_payments(self) -> DataFrame:
        """Payment rows of two memberships in three; those of the others name no membership, which leaves these their header alone."""
        price = self.plans.select(F.col("id").alias("_plan"), "price")
        due = F.greatest(F.lit(0).cast("decimal(12,2)"), money(F.col("price") - F.col("discount")))
        off = F.when(F.col("id") % 17 == 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(12,2)")
        headers = (
            self.memberships.join(price, F.col("plan_id") == F.col("_plan"))
            .select("id", "payment_method", money(due + off).alias("total"))
        )
        rows = split_payments(headers, "membership_id")
        return rows.withColumn("membership_id", F.when(F.col("membership_id") % 3 == 0, -F.col("membership_id")).otherwise(F.col("membership_id")))

    @cached_property
    def sales(self) -> DataFrame:
        key = F.col("o_orderkey")
        method = _method(F.col("o_orderpriority"))
        total = F.col("o_totalprice").cast("decimal(12,2)")
        discount = (key % 5).cast("decimal(12,2)")
        return self.raw("orders").select(
            key.alias("id"),
            (key % 25).alias("user_id"),
            F.when(key % 13 != 0, F.col("o_custkey")).alias("client_id"),
            (key % SESSION_COUNT).alias("cash_session_id"),
            F.when(~method.isin("current_account", "combined"), key).alias("cash_movement_id"),
            method.alias("payment_method"),
            money(total + discount).alias("subtotal"),
            discount.alias("discount"),
            total.alias("total"),
            F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("completed").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def sale_payments(self) -> DataFrame:
        return split_payments(self.sales.select("id", "payment_method", "total"), "sale_id")

    @cached_property
    def sale_items(self) -> DataFrame:
        product = self.raw("part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
        return (
            self.raw("lineitem")
            .join(product, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("sale_id"),
                F.col("l_linenumber").alias("line_no"),
                F.col("l_partkey").alias("product_id"),
                F.col("p_name").alias("product_name"),
                F.col("p_brand").alias("product_code"),
                F.col("l_quantity").cast("decimal(12,3)").alias("quantity"),
                F.lit("unidad").alias("unit"),
                F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
                F.col("l_extendedprice").cast("decimal(12,2)").alias("subtotal"),
            )
        )

    @cached_property
    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        price = F.col("p_retailprice").cast("decimal(12,2)")
        return self.raw("part").select(
            key.alias("id"),
            F.col("p_name").alias("name"),
            F.concat(F.lit("P"), key.cast("string")).alias("code"),
            F.col("p_type").alias("description"),
            F.col("p_brand").alias("category"),
            price.alias("sale_price"),
            money(price * F.lit("0.60").cast("decimal(3,2)")).alias("cost_price"),
            (key * 37 % 101 - 10).cast("decimal(12,3)").alias("stock"),
            F.col("p_size").cast("decimal(12,3)").alias("min_stock"),
            F.when(key % 3 == 0, "kg").otherwise("unidad").alias("unit"),
            (key % 10 != 7).alias("active"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return (
            self.raw("part")
            .groupBy(F.col("p_brand").alias("name"))
            .agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("description"))
            .select("id", "name", "description", (F.col("id") % 3 != 0).alias("active"))
        )

    @cached_property
    def classes(self) -> DataFrame:
        """A timetable slot per supplier; every eighth has a weekday outside the list."""
        key = F.col("s_suppkey")
        names = F.array(*[F.lit(d) for d in ("Domingo", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Feriado")])
        return self.raw("supplier").select(
            key.alias("id"),
            F.concat(F.lit("Clase "), key.cast("string")).alias("name"),
            F.col("s_name").alias("instructor"),
            F.element_at(names, (key % 8).cast("int") + 1).alias("day_of_week"),
            F.concat(F.lpad((key * 5 % 14 + 7).cast("string"), 2, "0"), F.lit(":00:00")).alias("start_time"),
            F.lit(20).alias("capacity"),
            (key % 4 != 0).alias("active"),
            (F.col("s_nationkey").cast("bigint")).alias("created_by"),
        )

    @cached_property
    def notices(self) -> DataFrame:
        key = F.col("event_id")
        return (
            self.raw("events")
            .filter("event_type = 'signup'")
            .select(
                key.alias("id"),
                F.concat(F.lit("Aviso "), key.cast("string")).alias("title"),
                F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("success")), (key % 3).cast("int") + 1).alias("type"),
                (key % 4 != 0).alias("active"),
                (F.col("user_id") % 30).alias("created_by"),
                F.col("ts").alias("created_at"),
            )
        )

    @cached_property
    def stock_movements(self) -> DataFrame:
        flag = F.col("l_returnflag")
        quantity = F.col("l_quantity").cast("decimal(12,3)")
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("product_id"),
            F.when(flag == "R", "entrada").when(flag == "A", "salida").otherwise("ajuste").alias("type"),
            F.when(flag == "R", quantity).otherwise(-quantity).cast("decimal(12,3)").alias("quantity"),
            F.concat(F.lit("Venta #"), F.col("l_orderkey").cast("string")).alias("notes"),
            (F.col("l_suppkey") % 25).alias("created_by"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_orderkey").alias("source_id"),
        )

    @cached_property
    def client_entries(self) -> DataFrame:
        at = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
        shift = F.make_dt_interval(F.lit(ENTRY_SHIFT_DAYS))
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("client_id"),
            F.col("event_id").alias("membership_id"),
            (at - shift).alias("entered_at"),
            (F.col("user_id") % 25).alias("created_by"),
        )

    @cached_property
    def cash_movements(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.datediff(F.to_date("ts"), F.lit(FIRST_EVENT_DAY).cast("date")).cast("bigint").alias("cash_session_id"),
            F.when(kind == "purchase", "sale")
            .when(kind == "signup", "membership_payment")
            .when(kind == "error", "expense")
            .otherwise("income")
            .alias("type"),
            F.element_at(
                F.array(F.lit("cash"), F.lit("transfer"), F.lit("credit_card")), (F.col("event_id") % 3).cast("int") + 1
            ).alias("payment_method"),
            F.col("value").cast("decimal(10,2)").alias("amount"),
            F.concat(F.lit("Movimiento "), F.col("event_id").cast("string")).alias("description"),
            (F.col("user_id") % 25).alias("created_by"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def cash_sessions(self) -> DataFrame:
        """One per calendar day, the last still open; every seventh was closed on a wrong count."""
        totals = self.cash_movements.groupBy(F.col("cash_session_id").alias("id")).agg(
            F.sum(income()).alias("_in"), F.sum(expense()).alias("_out")
        )
        last = self.raw("events").agg(F.max(F.datediff(F.to_date("ts"), F.lit(FIRST_EVENT_DAY).cast("date")))).scalar()
        closed = F.col("id") < last
        opening = F.lit("100.00").cast("decimal(10,2)")
        wrong = F.when(F.col("id") % 7 == 0, F.lit(1)).otherwise(F.lit(0))
        expected = (opening + F.col("_in") - F.col("_out") + wrong).cast("decimal(10,2)")
        opened_day = F.date_add(F.lit(FIRST_EVENT_DAY).cast("date"), F.col("id").cast("int")).cast("timestamp_ntz")
        return totals.select(
            "id",
            (F.col("id") % 25).alias("user_id"),
            opening.alias("opening_amount"),
            F.when(closed, (expected + F.col("id") % 3).cast("decimal(10,2)")).alias("closing_amount"),
            F.when(closed, expected).alias("expected_amount"),
            F.when(closed, (F.col("id") % 3).cast("decimal(10,2)")).alias("difference"),
            F.when(closed, "closed").otherwise("open").alias("status"),
            (opened_day + F.make_dt_interval(F.lit(0), F.lit(8))).alias("opened_at"),
            F.when(closed, opened_day + F.make_dt_interval(F.lit(0), F.lit(22))).alias("closed_at"),
        )

    @cached_property
    def ledger_moves(self) -> DataFrame:
        """Ledger rows without their stored balance."""
        return (
            self.raw("events")
            .filter(F.col("event_type").isin("purchase", "signup"))
            .select(
                F.col("event_id").alias("id"),
                F.col("user_id").alias("client_id"),
                F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("membership_id"),
                F.when(F.col("event_type") == "purchase", "debit").otherwise("credit").alias("type"),
                F.col("value").cast("decimal(10,2)").alias("amount"),
                (F.col("user_id") % 25).alias("created_by"),
                F.col("ts").alias("created_at"),
            )
        )

    @cached_property
    def current_account(self) -> DataFrame:
        out = running(
            self.ledger_moves, ["client_id"], ["created_at", "id"], {"balance": Running("sum", signed_amount())}
        )
        return out.withColumn("balance", F.col("balance").cast("decimal(18,2)"))

    @cached_property
    def sale_request_lines(self) -> DataFrame:
        """Sale requests: the lines of each order, one per product, in order-date order.

        Lines move once, by request: whoever gathers or joins them by it needs no further shuffle.
        """
        lines = (
            self.raw("lineitem")
            .select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("decimal(12,3)").alias("quantity"))
            .repartition("request_id")
            .groupBy("request_id", "product_id")
            .agg(F.sum("quantity").cast("decimal(12,3)").alias("quantity"))
        )
        when = self.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("requested_at"))
        return lines.join(when, "request_id")
