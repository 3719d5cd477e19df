"""Declared schemas, enum domains and foreign keys of the 19 tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The column names and types of the data model.
TABLES = {
    "users": "id BIGINT, username STRING, name STRING, email STRING, role STRING, active BOOLEAN, "
    "created_at TIMESTAMP_NTZ, last_login TIMESTAMP_NTZ",
    "clients": "id BIGINT, username STRING, name STRING, phone STRING, address STRING, dni STRING, "
    "emergency_contact STRING, emergency_phone STRING, active BOOLEAN, created_at TIMESTAMP_NTZ, "
    "last_login TIMESTAMP_NTZ, created_by BIGINT",
    "notices": "id BIGINT, title STRING, content STRING, type STRING, active BOOLEAN, created_by BIGINT, "
    "created_at TIMESTAMP_NTZ",
    "classes": "id BIGINT, name STRING, description STRING, instructor STRING, day_of_week STRING, "
    "start_time STRING, end_time STRING, capacity INT, active BOOLEAN, created_by BIGINT",
    "instructors": "id BIGINT, name STRING, dni STRING, phone STRING, active BOOLEAN",
    "plans": "id BIGINT, name STRING, duration_days INT, price DECIMAL(10,2), description STRING, active BOOLEAN",
    "plan_instructors": "plan_id BIGINT, instructor_id BIGINT",
    "cash_sessions": "id BIGINT, user_id BIGINT, opening_amount DECIMAL(10,2), closing_amount DECIMAL(10,2), "
    "expected_amount DECIMAL(10,2), difference DECIMAL(10,2), closing_cash DECIMAL(10,2), "
    "closing_transfer DECIMAL(10,2), closing_card DECIMAL(10,2), status STRING, opened_at TIMESTAMP_NTZ, "
    "closed_at TIMESTAMP_NTZ, notes STRING",
    "cash_movements": "id BIGINT, cash_session_id BIGINT, type STRING, payment_method STRING, "
    "amount DECIMAL(10,2), description STRING, reference STRING, created_by BIGINT, created_at TIMESTAMP_NTZ",
    "memberships": "id BIGINT, client_id BIGINT, plan_id BIGINT, instructor_id BIGINT, start_date DATE, "
    "end_date DATE, status STRING, payment_method STRING, payment_status STRING, paid_at TIMESTAMP_NTZ, "
    "cash_movement_id BIGINT, discount DECIMAL(12,2), notes STRING, reminder_sent_days STRING, "
    "created_by BIGINT, created_at TIMESTAMP_NTZ",
    "membership_payments": "id BIGINT, membership_id BIGINT, payment_method STRING, amount DECIMAL(12,2), "
    "cash_movement_id BIGINT, created_at TIMESTAMP_NTZ",
    "client_entries": "id BIGINT, client_id BIGINT, membership_id BIGINT, entered_at TIMESTAMP_NTZ, created_by BIGINT",
    "current_account": "id BIGINT, client_id BIGINT, membership_id BIGINT, type STRING, amount DECIMAL(10,2), "
    "description STRING, payment_method STRING, cash_movement_id BIGINT, balance DECIMAL(10,2), "
    "created_by BIGINT, created_at TIMESTAMP_NTZ",
    "categories": "id BIGINT, name STRING, description STRING, active BOOLEAN",
    "products": "id BIGINT, name STRING, code STRING, description STRING, category STRING, "
    "sale_price DECIMAL(12,2), cost_price DECIMAL(12,2), stock DECIMAL(12,3), min_stock DECIMAL(12,3), "
    "unit STRING, active BOOLEAN",
    "stock_movements": "id BIGINT, product_id BIGINT, type STRING, quantity DECIMAL(12,3), notes STRING, "
    "created_by BIGINT, created_at TIMESTAMP_NTZ",
    "sales": "id BIGINT, user_id BIGINT, client_id BIGINT, cash_session_id BIGINT, cash_movement_id BIGINT, "
    "payment_method STRING, subtotal DECIMAL(12,2), discount DECIMAL(12,2), total DECIMAL(12,2), "
    "status STRING, notes STRING, created_at TIMESTAMP_NTZ",
    "sale_payments": "id BIGINT, sale_id BIGINT, payment_method STRING, amount DECIMAL(12,2), cash_movement_id BIGINT",
    "sale_items": "id BIGINT, sale_id BIGINT, product_id BIGINT, product_name STRING, product_code STRING, "
    "quantity DECIMAL(12,3), unit STRING, unit_price DECIMAL(12,2), subtotal DECIMAL(12,2)",
}


def table_schema(name: str) -> T.StructType:
    """The declared schema (parsing DDL needs a running session)."""
    return T.StructType.fromDDL(TABLES[name])


# Enum domains.
DRAWER_METHODS = ("cash", "transfer", "credit_card")
PAYMENT_METHODS = (*DRAWER_METHODS, "current_account")
HEADER_METHODS = (*PAYMENT_METHODS, "combined")
SALE_STATUSES = ("completed", "cancelled")
MEMBERSHIP_STATUSES = ("active", "expired", "cancelled")
INCOME_TYPES = ("income", "membership_payment", "sale")
STOCK_TYPES = ("entrada", "salida", "ajuste")
UNITS = ("unidad", "kg")
ROLES = ("admin", "empleado")
REMINDER_DAYS = (0, 1, 2, 3, 4, 5)
WEEKDAYS = ("Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo")

DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("users", "role"): ROLES,
    ("notices", "type"): ("info", "warning", "success"),
    ("classes", "day_of_week"): WEEKDAYS,
    ("cash_sessions", "status"): ("open", "closed"),
    ("cash_movements", "type"): ("income", "expense", "membership_payment", "sale"),
    ("cash_movements", "payment_method"): DRAWER_METHODS,
    ("memberships", "status"): MEMBERSHIP_STATUSES,
    ("memberships", "payment_method"): HEADER_METHODS,
    ("memberships", "payment_status"): ("pending", "paid"),
    ("membership_payments", "payment_method"): PAYMENT_METHODS,
    ("current_account", "type"): ("debit", "credit"),
    ("current_account", "payment_method"): DRAWER_METHODS,
    ("products", "unit"): UNITS,
    ("stock_movements", "type"): STOCK_TYPES,
    ("sales", "payment_method"): HEADER_METHODS,
    ("sales", "status"): SALE_STATUSES,
    ("sale_payments", "payment_method"): PAYMENT_METHODS,
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    on_delete: str  # CASCADE | SET NULL | RESTRICT


# The declared foreign keys and their delete rules.
FOREIGN_KEYS = tuple(
    ForeignKey(*row)
    for row in (
        ("clients", "created_by", "users", "SET NULL"),
        ("notices", "created_by", "users", "CASCADE"),
        ("classes", "created_by", "users", "CASCADE"),
        ("plan_instructors", "plan_id", "plans", "CASCADE"),
        ("plan_instructors", "instructor_id", "instructors", "CASCADE"),
        ("cash_sessions", "user_id", "users", "RESTRICT"),
        ("cash_movements", "cash_session_id", "cash_sessions", "RESTRICT"),
        ("cash_movements", "created_by", "users", "RESTRICT"),
        ("memberships", "client_id", "clients", "CASCADE"),
        ("memberships", "plan_id", "plans", "RESTRICT"),
        ("memberships", "instructor_id", "instructors", "SET NULL"),
        ("memberships", "created_by", "users", "SET NULL"),
        ("memberships", "cash_movement_id", "cash_movements", "SET NULL"),
        ("membership_payments", "membership_id", "memberships", "CASCADE"),
        ("membership_payments", "cash_movement_id", "cash_movements", "SET NULL"),
        ("client_entries", "client_id", "clients", "CASCADE"),
        ("client_entries", "membership_id", "memberships", "CASCADE"),
        ("client_entries", "created_by", "users", "SET NULL"),
        ("current_account", "client_id", "clients", "CASCADE"),
        ("current_account", "membership_id", "memberships", "SET NULL"),
        ("current_account", "cash_movement_id", "cash_movements", "SET NULL"),
        ("current_account", "created_by", "users", "RESTRICT"),
        ("stock_movements", "product_id", "products", "CASCADE"),
        ("stock_movements", "created_by", "users", "RESTRICT"),
        ("sales", "user_id", "users", "RESTRICT"),
        ("sales", "client_id", "clients", "SET NULL"),
        ("sales", "cash_session_id", "cash_sessions", "SET NULL"),
        ("sales", "cash_movement_id", "cash_movements", "SET NULL"),
        ("sale_payments", "sale_id", "sales", "CASCADE"),
        ("sale_payments", "cash_movement_id", "cash_movements", "SET NULL"),
        ("sale_items", "sale_id", "sales", "CASCADE"),
        ("sale_items", "product_id", "products", "RESTRICT"),
    )
)

# Columns that must be unique (NULLs allowed).
UNIQUE_COLUMNS = (
    ("clients", "username"),
    ("clients", "dni"),
    ("users", "username"),
    ("users", "email"),
    ("products", "code"),
    ("plans", "name"),
    ("categories", "name"),
    ("instructors", "dni"),
)
