"""All registered queries; importing a module registers its own."""

from molinete.registry import cash, dims, kept, members, reports, sales, stored, upserts  # noqa: F401
from molinete.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
