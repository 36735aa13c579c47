"""The registered queries and the SQL they are checked against."""

from inboxlake.plans import actions, context, customer, delivery, language, live, stuck, threads  # noqa: F401
from inboxlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
