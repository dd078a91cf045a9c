"""Imports every query module, which fills the registry."""
from tracewell.queries import groups, ledger, lines, rules, streams, text  # noqa: F401
from tracewell.queries.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
