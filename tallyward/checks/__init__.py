"""Queries run against the given tables, with the SQL that must agree."""

from __future__ import annotations

from importlib import import_module

MODULES = ("source_checks", "relational_checks", "login_checks", "report_checks", "amount_checks", "scan_checks", "export_checks")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tallyward.checks.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_calls() -> dict:
    return _merged("CALLS")


def all_sql() -> dict:
    return _merged("SQL")
