"""Queries that apply the operators to whole tables, with the SQL that they must agree with."""

import importlib

from quire.plans.registry import QUERIES, SQL

MODULES = ("tables", "joins", "metrics", "values", "states", "streams")


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"quire.plans.{module}")
    return QUERIES, SQL
