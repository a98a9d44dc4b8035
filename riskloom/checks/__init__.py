"""Queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from riskloom.checks.views import with_views

_MODULES = ("files", "findings", "matching", "manifests", "review", "streams")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in _MODULES:
        for key, fn in import_module(f"riskloom.checks.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"two queries named {key}")
            out[key] = fn
    return out


def all_sql() -> dict[str, str]:
    out = {}
    for name in _MODULES:
        out.update({k: with_views(v) for k, v in import_module(f"riskloom.checks.{name}").SQL.items()})
    return out
