"""Severity expressions. The four scales are kept apart; none is ever compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import dims


def rank(severity: Column, scale: dict) -> Column:
    """Rank on a scale; 0 when the value is not on it."""
    return dims.lookup(severity, scale, 0)


def scanner_severity(impact: Column) -> Column:
    up = F.upper(impact)
    return (F.when(up.isin("HIGH", "CRITICAL"), "CRITICAL").when(up == "MEDIUM", "ERROR")
            .when(up == "LOW", "WARNING").otherwise("INFO"))


def report_severity(impact: Column) -> Column:
    up = F.upper(impact)
    return (F.when(up.isin("CRITICAL", "HIGH"), "HIGH").when(up.isin("MEDIUM", "LOW"), up).otherwise("INFO"))


def severity4_from_level(level: Column) -> Column:
    return (F.when(level.isin("ERROR", "CRITICAL"), "CRITICAL").when(level.isin("WARNING", "HIGH"), "HIGH")
            .when(level.isin("NOTE", "LOW"), "LOW").otherwise("MEDIUM"))


def severity4_from_impact(impact: Column) -> Column:
    up = F.upper(impact)
    return F.when(up.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), up).otherwise("MEDIUM")


def horizon(severity: Column) -> Column:
    """When to fix: critical now, high within the week, the rest within the month."""
    up = F.upper(severity)
    return F.when(up == "CRITICAL", "immediate").when(up == "HIGH", "this week").otherwise("this month")
