"""Helpers to emit one SQL expression string instead of a tree of Column calls.

A large expression built node by node costs one driver-to-JVM round trip per
node; the same expression as SQL text is parsed once. The plan is identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ident(name: str) -> str:
    """Back-quoted column reference."""
    return "`" + name.replace("`", "``") + "`"


def lit(value) -> str:
    """SQL literal for a Python value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(float(value)) + "D" if isinstance(value, float) else str(value)
    s = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return "'" + s + "'"


def expr(text: str) -> Column:
    return F.expr(text)


def as_sql(col) -> str | None:
    """SQL text for a column name; None for a Column object (callers fall back)."""
    return ident(col) if isinstance(col, str) else None
