"""Safe pieces of Spark SQL text.

Operators with many expressions per column are written as SQL text: one parse per
expression instead of one driver call per function keeps wide tables quick to plan.
"""

from __future__ import annotations

import math


def quoted(name: str) -> str:
    """A column name that may hold dots or blanks."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float | int | None) -> str:
    """A double literal that reads back as the same double."""
    if value is None or math.isnan(value):
        return "CAST(NULL AS DOUBLE)"
    if math.isinf(value):
        return f"DOUBLE('{'-' if value < 0 else ''}Infinity')"
    return f"{float(value)!r}D"


def struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{text(k)}, {v}" for k, v in fields.items()) + ")"


def rows(structs: list[str]) -> str:
    """Explode structs of one shape to rows."""
    return f"inline(array({', '.join(structs)}))"
