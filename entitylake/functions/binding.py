"""Evaluate an expression once and use it many times inside one row expression.

Catalyst may copy an expression to each place where it is used.  A lambda
variable cannot be copied, so binding a costly value (a token list, a cleaned
text) to one guarantees a single evaluation per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated exactly once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep_if(record: Column, condition: Callable[[Column], Column]) -> Column:
    """Generator: the fields of ``record`` as columns, dropping rows that fail.

    Unlike ``filter`` after ``select``, the optimizer cannot copy the record's
    expression into a filter below the projection, so it is computed once.
    """
    return F.inline(F.filter(F.array(record), condition))


def record(**fields: Column) -> Column:
    """Struct with the given field names.

    The names are part of the expression, unlike aliases inside ``struct``, which
    are dropped when a generator stands in the same ``select``.
    """
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])
