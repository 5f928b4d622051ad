"""Array expressions used by the audits.

Arrays that a lambda looks into are bound with :func:`let`, so the optimizer can
collapse projections without re-evaluating them once per element.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def int_range(start, end) -> Column:
    """``[start, end)`` as ints; empty when ``end <= start``."""
    start = F.lit(start).cast("int") if isinstance(start, int) else start
    end = F.lit(end).cast("int") if isinstance(end, int) else end
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(empty("int"))


def positions_where(values: Column, predicate) -> Column:
    """Indices at which ``predicate(value, index)`` holds, ascending."""
    marked = F.transform(values, lambda v, i: F.when(predicate(v, i), i))
    return F.filter(marked, lambda p: p.isNotNull())


def first_index(values: Column, predicate) -> Column:
    """Lowest index at which ``predicate(value, index)`` holds, or NULL."""
    return F.array_min(F.transform(values, lambda v, i: F.when(predicate(v, i), i)))


def count_where(values: Column, predicate) -> Column:
    return F.size(F.filter(values, predicate))


def first_code(codes: Column) -> Column:
    """First non-null element, or NULL."""
    return F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))


def compact_codes(*conditions: tuple[Column, str]) -> Column:
    """Codes whose condition is true, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in conditions]))


def joined(values: Column) -> Column:
    """The ``|``-joined text form used by flat reports."""
    return F.array_join(values.cast("array<string>"), "|")
