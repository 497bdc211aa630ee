"""Column helpers that keep missing values the way an analyst's tables need them.

Spark's defaults differ in five places: ``otherwise`` swallows a null condition, ``isin`` on null is
null, ``sum`` skips nulls, ``concat_ws`` skips nulls, and ``~null`` drops the row in a filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["if_known", "is_in", "strict_sum", "concat_na", "true_only", "known"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_known(condition: Column, yes, no) -> Column:
    """``yes``/``no`` by condition; null when the condition itself is null."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, lit(yes)).when(~condition, lit(no))


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership test that is never null."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def true_only(condition: Column) -> Column:
    """A null condition counts as false."""
    return F.coalesce(condition, F.lit(False))


def strict_sum(c: Column | str) -> Column:
    """Sum that is null as soon as one summand is null."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def concat_na(sep: str, cols: Sequence[Column | str]) -> Column:
    """Join texts with ``sep``; a null part appears as the text NA."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def known(c: Column | str) -> Column:
    return _col(c).isNotNull()
