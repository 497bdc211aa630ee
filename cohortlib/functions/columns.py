"""Column -> Column building blocks (all built-in expressions, so they stay inside codegen)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlib.functions.nulls import _col, if_known
from cohortlib.spec import Bands

__all__ = ["band", "banded", "map_values", "recode", "any_flag", "first_word", "rate_per", "round_half_even",
           "used_flag", "percent_text", "level_key", "overlap", "no_yes", "discharge_year",
           "row_count"]


def band(c: Column | str, cuts: Sequence[float], labels: Sequence[str], null_label: str | None = None) -> Column:
    """Right-closed bands; null gives ``null_label`` (null by default)."""
    c = _col(c)
    out = F.when(c.isNull(), F.lit(null_label))
    for cut, label in zip(cuts, labels):
        out = out.when(c <= cut, label)
    return out.otherwise(labels[-1])


def banded(c: Column | str, bands: Bands) -> Column:
    return band(c, bands.cuts, bands.labels, bands.null_label)


def _literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def map_values(c: Column | str, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Lookup of a small fixed mapping; null stays null, values outside it give ``default``."""
    c = _col(c)
    hit = _literal_map(mapping)[c]
    return hit if default is None else F.when(c.isNotNull(), F.coalesce(hit, F.lit(default)))


def recode(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    c = _col(c)
    return F.coalesce(_literal_map(mapping)[c], c)


def no_yes(c: Column | str) -> Column:
    """0/1 to No/Yes; anything else is null."""
    c = _col(c).cast("int")
    return F.when(c == 0, "No").when(c == 1, "Yes")


def any_flag(cols: Sequence[Column | str], value: str, yes: str, no: str) -> Column:
    """``yes`` if any column equals ``value``; null if none does but one is unknown."""
    hit = _col(cols[0]) == value
    for c in cols[1:]:
        hit = hit | (_col(c) == value)
    return if_known(hit, yes, no)


def first_word(c: Column | str) -> Column:
    return F.split(_col(c), " ")[0]


def rate_per(days: Column | str, exposure: Column | str | int, per: int) -> Column:
    """Days of use per ``per`` days of exposure; null for zero exposure."""
    exposure = F.lit(exposure) if isinstance(exposure, int) else _col(exposure)
    return F.try_divide(_col(days).cast("double"), exposure.cast("double")) * F.lit(per)


def round_half_even(c: Column | str, digits: int) -> Column:
    return F.bround(_col(c), digits)


def row_count() -> Column:
    return F.count(F.lit(1))


def used_flag(c: Column | str) -> Column:
    """A day or event count that exists means the service was used."""
    return F.when(_col(c).isNull(), "No").otherwise("Yes")


def percent_text(share: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _col(share) * 100)


def discharge_year(c: Column | str = "ServiceEnd") -> Column:
    return F.year(_col(c))


def level_key(c: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in a declared level order; unknown levels after all known, null last."""
    c = _col(c)
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), c)
    n = len(levels)
    return F.when(c.isNull(), n + 2).when(pos == 0, n + 1).otherwise(pos).cast("int")


def overlap(begin: Column, end: Column, w_begin: Column, w_end: Column) -> Column:
    """Days shared by the half-open spans [begin, end) and [w_begin, w_end), never negative.

    ``least``/``greatest`` skip nulls, so a span without an end counts as still running."""
    return F.greatest(F.lit(0), F.datediff(F.least(end, w_end), F.greatest(begin, w_begin)))
