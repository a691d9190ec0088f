"""Algebra of state maps (``map<string,double>``) as column expressions.

Maps in results have their keys in order, so that equal maps are written alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_order(m: str | Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(_col(m))))


def merge(*maps: str | Column) -> Column:
    """All maps laid over each other; later values win."""
    out = _col(maps[0])
    for m in maps[1:]:
        out = F.map_zip_with(out, _col(m), lambda k, a, b: F.coalesce(b, a))
    return in_order(out)


def get(m: str | Column, key: str | Column) -> Column:
    return F.coalesce(F.try_element_at(_col(m), F.lit(key) if isinstance(key, str) else key), F.lit(0.0))


def total(m: str | Column) -> Column:
    return F.aggregate(F.map_values(_col(m)), F.lit(0.0), lambda a, b: a + b)


def total_of(m: str | Column, keys: Iterable[str]) -> Column:
    return sum((get(m, k) for k in keys), F.lit(0.0))


def scale(m: str | Column, factor: float | Column) -> Column:
    return F.transform_values(_col(m), lambda k, v: v * factor)


def keep(m: str | Column, predicate: Callable[[Column], Column]) -> Column:
    """Entries whose key meets the predicate."""
    return F.map_filter(_col(m), lambda k, v: predicate(k))


def keys(m: str | Column) -> Column:
    return F.array_sort(F.map_keys(_col(m)))


def non_zero(m: str | Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(_col(m), lambda k, v: v != 0)))


def difference(a: str | Column, b: str | Column) -> Column:
    """Keys whose value changed or is new with ``b``'s value, and keys that are gone with 0."""
    both = F.map_zip_with(_col(a), _col(b), lambda k, x, y: F.when(~x.eqNullSafe(y), F.coalesce(y, F.lit(0.0))))
    return in_order(F.map_filter(both, lambda k, v: v.isNotNull()))


def equal(a: str | Column, b: str | Column, tolerance: float = 0.0) -> Column:
    """Whether both have the same keys and values within a tolerance."""
    near = F.map_zip_with(_col(a), _col(b), lambda k, x, y: x.isNotNull() & y.isNotNull() & (F.abs(x - y) <= tolerance))
    return F.forall(F.map_values(near), lambda ok: F.coalesce(ok, F.lit(False)))


def largest(m: str | Column) -> Column:
    """``struct(key, value)`` of the greatest value, the first key of those that tie; null for an empty map."""
    return F.element_at(F.array_sort(F.map_entries(_col(m)), lambda x, y: F.when(x.value > y.value, -1).when(x.value < y.value, 1).when(x.key < y.key, -1).otherwise(1)), 1)


def smallest(m: str | Column) -> Column:
    return F.element_at(F.array_sort(F.map_entries(_col(m)), lambda x, y: F.when(x.value < y.value, -1).when(x.value > y.value, 1).when(x.key < y.key, -1).otherwise(1)), 1)


def digest(m: str | Column) -> Column:
    """SHA-256 of the map's entries in order: a key for looking up equal states."""
    entries = F.transform(F.array_sort(F.map_entries(_col(m))), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return F.sha2(F.array_join(entries, "\n"), 256)


def aggregates(m: str | Column, prefix: str) -> Column:
    """``struct(total, places, least, most)`` over places whose name starts with ``prefix``: the sum, how many hold
    tokens, the least (0 if there is none) and the most (0 at least)."""
    values = F.map_values(F.map_filter(_col(m), lambda k, v: k.startswith(prefix)))
    return F.struct(
        F.aggregate(values, F.lit(0.0), lambda a, b: a + b).alias("total"),
        F.size(F.filter(values, lambda v: v > 0)).alias("places"),
        F.coalesce(F.array_min(values), F.lit(0.0)).alias("least"),
        F.greatest(F.coalesce(F.array_max(values), F.lit(0.0)), F.lit(0.0)).alias("most"),
    )
