"""Markings as ``array<bigint>`` in the order of places, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def of_state(state: Column, places: list[str]) -> Column:
    """The marking of a state map, tokens rounded."""
    return F.array(*[F.coalesce(F.round(F.try_element_at(state, F.lit(p))).cast("long"), F.lit(0).cast("long")) for p in places])


def to_state(marking: Column, places: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(p) for p in places]), F.transform(marking, lambda n: n.cast("double")))


def total(marking: Column) -> Column:
    return F.aggregate(marking, F.lit(0).cast("long"), lambda a, b: a + b)


def covers(a: Column, b: Column) -> Column:
    """Whether ``a`` has at least the tokens of ``b`` everywhere."""
    return F.forall(F.zip_with(a, b, lambda x, y: x >= y), lambda ok: ok)


def strictly_covers(a: Column, b: Column) -> Column:
    return covers(a, b) & (a != b)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def held(marking: Column, places: list[str]) -> Column:
    """Names of the places with tokens."""
    names = F.array(*[F.lit(p) for p in places])
    return F.transform(F.filter(F.arrays_zip(marking.alias("n"), names.alias("p")), lambda e: e["0"] > 0), lambda e: e["1"])


def digest(marking: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.transform(marking, lambda n: n.cast("string")), ","), 256), 1, 16)
