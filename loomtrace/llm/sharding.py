"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of their keys. A balanced Feistel network permutes the smallest domain of an
even number of bits that holds all numbers; a value that falls outside the table's range is put through it again until
it falls inside (cycle walking), which makes a permutation of the range itself. Shard and slot follow from the permuted
number by division, so either can be computed for any row number without looking at other rows, and counts of shards
are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, unused

#: The round function works modulo this prime, the largest below 2^31.
PRIME = 2147483647
ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round, from a multiplicative generator."""
    out, x = [], (seed * 48271 + 12345) % PRIME or 1
    for _ in range(ROUNDS):
        a = x = x * 48271 % PRIME
        b = x = x * 48271 % PRIME
        out.append((a or 1, b))
    return out


def half_bits(n: int) -> int:
    """Bits of each half of the domain that holds ``n`` numbers."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The images of row numbers ``x`` (0 to n - 1, n up to 2^62) in the permutation of ``range(n)``."""
    bits = half_bits(n)
    mask = np.int64((1 << bits) - 1)
    keys = round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> bits, v & mask
        for a, b in keys:
            t = (right + b) % PRIME
            t = t * t % PRIME
            t = (t * a + b) % PRIME
            left, right = right, left ^ (t & mask)
        return (left << bits) | right

    out = once(x.astype(np.int64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside])
    return out


def feistel_sql(x: str, n_bits: str, seed: int) -> str:
    """One pass of the network over column ``x`` as SQL; ``n_bits`` names the bits of each half."""
    sql = f"(select {x} >> {n_bits} as l, {x} & ((1::bigint << {n_bits}) - 1) as r)"
    for a, b in round_keys(seed):
        sql = f"(select r as l, xor(l, (((((r + {b}) % {PRIME}) * ((r + {b}) % {PRIME})) % {PRIME} * {a} + {b}) % {PRIME}) & ((1::bigint << {n_bits}) - 1)) as r from {sql})"
    return f"(select (l << {n_bits}) | r from {sql})"


def numbered(df: DataFrame, keys: list[str], number: str = "row_number") -> tuple[DataFrame, str, int]:
    """``df`` with global row numbers from 0 in the order of ``keys``, nulls first, without a single-task sort; the
    name of the column that has them, ``number`` or, where it is taken, one like it; and the number of rows.

    Rows are sorted by ranges, stored with their range and place, and numbered by the counts of earlier ranges. Rows
    equal in all keys are numbered in any order; a last key spreads a large group of them over ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number, spread, range_, place = unused(df, number, "__spread", "__range", "__place")
    order = [*keys, spread]
    placed = df.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = spool(placed.withColumn(range_, F.shiftright(at, 33)).withColumn(place, at.bitwiseAND(F.lit((1 << 33) - 1))).drop(spread))
    before, total = [], 0
    for r, n in sorted(placed.groupBy(range_).count().collect()):  # a row for each range, one a shuffle partition
        before.append((r, total))
        total += n
    offsets = spark.createDataFrame(before, f"{range_} long, __before long")
    return placed.join(F.broadcast(offsets), range_).withColumn(number, F.col("__before") + F.col(place)).drop(range_, place, "__before"), number, total


def deal(df: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 7) -> DataFrame:
    """``df`` with columns ``shard`` (0 to n_shards - 1) and ``slot`` (from 0, without gaps in a shard).

    Any columns may hold nulls, which sort first. Rows equal in all ``keys`` are interchangeable. With fewer rows than
    shards, some shards are empty; an empty table gives an empty result. Columns of ``df`` named ``shard`` or ``slot``
    are replaced.
    """
    df = df.drop("shard", "slot")
    rows, number, total = numbered(df, keys, "__number")
    (image,) = unused(rows, "__image")

    @F.pandas_udf("long")
    def images(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    dealt = rows.withColumn(image, images(number))
    return dealt.select(*df.columns, (F.col(image) % n_shards).cast("int").alias("shard"), F.expr(f"`{image}` div {n_shards}").alias("slot"))
