"""Joins of a large row table to a keyed table, safe under skew.

A keyed table (weights, losses, potentials) has one row per key.  When its
row count is known and small it is broadcast; beyond that bound the join is
shuffled with every *hot* key split over as many sub-keys as its count calls
for, so that a key holding a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.schemas import require

# A broadcast side never has more rows than this (a few tens of MB).
BROADCAST_ROWS = 500_000
# A key with fewer rows is never split: one task handles it.
COLD_ROWS = 10_000
# Sub-keys of a hot key for each average partition that its rows would fill; small pieces even out over partitions.
PIECES = 16
# Counters of the sketch that finds hot keys: counts are right to 4e-5 of the rows, and no key above 1e-4 is missed.
COUNTERS = 65_536

_HASH, _SALT = "__key_hash", "__salt"


def fits_broadcast(rows: int | None) -> bool:
    return rows is not None and rows <= BROADCAST_ROWS


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def is_key(keys: Sequence[str], hashes: Sequence[int]) -> Column:
    """Whether a row's key is one of those with these hashes."""
    return key_hash(keys).isin(list(hashes)) if hashes else F.lit(False)


def hot_share(partitions: int) -> float:
    """Share of the rows from which a key counts as hot: half of an average partition."""
    return 1.0 / min(max(2 * partitions, 200), 9_999)  # the sketch finds no share of 1e-4 or less


def pieces(filled: float) -> int:
    """Sub-keys of a key whose rows would fill ``filled`` average partitions: a power of two, at least two."""
    return 1 << max(1, math.ceil(math.log2(PIECES * filled)))


def fan_out(rows: DataFrame, keys: Sequence[str]) -> dict[int, int]:
    """Hash of every hot key, and the number of sub-keys its count calls for.

    One pass over the keys alone: the sketch counts them in a bounded table per task, tables are
    merged, and at most one entry per hot share reaches the driver.  All sub-keys together are
    ``2 * PIECES`` a partition at most, whatever the number of keys.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = rows.select(key_hash(keys).alias(_HASH))
    found = hashed.agg(F.expr(f"approx_top_k({_HASH}, 10000, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    floor = max(hot_share(partitions) * found["n"], COLD_ROWS)
    return {r["item"]: pieces(r["count"] * partitions / found["n"]) for r in found["top"] if r["count"] > floor}


class SpreadRows:
    """A row table whose hot keys are split over sub-keys, for joins on ``keys``.

    The hot keys and their numbers of sub-keys are found once, so both sides of every join agree on them.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], fan: dict[int, int] | None = None):
        self.keys = list(keys)
        self.fan = fan_out(rows, self.keys) if fan is None else fan
        self.placed = False
        self.rows = rows
        if self.fan:
            others = [c for c in rows.columns if c not in self.keys] or self.keys
            spread = F.xxhash64(*[F.col(c) for c in others])
            self.rows = rows.withColumn(_SALT, self._by_fan(lambda n: F.pmod(spread, F.lit(n)), F.lit(0)).cast("int"))

    @staticmethod
    def place(rows: DataFrame, keys: Sequence[str], *checks: tuple[Column, str]) -> "SpreadRows":
        """Cache rows placed by (keys, sub-key), so repeated joins move only the keyed table.

        ``checks`` (see :func:`gradloom.schemas.require`) are made by the job that places the rows.
        The input is read twice: its keys alone for the hot ones, then whole.
        """
        spread = SpreadRows(rows, keys)
        placement = [*spread.keys, _SALT] if spread.fan else spread.keys
        # Sorted once, so that merge joins need not sort these rows again.
        placed = require(spread.rows, *checks).repartition(*placement).sortWithinPartitions(*placement)
        spread.rows = placed.persist(StorageLevel.MEMORY_AND_DISK)
        spread.placed = True
        return spread

    def _by_fan(self, of: Callable[[int], Column], cold: Column) -> Column:
        """``of(n)`` for keys with n sub-keys, one hash set for each n."""
        sizes: dict[int, list[int]] = {}
        for key, n in self.fan.items():
            sizes.setdefault(n, []).append(key)
        out = F
        for n, hashes in sorted(sizes.items()):
            out = out.when(key_hash(self.keys).isin(hashes), of(n))
        return out.otherwise(cold)

    @property
    def plain(self) -> DataFrame:
        """The original rows, in their current placement."""
        return self.rows.drop(_SALT)

    def unpersist(self) -> None:
        if self.placed:
            self.rows.unpersist()

    def join(self, table: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with the entry of ``table``, which is copied to as many sub-keys as its key has."""
        if not self.fan:
            return self.rows.join(table, self.keys, how)
        every = self._by_fan(lambda n: F.sequence(F.lit(0), F.lit(n - 1)), F.array(F.lit(0)))
        copies = table.withColumn(_SALT, F.explode(every))
        return self.rows.join(copies, [*self.keys, _SALT], how).drop(_SALT)


def lookup(
    rows: DataFrame | SpreadRows,
    table: DataFrame,
    keys: Sequence[str],
    table_rows: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Attach the entry of ``table`` (unique on ``keys``) to every row of ``rows``."""
    keys = list(keys)
    if isinstance(rows, SpreadRows):
        if rows.keys == keys:
            return rows.join(table, how)
        rows = rows.plain
    if fits_broadcast(table_rows):
        return rows.join(F.broadcast(table), keys, how)
    return SpreadRows(rows, keys).join(table, how)
