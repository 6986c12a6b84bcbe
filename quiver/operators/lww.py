"""Last-writer-wins views over a log of upserts and deletes, snapshots, and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: When upkeep is due: so many tombstones, and so large a share of all entries. Fixed values.
COMPACT_TOMBSTONES = 1000
COMPACT_SHARE = 0.1


def last_entries(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last row of each key: one aggregation, so a key written often shuffles one row per task, not its history.

    ``order`` must tell any two rows of a key apart; of equal ones either may stay. Rows with a null key are left out.
    """
    rest = [c for c in log.columns if c != key]
    by = F.struct(*order) if len(order) > 1 else F.col(order[0])
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("__last"))
    return last.select(key, *(F.col("__last")[c].alias(c) for c in rest))


def live_view(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",), op: str = "op") -> DataFrame:
    """Rows whose key's last entry is an upsert; entries of an upsert replace all of the former one."""
    return last_entries(log, key, order).where(F.col(op) == "upsert")


def tombstones(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",), op: str = "op") -> DataFrame:
    return last_entries(log, key, order).where(F.col(op) == "delete")


def counts(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("seq",), op: str = "op") -> DataFrame:
    """One row (size, deleted): keys that live, and keys whose last entry is a delete."""
    last = last_entries(log.select(key, *order, op), key, order)
    return last.agg(F.count(F.when(F.col(op) == "upsert", 1)).alias("size"), F.count(F.when(F.col(op) == "delete", 1)).alias("deleted"))


def recover(snapshot: DataFrame, log: DataFrame, upto: int, key: str = "id", order: tuple[str, ...] = ("seq",), op: str = "op") -> DataFrame:
    """The live view of a snapshot that covers entries up to ``upto`` and of the log's later entries.

    The tail filter is on the log's own column, so files that end before it aren't read.
    """
    tail = log.where(F.col(order[0]) > upto)
    return live_view(snapshot.unionByName(tail), key, order, op)


def compaction_due(size: int, deleted: int) -> bool:
    return deleted >= COMPACT_TOMBSTONES and deleted >= COMPACT_SHARE * (size + deleted)
