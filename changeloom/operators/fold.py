"""Folding a change log into the state of a table.

Everything a key needs is aggregated map-side before one shuffle, so a key with
many changes costs a task no more than others.  The last truncate of a table
comes out of the same aggregation: the truncates that each group saw are reduced
to one row for each table, and that row reuses the shuffle of the groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..envelope import DELETES, UPSERTS

TOAST = "UnchangedToast"
#: Before every place in a log.
NEVER = -(1 << 63)


def _with_barrier(rows: DataFrame, truncated: DataFrame, tables: list[str] | None, seen: str) -> DataFrame:
    """``rows`` with ``_barrier``, the greatest value of ``seen`` in ``truncated`` for their table, ``NEVER`` without one."""
    last = F.coalesce(F.max(seen), F.lit(NEVER)).alias("_barrier")
    if not tables:
        return rows.crossJoin(truncated.agg(last))  # of exactly one row
    names = [f"_of_{t}" for t in tables]
    barrier = truncated.groupBy(*[F.col(t).alias(n) for t, n in zip(tables, names, strict=True)]).agg(last)
    on = reduce(lambda a, b: a & b, [rows[t].eqNullSafe(barrier[n]) for t, n in zip(tables, names, strict=True)])
    out = rows.join(barrier, on, "left").drop(*names)
    return out.withColumn("_barrier", F.coalesce("_barrier", F.lit(NEVER)))


def after_truncate(log: DataFrame, tables: list[str] | None = None, seq: str = "seq", op: str = "op") -> DataFrame:
    """Changes after the last truncate of their table (``tables`` names its key; none: one table)."""
    joined = _with_barrier(log, log.where(F.col(op) == "T"), tables, seq)
    return joined.where((F.col(op) != "T") & (F.col(seq) > F.col("_barrier"))).select(*log.columns)


def _grouping(key: list[str], tables: list[str] | None) -> list[str]:
    return [*(t for t in tables or () if t not in key), *key]


def sequential_fold(log: DataFrame, key: list[str], values: list[str], tables: list[str] | None = None, seq: str = "seq", op: str = "op") -> DataFrame:
    """State after all changes in order: the last one of each key wins, deletes remove it.

    With ``tables`` a log holds several tables; their columns come first in the
    result, and equal keys of two tables are two rows.
    """
    by = _grouping(key, tables)
    change = F.when(F.col(op) != "T", F.col(seq))
    groups = log.groupBy(*by).agg(
        F.max_by(F.struct(op, *values), change).alias("_last"), F.max(change).alias("_at"), F.max(F.when(F.col(op) == "T", F.col(seq))).alias("_truncated")
    )
    live = _with_barrier(groups, groups, tables, "_truncated").where((F.col("_at") > F.col("_barrier")) & (F.col("_last")[op] != "D"))
    return live.select(*by, *[F.col("_last")[v].alias(v) for v in values])


def delta_apply(log: DataFrame, key: list[str], values: list[str], batch: str = "batch_id", seq: str = "seq", op: str = "op", tables: list[str] | None = None) -> DataFrame:
    """State under equality deletes: a batch's deletes hit rows of earlier batches only.

    Batches are consecutive runs of the log, so a delete from before the last
    truncate hits nothing that comes after it.
    """
    by = _grouping(key, tables)
    groups = log.groupBy(*by).agg(F.max(F.when(F.col(op).isin(*DELETES), F.col(batch))).alias("_deleted"), F.max(F.when(F.col(op) == "T", F.col(seq))).alias("_truncated"))
    data = log.where(F.col(op).isin(*UPSERTS)).select(*dict.fromkeys([*by, *values, batch, seq]))
    joined = data.join(groups.select(*by, "_deleted"), by, "left").where(F.col("_deleted").isNull() | (F.col("_deleted") <= F.col(batch)))
    return _with_barrier(joined, groups, tables, "_truncated").where(F.col(seq) > F.col("_barrier")).select(*by, *values)


def with_key_changes(log: DataFrame, key: list[str], old_key: list[str], op: str = "op", policy: str = "delete_old") -> DataFrame:
    """Updates that change the key become a delete of the old key and the update.

    ``policy='upsert_only'`` leaves the log as it is.  Column ``part`` orders the
    two; an update without an old image keeps its key.
    """
    parted = log.withColumn("part", F.lit(1))
    if policy == "upsert_only":
        return parted
    changed = F.lit(False)
    for new, old in zip(key, old_key, strict=True):
        changed = changed | (F.col(old).isNotNull() & ~F.col(old).eqNullSafe(F.col(new)))
    gone = log.where((F.col(op) == "U") & changed)
    for new, old in zip(key, old_key, strict=True):
        gone = gone.withColumn(new, F.col(old))
    return parted.unionByName(gone.withColumn(op, F.lit("D")).withColumn("part", F.lit(0)))


def fold_with_toast(log: DataFrame, key: list[str], cells: list[str], policy: str = "carry", tables: list[str] | None = None, seq: str = "seq", op: str = "op") -> DataFrame:
    """Fold of a log with cell columns: an unchanged large value keeps the one before.

    A delete ends what can be carried; ``policy='null'`` writes null instead.  A
    cell's last known value counts if it is later than the last delete and the
    last truncate.
    """
    by = _grouping(key, tables)
    change = F.when(F.col(op) != "T", F.col(seq))
    known = {c: F.when(F.col(c)["type"] != TOAST, change) if policy == "carry" else change for c in cells}
    groups = log.groupBy(*by).agg(
        F.max(change).alias("_at"), F.max(F.when(F.col(op) == "D", F.col(seq))).alias("_died"), F.max(F.when(F.col(op) == "T", F.col(seq))).alias("_truncated"),
        *[F.max_by(F.struct(F.col(c).alias("cell"), F.col(seq).alias("at")), known[c]).alias(f"_known_{c}") for c in cells],
    )
    rows = _with_barrier(groups, groups, tables, "_truncated").withColumn("_floor", F.greatest("_barrier", F.coalesce("_died", F.lit(NEVER))))

    def value(c: str) -> Column:
        last = F.col(f"_known_{c}")
        return F.when((last["at"] > F.col("_floor")) & ~last["cell"]["type"].isin("Null", TOAST), last["cell"]["value"])

    return rows.where(F.col("_at") > F.col("_floor")).select(*by, *[value(c).alias(c) for c in cells])


def upsert(target: DataFrame, changes: DataFrame, key: list[str], seq: str) -> DataFrame:
    """``target`` with the last of ``changes`` for each key in place of its row."""
    values = [c for c in target.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*values), seq).alias("_last"))
    last = last.select(*key, *[F.col("_last")[v].alias(v) for v in values])
    if not values:
        return target.unionByName(changes.select(*key)).distinct()
    return target.join(last.select(*key), key, "left_anti").unionByName(last).select(*target.columns)


def delete_by_key(target: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return target.join(keys.select(*key).distinct(), key, "left_anti").select(*target.columns)


def delete_keys(log: DataFrame, key: list[str], old_key: list[str], op: str = "op") -> DataFrame:
    """Keys that deletes and updates remove: of the old image, or the new one without it."""
    hits = log.where(F.col(op).isin(*DELETES))
    pairs = zip(key, old_key, strict=True)
    return hits.select(*[F.coalesce(F.col(old), F.col(new)).alias(new) for new, old in pairs])


def op_class(op: Column) -> Column:
    return F.when(op == "T", "barrier").when(op == "U", "data+delete").when(op == "D", "delete").otherwise("data")
