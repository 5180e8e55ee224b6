"""A fold in parts: what each part of a log says of a key, merged in any order.

A part is a frame with one row for each key: the last change (``seq``, ``op``, the
values), ``died`` (the last delete) and, for each column that a change may leave
unchanged, the last value that is known with its place in the log.  Truncates are
rows without key.  Merging parts gives a part again and does not depend on their
order or grouping, so a stream only appends the parts of its batches; reading
merges them, and compaction replaces parts by their merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "T"
#: Before every place in a log.
NEVER = -(1 << 63)


def _at(column: str) -> str:
    return f"_at_{column}"


def part(log: DataFrame, key: list[str], values: list[str], carried: list[str] = (), unchanged: str | None = None, seq: str = "seq", op: str = "op") -> DataFrame:
    """The part of a log; ``unchanged`` is an array column with the ``carried`` columns that a row leaves as they are."""
    rows = log.select(F.col(seq).alias("seq"), F.col(op).alias("op"), *key, *values, *([unchanged] if carried else []))
    rows = rows.withColumn("died", F.when(F.col("op") == "D", F.col("seq")))
    for c in carried:
        left = F.coalesce(F.array_contains(unchanged, c), F.lit(False)) if unchanged else F.lit(False)
        rows = rows.withColumn(_at(c), F.when(~F.col("op").isin("D", MARK) & ~left, F.col("seq")))
    return merged(rows.drop(*([unchanged] if carried else [])), key, values, list(carried))


def merged(parts: DataFrame, key: list[str], values: list[str], carried: list[str] = ()) -> DataFrame:
    """One part from the rows of several: a row for each key after the last truncate, and that truncate."""
    plain = [v for v in values if v not in carried]
    change = F.when(F.col("op") != MARK, F.col("seq"))
    groups = parts.groupBy(*key).agg(
        F.max_by(F.struct("seq", "op", *plain), change).alias("_last"), F.max(F.when(F.col("op") == MARK, F.col("seq"))).alias("_mark"), F.max("died").alias("died"),
        *[F.max_by(F.struct(c, _at(c)), _at(c)).alias(f"_known_{c}") for c in carried],
    )
    barrier = groups.agg(F.max("_mark").alias("_barrier"))
    floor = F.coalesce("_barrier", F.lit(NEVER))
    live = groups.crossJoin(barrier).where(F.col("_last")["seq"] > floor)  # the barrier is exactly one row
    after = lambda c: F.col(f"_known_{c}")[_at(c)] > F.greatest(floor, F.coalesce("died", F.lit(NEVER)))
    rows = live.select(
        F.col("_last")["seq"].alias("seq"), F.col("_last")["op"].alias("op"), *key,
        *[F.when(after(c), F.col(f"_known_{c}")[c]).alias(c) if c in carried else F.col("_last")[c].alias(c) for c in values],
        F.when(F.col("died") > floor, F.col("died")).alias("died"), *[F.when(after(c), F.col(f"_known_{c}")[_at(c)]).alias(_at(c)) for c in carried],
    )
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[2:]]
    return rows.unionByName(barrier.where("_barrier is not null").select(F.col("_barrier").alias("seq"), F.lit(MARK).alias("op"), *empty))


def current(parts: DataFrame, key: list[str], values: list[str], carried: list[str] = ()) -> DataFrame:
    """The rows of the table that some parts describe."""
    return merged(parts, key, values, carried).where(~F.col("op").isin("D", MARK)).select(*key, *values)
