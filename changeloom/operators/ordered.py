"""Operations on the total order of a log, without gathering it in one task.

A log is cut into spans of ``span`` sequence numbers.  What a row needs from
before its span (a count, a last value) is one row for each span, accumulated
over the spans; the rest is a window inside the span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 100_000


def _spans(df: DataFrame, seq: str, span: int) -> DataFrame:
    return df.withColumn("_span", F.floor(F.col(seq) / span).cast("long"))


def positions(df: DataFrame, seq: str = "seq", name: str = "position", span: int = SPAN) -> DataFrame:
    """``df`` with the dense position (from 0) of each row in the order of ``seq``."""
    cut = _spans(df, seq, span)
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("_span").agg(F.count("*").alias("_n"))
    counts = counts.select("_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_span").orderBy(seq)) - 1
    return cut.withColumn("_inside", inside).join(counts, "_span").withColumn(name, F.col("_before") + F.col("_inside")).drop("_span", "_before", "_inside")


def last_known(df: DataFrame, value: Column, name: str, seq: str = "seq", by: list[str] | None = None, span: int = SPAN) -> DataFrame:
    """``df`` with the last value, at or before each row, that is not null (within ``by``)."""
    keys = by or []
    cut = _spans(df.withColumn("_value", value), seq, span)
    spans = cut.groupBy(*keys, "_span").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(seq))).alias("_end"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_span").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("_inside", inside).join(spans, [*keys, "_span"])
    return out.withColumn(name, F.coalesce("_inside", "_carry")).drop("_value", "_span", "_inside", "_carry")


def batches(df: DataFrame, size: int, seq: str = "seq", span: int = SPAN) -> DataFrame:
    """``df`` with ``batch``: runs of ``size`` rows in order."""
    return positions(df, seq, "_position", span).withColumn("batch", F.floor(F.col("_position") / size).cast("long")).drop("_position")


def transactions(df: DataFrame, xid: str = "xid", seq: str = "seq", op: str = "op") -> DataFrame:
    """One row for each transaction."""
    n = lambda code: F.count_if(F.col(op) == code)
    return df.groupBy(xid).agg(
        F.count("*").alias("events"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        n("I").alias("inserts"), n("U").alias("updates"), n("D").alias("deletes"), n("T").alias("truncates"),
    )
