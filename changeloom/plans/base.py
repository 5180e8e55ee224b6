"""The change log that the queries share, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..envelope import cell, envelope, image, no_image

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The change log in SQL: event_id is the sequence, ten events a transaction, users the key.
LOG = """
with cl as (
  select event_id as seq, event_id // 10 as xid, event_id // 100 as batch_id,
         case when event_id % 4000 = 3999 then 'T' when event_type = 'error' then 'D' when event_type = 'signup' then 'I' else 'U' end as op,
         user_id, event_type, value, lag(value) over (partition by user_id order by event_id) as old_value, ts, props
  from events)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("LOG", LOG.strip(), 1) if sql.lstrip().startswith("LOG") else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of ``events`` as typed columns."""
    e, seq = table(spark, sf_dir, "events"), F.col("event_id")
    op = F.when(seq % 4000 == 3999, "T").when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    old = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    number = lambda n: F.floor(seq / n).cast("long")
    return e.select(seq.alias("seq"), number(10).alias("xid"), number(100).alias("batch_id"), op.alias("op"), "user_id", "event_type", "value", old.alias("old_value"), "ts", "props")


COLUMNS = {"user_id": "BigInt", "event_type": "Text", "value": "Double"}


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in the envelope's layout."""
    log = change_log(spark, sf_dir)
    new = image({"user_id": cell(F.col("user_id"), "Int"), "event_type": cell(F.col("event_type"), "Text"), "value": cell(F.col("value"), "Float")})
    old = image({"user_id": cell(F.col("user_id"), "Int"), "value": cell(F.col("old_value"), "Float")})
    op = F.col("op")
    return envelope(
        log, "events", ["user_id"], op, F.when(op.isin("I", "U"), new).otherwise(no_image()), F.when(op.isin("U", "D"), old).otherwise(no_image()),
        oid=16384, seq=F.col("seq"), lsn=F.col("xid") * 256, timestamp_us=F.unix_micros(F.col("ts").cast("timestamp")), xid=F.col("xid"),
    )


def rows(spark: SparkSession, schema: str, *values) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(list(values), schema)
