"""The change event: one row of a log, typed cell by cell.

``seq`` is the total order of a log; LSNs are not unique (all rows of a
transaction share one), so nothing orders by them.  ``new`` and ``old`` map
column names to cells; an absent name, a null and an unchanged large value are
three different things.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<type:string,value:string>"
IMAGE = f"map<string,{CELL}>"
ENVELOPE = (
    "seq long, lsn long, timestamp_us long, xid long, schema string, table string, oid long, "
    f"op string, pk array<string>, new {IMAGE}, old {IMAGE}"
)

#: Operations and their codes.
OP_CODES = {"insert": "I", "update": "U", "delete": "D", "truncate": "T", "snapshot": "S"}
#: Names of the metadata columns of a flattened log, in order.
META = ["_cdc_op", "_cdc_lsn", "_cdc_timestamp_us", "_cdc_snapshot", "_cdc_schema", "_cdc_table", "_cdc_primary_key_columns"]
OLD = "_old_"
UPSERTS, DELETES = ("I", "U", "S"), ("D", "U")


def op_code(name: Column) -> Column:
    """Code of an operation's name."""
    out = F.lit(None).cast("string")
    for op, code in OP_CODES.items():
        out = F.when(F.lower(name) == op, code).otherwise(out)
    return out


def is_snapshot(op: Column) -> Column:
    return op == "S"


def cell(value: Column, kind: str) -> Column:
    """A typed cell; null values have the type Null."""
    tag = F.when(value.isNull(), "Null").otherwise(kind)
    return F.struct(tag.alias("type"), value.cast("string").alias("value"))


def image(cells: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, cells)), F.array(*cells.values()))


def no_image() -> Column:
    return F.lit(None).cast(IMAGE)


def envelope(df: DataFrame, table: str, pk: list[str], op: Column, new: Column, old: Column, *, schema: str = "public", oid: int = 0, **meta: Column) -> DataFrame:
    """Change events of a frame; ``meta`` gives seq, lsn, timestamp_us and xid."""
    zero = F.lit(0)
    fields = [meta.get(x, zero).cast("long").alias(x) for x in ("seq", "lsn", "timestamp_us", "xid")]
    keys = F.array(*map(F.lit, pk)) if pk else F.array().cast("array<string>")
    return df.select(
        *fields, F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(oid).cast("long").alias("oid"),
        op.alias("op"), keys.alias("pk"), new.alias("new"), old.alias("old"),
    )


def metadata(pk: Column | None = None) -> list[Column]:
    """The metadata columns of a flattened log."""
    keys = F.to_json(F.col("pk") if pk is None else pk)
    values = [F.col("op"), F.col("lsn"), F.col("timestamp_us"), is_snapshot(F.col("op")), F.col("schema"), F.col("table"), keys]
    return [v.alias(n) for v, n in zip(values, META, strict=True)]
