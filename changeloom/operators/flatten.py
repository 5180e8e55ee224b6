"""Images to columns: the flattened log and its projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..envelope import META, OLD, metadata
from ..errors import SchemaError
from ..functions.coerce import typed
from ..functions.values import typed_row_json


def flatten(log: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Metadata, source columns and their old values; ``columns`` maps names to canonical types."""
    bad = [c for c in columns if c in META or c.startswith((OLD, "_cdc_"))]
    if bad:
        raise SchemaError(f"columns collide with the log's own: {bad}")
    side = lambda image, prefix: [typed(F.col(image)[c], kind).alias(prefix + c) for c, kind in columns.items()]
    return log.select(*metadata(), *side("new", ""), *side("old", OLD))


def project(log: DataFrame, columns: dict[str, str], image: str = "new") -> DataFrame:
    """Typed columns of one image."""
    return log.select("seq", "op", *[typed(F.col(image)[c], kind).alias(c) for c, kind in columns.items()])


def fixed(log: DataFrame) -> DataFrame:
    """The fixed layout of seven columns with images as JSON; an empty key list is null."""
    return log.select(
        "op", "lsn", "timestamp_us", (F.col("op") == "S").alias("snapshot"),
        typed_row_json(F.col("new")).alias("row_new"), typed_row_json(F.col("old")).alias("row_old"),
        F.when(F.size("pk") > 0, F.to_json("pk")).alias("primary_key_columns"),
    )
