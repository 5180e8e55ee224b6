"""Change logs as files: a Parquet stream in the envelope's layout, and a data source.

``ChangeLogSource`` registers the format ``changelog``: NDJSON files named by
their order, read as a batch (all files) or as a stream whose offset is the last
file taken; a file is committed only once its batch is.  Folders are paths or URIs
(``sources.files``) that all machines can open; a file is parsed by Arrow, and
fields that the schema does not have are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import json as arrow_json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import files

FIELDS = "seq long, xid long, batch_id long, op string, key long, kind string, value double"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; arrival order is not log order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class _File(InputPartition):
    def __init__(self, top: str, name: str):
        self.top, self.name = top, name


class _Files:
    def __init__(self, schema, options):
        self.schema, self.top = schema, options["path"]

    def files(self) -> list[str]:
        return files.names(self.top, ".json")

    def read(self, part: _File):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = pa.schema([(f.name, f.type) for f in to_arrow_schema(self.schema)])
        options = arrow_json.ParseOptions(explicit_schema=shape, unexpected_field_behavior="ignore")
        with files.opened(part.top, part.name) as f:
            raw = f.read()
        if raw.strip():
            yield from arrow_json.read_json(pa.BufferReader(raw), parse_options=options).select(shape.names).to_batches()

    def parts(self, names):
        return [_File(self.top, n) for n in names]


class _Batch(_Files, DataSourceReader):
    def partitions(self):
        return self.parts(self.files())


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self):  # noqa: N802
        return {"after": ""}

    def latestOffset(self):  # noqa: N802
        return {"after": (self.files() or [""])[-1]}

    def partitions(self, start, end):
        return self.parts([f for f in self.files() if start["after"] < f <= end["after"]])

    def commit(self, end):
        """Everything up to ``end`` has reached the sink; files need no word of it."""


class ChangeLogSource(DataSource):
    @classmethod
    def name(cls):
        return "changelog"

    def schema(self):
        return self.options.get("fields", FIELDS)

    def reader(self, schema):
        return _Batch(schema, self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(schema, self.options)
