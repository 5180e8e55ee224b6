"""A lake table: immutable Parquet files under a log of commits.

A version is a JSON file ``_log/{n}.json`` naming data folders and delete
folders with their sequence numbers, the schema and a summary.  A commit writes
its version to a temporary file and moves it to its name only if nobody else has
taken that; so a version is there as a whole or not at all, and the loser raises
and may try again.  That move is atomic in local file systems (a hard link) and in
those whose rename does not overwrite (HDFS and its like); in object stores
without one, a table may have one writer.

A commit may carry the id ``name:number`` of the streaming batch it holds.
Numbers of one name ascend, the highest is kept for each name, and a number up to
it is never committed again.  Deletes hit rows of smaller sequence numbers, as
equality deletes do.  Folders carry their sequence number in their name, so a
read is one scan of all data and one of all deletes, however many commits there
are; ``compact`` replaces them by one folder, ``expire`` removes what only old
versions need.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, LakeError
from ..operators.ordered import positions

#: Rows of one data file; rows that one task gets at least, where files are to be full.
FILE_ROWS, TASK_ROWS = 5_000_000, 50_000
_EMPTY = {"version": -1, "data": [], "deletes": [], "schema": None, "key": [], "done": {}, "operation": None}


def _batch_number(batch: str) -> tuple[str, int]:
    name, _, number = batch.rpartition(":")
    return (name, int(number)) if name and number.isdigit() else (batch, 0)


class LakeTable:
    def __init__(self, spark: SparkSession, path: str, file_rows: int = FILE_ROWS):
        self.spark, self.path, self.file_rows = spark, path.rstrip("/"), file_rows
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # the log

    def _names(self, folder: str) -> list[str]:
        top = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_log") if re.fullmatch(r"\d+\.json", n))

    def state(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else -1
        if version < 0:
            return dict(_EMPTY)
        if version not in known:
            raise LakeError(f"no version {version}")
        stream = self._fs.open(self._path(f"{self.path}/_log/{version:08d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _move(self, source: str, target: str) -> None:
        """Give a file its name; fails if the name is taken."""
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            local = [unquote(urlparse(x).path) for x in (source, target)]
            os.link(*local)
            self._fs.delete(self._path(source), False)
            return
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context.rename(self._path(source), self._path(target), options)

    def _commit(self, state: dict, operation: str, batch: str | None, added: dict | None = None, **changes) -> dict:
        new = state | changes | {"version": state["version"] + 1, "operation": operation, "at": time.time()}
        if batch is not None:
            name, number = _batch_number(batch)
            new["done"] = state["done"] | {name: max(number, state["done"].get(name, -1))}
        new["summary"] = {"data-folders": len(new["data"]), "delete-folders": len(new["deletes"])} | (added or {})
        temporary = f"{self.path}/_log/_{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(temporary), False)
        try:
            out.write(json.dumps(new).encode())
        finally:
            out.close()
        try:
            self._move(temporary, f"{self.path}/_log/{new['version']:08d}.json")
        except Exception as e:
            self._fs.delete(self._path(temporary), False)
            raise LakeError(f"version {new['version']} was committed by another writer") from e
        return new

    def _write(self, df: DataFrame, kind: str, number: int) -> tuple[str, dict]:
        """A folder's name, and how many files and rows it has."""
        name = f"{kind}/cdc-{kind}-{number:010d}-{uuid.uuid4().hex}"
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("maxRecordsPerFile", self.file_rows).parquet(f"{self.path}/{name}")
        files = self._count(f"{self.path}/{name}")
        return name, {"files": files, "rows": rows.get["n"] if files else 0}

    def _count(self, folder: str) -> int:
        """How many data files a folder has; one call, however many there are."""
        marker = self._fs.exists(self._path(f"{folder}/_SUCCESS"))
        return self._fs.getContentSummary(self._path(folder)).getFileCount() - marker

    def _filled(self, df: DataFrame, order: str) -> DataFrame:
        """``df`` dealt to tasks by blocks of whole files, so that all files but the last are full."""
        block = self.file_rows * max(1, TASK_ROWS // self.file_rows)
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        placed = positions(df, order, "_place").withColumn("_task", (F.floor(F.col("_place") / block) % parts).cast("int"))
        return placed.repartitionById(parts, "_task").sortWithinPartitions("_place").select(*[f"`{c}`" for c in df.columns])

    def seen(self, batch: str | None, state: dict | None = None) -> bool:
        if batch is None:
            return False
        name, number = _batch_number(batch)
        return number <= (state or self.state())["done"].get(name, -1)

    # writing

    def create(self, schema: T.StructType, key: list[str] | None = None) -> dict:
        return self._commit(self.state(), "create", None, schema=json.loads(schema.json()), key=key or [])

    def ensure(self, schema: T.StructType, key: list[str] | None = None, replicated: bool = False) -> dict:
        """The current state of the table, which is created if it is not there; replication needs a key."""
        if replicated and not key:
            raise ConfigError("replication needs a primary key")
        state = self.state()
        if state["version"] >= 0:
            return state
        try:
            return self.create(schema, key)
        except LakeError:
            return self.state()  # another writer was first

    def append(self, df: DataFrame, batch: str | None = None, order: str | None = None) -> dict:
        """Rows in one version.  With ``order``, a column of whole numbers, they follow each other so in files that are all full but the last."""
        state = self.state()
        if self.seen(batch, state):
            return state
        number = state["version"] + 1
        name, n = self._write(self._filled(df, order) if order else df, "data", number)
        schema = state["schema"] or json.loads(df.schema.json())
        return self._commit(state, "append", batch, {"added-data-files": n["files"], "added-records": n["rows"]}, schema=schema, data=[*state["data"], [name, number]])

    def row_delta(self, data: DataFrame, deletes: DataFrame, batch: str | None = None) -> dict:
        """Data and key deletes in one version; the deletes hit earlier versions only."""
        state = self.state()
        if self.seen(batch, state):
            return state
        number = state["version"] + 1
        gone, g = self._write(deletes.select(*state["key"]).distinct(), "delete", number)
        name, n = self._write(data, "data", number)
        added = {"added-data-files": n["files"], "added-records": n["rows"], "added-delete-files": g["files"], "added-equality-deletes": g["rows"]}
        return self._commit(state, "overwrite", batch, added, data=[*state["data"], [name, number]], deletes=[*state["deletes"], [gone, number]])

    def truncate(self, batch: str | None = None) -> dict:
        """A version without rows; earlier versions stay readable."""
        return self._commit(self.state(), "delete", batch, data=[], deletes=[])

    def overwrite(self, df: DataFrame, batch: str | None = None, operation: str = "overwrite", schema: T.StructType | None = None) -> dict:
        """All rows replaced by those of ``df``, which may read the table; the table's schema becomes ``schema`` or that of ``df``."""
        state = self.state()
        if self.seen(batch, state):
            return state
        number = state["version"] + 1
        name, n = self._write(df, "data", number)
        added = {"added-data-files": n["files"], "added-records": n["rows"]}
        return self._commit(state, operation, batch, added, schema=json.loads((schema or df.schema).json()), data=[[name, number]], deletes=[])

    def compact(self, df: DataFrame | None = None) -> dict:
        """The same rows in one folder without deletes; ``df`` is what the rows stand for, if not themselves."""
        schema = self.schema()
        rows = (self.read() if df is None else df).select(*[f"`{f.name}`" for f in schema])
        return self.overwrite(rows, operation="replace", schema=schema)

    def expire(self, keep: int = 1) -> list[str]:
        """Remove all versions but the last ``keep``, and the folders that none of those names."""
        versions = self.versions()
        kept = [self.state(v) for v in versions[-keep:]]
        if not kept:
            return []
        used = {name for s in kept for name, _ in s["data"] + s["deletes"]}
        newest = max(s["version"] for s in kept)
        gone = []
        for kind in ("data", "delete"):
            for n in self._names(kind):
                # folders of writers that have not committed yet have greater numbers
                if f"{kind}/{n}" not in used and int(n.split("-")[2]) <= newest:
                    gone.append(f"{kind}/{n}")
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_log/{v:08d}.json"), False)
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone

    def evolve(self, schema: T.StructType, expected: int) -> dict:
        state = self.state()
        if state["version"] != expected:
            raise LakeError(f"version {state['version']} is current, not {expected}")
        return self._commit(state, "evolve", None, schema=json.loads(schema.json()))

    # reading

    def schema(self, version: int | None = None) -> T.StructType:
        found = self.state(version)["schema"]
        return T.StructType.fromJson(found) if found else T.StructType()

    def _scan(self, schema: T.StructType, folders: list, number: str) -> DataFrame:
        """One scan of some folders; columns that a file lacks are null."""
        optional = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
        frame = self.spark.read.schema(optional).parquet(*[f"{self.path}/{name}" for name, _ in folders])
        at = F.regexp_extract("_metadata.file_path", r"/cdc-(?:data|delete)-(\d+)-[0-9a-f]+/", 1).cast("long")
        return frame.select(*[f"`{f.name}`" for f in schema], at.alias(number))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version: data that no later delete hits."""
        state = self.state(version)
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType()
        if not state["data"]:
            return self.spark.createDataFrame([], schema)
        frame = self._scan(schema, state["data"], "_number")
        first = min(number for _, number in state["data"])
        deletes = [d for d in state["deletes"] if d[1] > first]
        if deletes:
            keys = T.StructType([f for f in schema if f.name in state["key"]])
            gone = self._scan(keys, deletes, "_deleted").groupBy(*state["key"]).agg(F.max("_deleted").alias("_deleted"))
            frame = frame.join(gone, state["key"], "left").where(F.col("_deleted").isNull() | (F.col("_deleted") <= F.col("_number")))
        return frame.select(*[f"`{f.name}`" for f in schema])
