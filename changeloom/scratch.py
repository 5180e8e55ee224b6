"""Folders for written tables that all machines share, and code for the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError

_roots: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own JVM."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and Spark is one process.

    It stays until ``release`` or the end of the process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not found:
        if not one_process(spark):
            raise ConfigError("set spark.checkpoint.dir to a folder that all machines share")
        if app not in _roots:
            _roots[app] = tempfile.mkdtemp(prefix="changeloom-")
        found = f"file://{_roots[app]}"
    if app not in _made:
        atexit.register(release, spark)
    made = f"{found.rstrip('/')}/{app}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(made)
    return made


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for what several branches of a plan read."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove the folders of the application; what still reads them ends."""
    context = spark.sparkContext
    for path in _made.pop(context.applicationId, []) if context._jsc else []:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before the interpreter does
            return


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="changeloom-code-")) / "changeloom-core.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, f"{top.name}/{p.relative_to(top)}")
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
