"""What the corpus operators share: word classes, scratch tables, code shipping.

Scratch tables live under ``spark.checkpoint.dir`` of the session, which a
cluster shares between its machines.  Where that setting is absent and Spark runs
in one process (tests, a laptop) a temporary folder takes its place; on a cluster
its absence is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, and a word, as regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Bytes of an Arrow batch between Spark and Python, unless the session states its own.
ARROW_BYTES = 4 << 20
ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: With it, Spark removes the shuffle files of an execution when that ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()
_open: dict[str, list[Scratch]] = {}


def whole_text(name: str) -> Column:
    """The text column ``name`` with null read as the empty string."""
    return F.coalesce(F.col(quoted(name)), F.lit(""))


def quoted(name: str) -> str:
    """A column name that is safe in ``F.col`` whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, base: str) -> str:
    """A column name starting with ``base`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder for scratch tables, as a URI every machine can reach."""
    for get in (spark.conf.get, spark.sparkContext.getConf().get):
        found = get("spark.checkpoint.dir", None)
        if found:
            return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="changeloom-")
    return "file://" + _local_roots[app]


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one run of an operator.

    ``keep`` writes a frame as Parquet and returns it reread, which cuts its
    lineage: a lost executor costs the tasks it ran, not the steps before.
    ``drop`` removes a table that no later step reads.  What results read from
    stays until ``release(spark)`` or the end of the process.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.root = f"{shared_folder(spark)}/{app}/{label}-{uuid.uuid4().hex}"
        if app not in _open:
            atexit.register(release, spark)
        _open.setdefault(app, []).append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP_SETTING, None)
        conf.set(CLEANUP_SETTING, "true")  # nothing reads the shuffle files of this write again
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            conf.unset(CLEANUP_SETTING) if before is None else conf.set(CLEANUP_SETTING, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session may have ended before the interpreter does
            pass


def release(spark: SparkSession) -> None:
    """Remove the scratch tables of the application; results that still read them end."""
    for scratch in _open.pop(spark.sparkContext.applicationId if spark.sparkContext._jsc else "", []):
        scratch.close()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound Arrow batches by bytes."""
    if spark.conf.get(ARROW_SETTING, None) is None:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="changeloom-code-"), f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of the query modules."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
