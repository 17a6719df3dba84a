"""Session helpers: code shipping and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="code")) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables written in the shared folder so that a lost executor costs no recomputation.

    ``table`` writes a DataFrame and reads it again; ``drop`` removes tables that
    no result reads any more. The shuffle files of a write go when it ends: left to the
    driver's garbage collection, those of all steps would lie on disk at once. ``conf`` holds
    for the writes only.
    """

    def __init__(self, spark: SparkSession, name: str, conf: dict[str, str] | None = None):
        self.spark = spark
        self.conf = {CLEANUP: "true"} | (conf or {})
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
        """The rows as read back; without dictionary the writer does not try one, for columns of values that hardly repeat."""
        conf = self.spark.conf
        before = {k: conf.get(k) for k in self.conf}
        for k, v in self.conf.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(self.at(name))
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.at(name))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
