"""Session helpers shared by all operators: staging tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No broadcast is asked for above this many rows; beyond it the planner's shuffle join is used.
BROADCAST_ROWS = 200_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        with zipfile.ZipFile(path := Path(tempfile.mkdtemp(prefix="curveloom-")) / "curveloom.zip", "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(path))  # served by the driver


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session. Only in local mode a temporary one stands in where it is unset; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = kept.get() if kept.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="curveloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


class Stages:
    """Tables written to the shared folder to cut lineage.

    They are ordinary Parquet, so they outlive lost executors, are columnar, and give the planner true sizes.
    ``drop`` removes a table that no later step reads; what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base, self.n, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0, {}
        atexit.register(_delete, spark, self.base)

    def write(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n:03d}", self.n + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                _delete(self.spark, path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted rows stay under the limit."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
