"""Written tables that cut a plan's lineage, and joins and folders that hold at scale.

Staged tables go to the folder in ``spark.checkpoint.dir``, which every executor sees, so a lost executor costs a
re-read and not a recomputation. Only where that setting is absent and all runs on one machine (tests, a laptop) a
temporary folder stands in; a cluster without it is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 512

_local_root: str | None = None


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a temporary one where none is set and the executors run here."""
    global _local_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if _local_root is None:
        folder = tempfile.mkdtemp(prefix="strandframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_root = "file://" + folder
    return _local_root


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, besides their own path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def small_batches(spark: SparkSession) -> None:
    """Batches of whole texts hold few rows, so that a run of very long texts does not fill a worker's memory."""
    importable(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS)),):
        if spark.conf.get(key, None) in (None, "10000"):
            spark.conf.set(key, value)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as one of its own."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Staging:
    """Written tables of one operator call. ``drop`` removes a table that a later one has replaced; the rest go when the JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{staging_root(spark)}/strandframe-{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self._kept: list[DataFrame] = []
        fs, p = file_system(spark, self.root)
        fs.deleteOnExit(p)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._kept.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        if path := self.paths.get(id(df)):
            fs, p = file_system(self.spark, path)
            fs.delete(p, True)


def hot_above(spark: SparkSession, rows: int) -> int:
    """Rows of one key beyond which it is hot. So there are at most four hot keys a shuffle partition."""
    return max(64, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_hot(left: DataFrame, right: DataFrame, key: list[str], hot: int) -> DataFrame:
    """Inner join with right, whose keys are unique and whose column n counts their rows in left; it gives no column n.

    Rows of hot keys (n above hot) stay where they are: what right says of these keys is little and goes to them.
    """
    values = [c for c in right.columns if c not in (*key, "n")]
    sent = right.filter(F.col("n") > hot).select(*key, F.struct(*(F.col(c).alias(c) for c in values)).alias("hot_values"))
    marked = left.join(F.broadcast(sent), key, "left")
    rest = marked.filter("hot_values is null").drop("hot_values").join(right.filter(F.col("n") <= hot).drop("n"), key)
    return marked.filter("hot_values is not null").select(*left.columns, "hot_values.*").unionByName(rest)
