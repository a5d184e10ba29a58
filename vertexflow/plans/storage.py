"""Where intermediate results go: the shared folder that the cluster names, never a machine's own.

Everything is written below one folder of the application, which goes when the application ends; what an operator needs no
longer goes at once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The value of spark.checkpoint.dir or the context's checkpoint folder. Where neither is set, a new temporary folder on
    a local master, an error on any other: its executors would not share the driver's folders."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vertexflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, kind: str) -> str:
    """An unused path below the application's folder, which is deleted at its end."""
    root = f"{shared_folder(spark)}/vertexflow-{spark.sparkContext.applicationId}"
    files, where = _files(spark, root)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{root}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: lineage ends there, and the planner knows the sizes.

    A checkpoint would keep the estimate of its plan, which multiplies from superstep to superstep."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a bucket of their own.
BUCKET_ROWS = 1 << 16


def bucket_count(spark: SparkSession, rows: int) -> int:
    """As many as there are shuffle partitions, fewer where the rows would not fill them."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS))


class Bucketed:
    """Rows stored in n hash buckets of one column: joins and aggregations by that column read them without a shuffle where n
    is the number of shuffle partitions. `drop` removes table and files. path: an unused folder, a new one where none is given."""

    def __init__(self, df: DataFrame, by: str, n: int, path: str | None = None) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, "bucketed") if path is None else path
        self.name = f"vertexflow_{uuid.uuid4().hex}"
        df.write.bucketBy(n, by).option("path", self.path).saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)
