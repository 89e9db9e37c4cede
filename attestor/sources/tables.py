"""Tables that are written once in the folder all executors share, and read back."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a local master may do without, in a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def written(df: DataFrame, name: str, into: list[str] | None = None, **options: str) -> DataFrame:
    """df as a table: what follows may read it several times, and a lost executor costs a reread, never a recomputation.

    The table goes when the driver ends, or when its path, which is added to `into`, is given to remove().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(remove, spark, path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job, all removed at its end: what is returned must not read them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __call__(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        return written(df, name, self.paths, **options)

    def sweep(self) -> None:
        """Lets the session drop the shuffle files of tables that are written: nothing reads them any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            remove(self.spark, path)
