"""Where derived tables, replay files and stream checkpoints are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str | None:
    """The shared folder of the cluster, `spark.checkpoint.dir`.

    Where it is unset, a temporary folder if Spark runs inside this one machine, else None.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        return None
    if sc.applicationId not in _local_root:
        _local_root[sc.applicationId] = tempfile.mkdtemp(prefix="tollway-")
    return _local_root[sc.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared root, for one run."""
    root = shared_root(spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{root}/tollway/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a folder of its own and read back, which cuts its lineage.

    A cluster without a shared folder is an error, here as for streams.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
