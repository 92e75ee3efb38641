"""What running on a cluster needs: this package on the executors' Python path."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sieveworks_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="sieveworks-")) / "sieveworks.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(ROOT.rglob("*.py")):
            z.write(file, f"sieveworks/{file.relative_to(ROOT)}")
    context.addPyFile(str(path))
    context._sieveworks_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; one of our own only where that is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sieveworks-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, on files every executor can reach."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: While relations dealt by one column are joined: their places decide, each bucket is a task, and no side is collected by the driver.
_LOCAL = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Within, rows dealt by a column are not dealt anew for keys that hold this column."""
    before = {k: spark.conf.get(k, None) for k in _LOCAL}
    try:
        for k, v in _LOCAL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(df: DataFrame, name: str, by: str, parts: int, moved: bool = False, kinds: Sequence[str] = ()) -> DataFrame:
    """``saved``, in ``parts`` buckets by a column: what follows by this column, alone or among other keys, is not shuffled again.

    ``moved``: each task's rows are of few buckets already, though the plan may not tell; they are written where they are.
    ``kinds``: columns by which the files lie in folders of their own.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    with in_place(spark):
        (df if moved else df.repartition(parts, by)).write.partitionBy(*kinds).bucketBy(parts, by).option("path", f"{shared_dir(spark).rstrip('/')}/{table}").option("compression", "zstd").saveAsTable(table, format="parquet")
    return spark.table(table)
