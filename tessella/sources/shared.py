"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written_once(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again, for what many plans read: it is computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over as many tasks as shuffles have, by keys. To scan a page, or to check a text, costs far more than the bytes tell
    by which a file is split and adaptive plans put what comes from a join into few tasks; a number that is asked for they leave."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """written_once(), with `n`, its number of rows, and further aggregates of its rows, all taken in the pass that writes."""
    seen = Observation(name)
    out = written_once(df.observe(seen, F.count(F.lit(1)).alias("n"), *(m.alias(k) for k, m in metrics.items())), name)
    return out, seen.get


def dropped(df: DataFrame) -> None:
    """Deletes the files that df, a table of written_once(), is read from, once nothing that is still to run reads them."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
