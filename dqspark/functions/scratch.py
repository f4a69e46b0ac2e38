"""Where a run may keep files that every executor must reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared one, which goes when the application ends.

    Only a session on one machine may do without the setting; it uses its warehouse.
    """
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # What is not there yet cannot be marked for deletion.
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/data"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The table, written once and read back: later passes do not make it again."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
