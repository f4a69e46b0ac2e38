"""What the operators of this folder share: kept tables, word classes, table reading."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
# ASCII white space, as the character class of a regular expression and as characters.
BLANKS_CLASS = r"[\x20\x09-\x0D]"
BLANKS = "\t\n\x0b\x0c\r "


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor reaches; a local session without the setting uses its warehouse."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/shared"
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    The files survive a lost executor and go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def drop_kept(df: DataFrame) -> None:
    """Remove a kept table that nothing will read again."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def partitions(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Enough partitions for ``rows_per_task`` rows each, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
