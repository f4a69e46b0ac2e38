"""The feedback rules on a stream.

How many rows of a dataset have been taken is keyed state, so a batch looks up only
the datasets it brings.  The running count over all datasets is one number that each
batch leaves for the next.  Everything a batch stores lies in a folder named after its
id: a batch that is replayed after a failure starts from the state before it and
overwrites its own folders, so each row is taken, and each full batch of feedback
fires, exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dqspark.functions.ordering import row_positions
from dqspark.operators import clean as K, feedback as L

FEEDBACK_SCHEMA = (
    "id BIGINT, dataset_hash STRING, predicted_score DOUBLE, actual_label INT, "
    "features ARRAY<DOUBLE>, ts TIMESTAMP"
)
BATCH = "batch_id"
ARRIVAL = ["ts", "id"]


def capped(stream: DataFrame, limit: int = L.PER_DATASET) -> DataFrame:
    """The first ``limit`` accepted rows of each dataset, in order of arrival, as they arrive.

    The state of a dataset is the number of its rows taken so far.  Each task passes on
    at most ``limit`` rows of a dataset per Arrow batch, so one that sends a third of
    all feedback does not send it to one task.  Rows without an id are not taken.
    """
    def first(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks:
            yield rows.sort_values(ARRIVAL).groupby("dataset_hash", dropna=False, sort=False).head(limit)

    def take(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = state.get[0] if state.exists else 0
        best = None
        for rows in chunks:
            best = pd.concat([rows] if best is None else [best, rows]).sort_values(ARRIVAL).head(limit - taken)
        if best is None or not len(best):
            return
        state.update((taken + len(best),))
        yield best

    accepted = L.gate(stream).where("accepted AND id IS NOT NULL").drop("accepted", "reason")
    return accepted.mapInPandas(first, accepted.schema).groupBy("dataset_hash").applyInPandasWithState(
        take, accepted.schema, "taken LONG", "append", GroupStateTimeout.NoTimeout)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What stands at a path; an empty table where nothing has been written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def store_batch(fresh: DataFrame, batch_id: int, path: str, every: int = L.RETRAIN_EVERY) -> list[int]:
    """Store a batch of taken rows and the counts it fires at; returns those that were not fired before.

    Folders below ``path``: ``rows``, ``retrains`` (the rows that fill a batch of
    feedback, with the count there) and ``totals`` (one row, written last).
    """
    spark = fresh.sparkSession
    own = f"{BATCH}={batch_id}"
    fresh.write.mode("overwrite").parquet(f"{path}/rows/{own}")
    rows = spark.read.schema(fresh.schema).parquet(f"{path}/rows/{own}")
    done = _stored(spark, f"{path}/totals/{own}", "total LONG").first() is not None
    before = _stored(spark, f"{path}/totals/{BATCH}={batch_id - 1}", "total LONG").first()
    base = before.total if before else 0
    placed = row_positions(rows, "id", "place")
    count = (F.col("place") + 1 + base).alias("feedback_count")
    fired = placed.select("id", count).where(L.triggers(F.col("feedback_count"), every))
    fired.write.mode("overwrite").parquet(f"{path}/retrains/{own}")
    kept = spark.read.schema(fired.schema).parquet(f"{path}/retrains/{own}")
    return [] if done else sorted(r.feedback_count for r in kept.collect())


def close_batch(spark: SparkSession, batch_id: int, path: str) -> None:
    """Leave the running count for the next batch; it says that this batch has been handled."""
    before = _stored(spark, f"{path}/totals/{BATCH}={batch_id - 1}", "total LONG").first()
    taken = spark.read.parquet(f"{path}/rows/{BATCH}={batch_id}").count()
    spark.createDataFrame([((before.total if before else 0) + taken,)], "total LONG").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/totals/{BATCH}={batch_id}")


def feedback_intake(stream: DataFrame, path: str, checkpoint: str, *,
                    limit: int = L.PER_DATASET, every: int = L.RETRAIN_EVERY,
                    on_retrain: Callable[[int], None] | None = None) -> DataStreamWriter:
    """Writer that stores gated, capped feedback and fires once per ``every`` rows stored.

    ``on_retrain`` gets each count; it is called before the batch is closed, so a
    failure inside it replays the batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        fired = store_batch(batch, batch_id, path, every)
        if on_retrain is not None:
            for count in fired:
                on_retrain(count)
        close_batch(batch.sparkSession, batch_id, path)

    return capped(stream, limit).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def taken_rows(spark: SparkSession, path: str) -> DataFrame:
    """``FEEDBACK_SCHEMA`` and the batch of every row taken."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def retrain_points(spark: SparkSession, path: str) -> DataFrame:
    """``id, feedback_count``: the taken rows that fill a batch of feedback, and the batch they came in."""
    return spark.read.option("basePath", f"{path}/retrains").parquet(f"{path}/retrains")


def clean_stream(stream: DataFrame, plan: K.CleaningPlan, *, event_time: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """Apply a fitted plan to arriving rows.

    The plan is a projection and a filter.  With ``event_time`` a row that repeats
    another but for its row id is dropped if it arrives within the delay, and so is a
    row older than the watermark (the newest time seen by earlier batches, less the
    delay); state older than that is freed.
    """
    out = K.transform(stream, plan, drop_copies=False)
    if event_time is None:
        return out
    data = [c for c in out.columns if c != plan.row_id]
    return out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(data)
