"""Resumable processing of growing inputs: what is done is read from the output, the rest is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.purge import todo
from ..sources.readers import _present
from ..sources.writers import append_rows


def done_so_far(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    return spark.read.parquet(path).select(*keys) if _present(spark, f"{path}/*.parquet") else None


def process_rest(df: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> None:
    """Runs `work` on the rows whose keys are not in the output yet, and appends what it returns. A second
    call after a failure goes on with what is left."""
    done = done_so_far(df.sparkSession, path, keys)
    append_rows(work(df if done is None else todo(df, done, keys)), path)


def process_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]):
    """The same for a stream: every micro-batch is checked against the output, so a batch that is replayed
    after a failure is not processed twice. Repeated keys within a batch are processed once."""
    def batch(df: DataFrame, _: int) -> None:
        process_rest(df.dropDuplicates(keys), path, keys, work)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
