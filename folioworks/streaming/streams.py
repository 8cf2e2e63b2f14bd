"""The batch operators over arriving data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def stream_folder(spark: SparkSession, path: str, schema: StructType | None = None, per_trigger: int = 1000) -> DataFrame:
    """A landing folder as a stream: parquet of ``schema``, or any files as ``(path, modificationTime, length, content)``."""
    reader = spark.readStream.option("maxFilesPerTrigger", per_trigger)
    if schema is not None:
        return reader.schema(schema).parquet(path)
    return reader.format("binaryFile").load(path)


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a batch operator on every micro-batch and appends its result; each batch has a folder of its own that a retry replaces."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_CUTS = StructType([StructField("key", StringType()), StructField("start_at", DoubleType()), StructField("end_at", DoubleType())])
_STATE = StructType([StructField("last", DoubleType())])


def stream_cuts(stream: DataFrame, key: str, at: str, corr: str, min_gap: float = 1.5, threshold: float = 0.65) -> DataFrame:
    """The cuts of ``alignment.cut_intervals`` over samples that arrive in order: the last cut of each key is its state.

    A stream has no duration, so the interval after the last cut is not among them.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        out = []
        rows = pd.concat(list(batches)).sort_values([at, corr], kind="stable")
        for t, c in zip(rows[at], rows[corr], strict=True):
            if c < threshold and t - last >= min_gap:
                out.append((keys[0], last, t))
                last = float(t)
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "start_at", "end_at"])

    rows = stream.select(F.col(key).cast("string").alias(key), F.col(at).cast("double").alias(at), F.col(corr).cast("double").alias(corr))
    return rows.groupBy(key).applyInPandasWithState(step, _CUTS, _STATE, "append", GroupStateTimeout.NoTimeout)
