"""Resumable scoring: a stream over a directory, appended exactly once a batch.

The checkpoint holds how far a run came; a new identity (inputs, model, settings) is a new run with a
checkpoint of its own. A batch is written under its number, so a repeated batch replaces itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def run_identity(parts: Mapping[str, object]) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def score_stream(spark: SparkSession, source: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, identity: Mapping[str, object], files_a_batch: int = 8) -> StreamingQuery:
    """Scores the files of source that a run has not seen and stops; score is a column pipeline, as in batch."""
    run = run_identity(identity)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/{run}").trigger(availableNow=True).start()


def gaps(stored: DataFrame, by: str = "run", position: str = "position") -> DataFrame:
    """(run, rows, last): runs whose positions are not 0, 1, 2 .. without gap or repeat."""
    per = stored.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct(position).alias("distinct"), F.max(position).alias("last"))
    return per.where("rows <> distinct or last + 1 <> rows").select(by, "rows", "last")


def checked_rows(stored: DataFrame, payload: str = "payload", digest: str = "sha256") -> DataFrame:
    """Stored rows whose payload no longer has its checksum."""
    return stored.where(~(F.sha2(payload, 256).eqNullSafe(F.col(digest))))


def windowed_counts(stream: DataFrame, time: str, late: str = "1 hour", size: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts over event-time windows with a watermark; works on batch and stream alike (our extension)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))
