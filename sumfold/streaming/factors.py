"""Factors over a stream: tumbling windows as a further variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.functions.semiring import Semiring


def windowed_factor(events: DataFrame, semiring: Semiring, variables: Sequence[str], value: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A factor over ``variables`` and ``window_start``, closed windows by and by.

    ``events`` is a stream (or a table); rows later than ``late`` are left out of closed windows.
    """
    timed = events.withWatermark(time, late) if events.isStreaming else events
    payload = [F.col(value).cast(semiring.types[0])]
    sums = [x.cast(t).alias(p) for x, t, p in zip(semiring.add(payload), semiring.types, semiring.payload)]
    grouped = timed.groupBy(F.window(time, window).alias("_window"), *variables).agg(*sums)
    return grouped.select(F.col("_window.start").alias("window_start"), *variables, *semiring.payload)


def run(stream: DataFrame, path: str) -> DataFrame:
    """What a factor over a stream comes to once all that the source has now is read; its batches are written under ``path``.

    Each batch writes the whole factor as it is then, under the batch's number, so that one that is repeated after a failure
    replaces its own output only. A later call with the same ``path`` goes on where the last one ended; if the source has nothing
    new there is no batch, and no rows are returned.
    """
    written = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number}")
        written.append(number)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/progress").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batches/{written[-1]}")
