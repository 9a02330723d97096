"""What streaming queries report of themselves, kept for each run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = (
    "run_id string, query string, batch_id bigint, input_rows bigint, dropped_by_watermark bigint"
)


class ProgressListener(StreamingQueryListener):
    """Input rows and rows dropped by the watermark of every micro-batch, as queries report them."""

    def __init__(self) -> None:
        self.run_id = f"STREAM_{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}
        self.batches: dict[tuple[str, int], tuple[int, int]] = {}
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        dropped = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        key = (str(progress.id), progress.batchId)
        # A query reports an idle batch under the number of the one to come.
        rows, before = self.batches.get(key, (0, 0))
        self.batches[key] = (max(rows, progress.numInputRows), max(before, dropped))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, query: StreamingQuery, name: str | None = None, seconds: float = 60) -> None:
        """Wait for the query, then for its last report, which comes on another thread."""
        ended = self._ended.setdefault(str(query.id), threading.Event())
        ended.clear()
        self.names[str(query.id)] = name or query.name or str(query.id)
        query.awaitTermination()
        ended.wait(seconds)

    def rows(self) -> list[tuple]:
        return [
            (self.run_id, self.names.get(query, query), batch, *counts)
            for (query, batch), counts in sorted(self.batches.items())
        ]


class _Untold:
    """Stands in where nobody asks for progress."""

    @staticmethod
    def wait(query: StreamingQuery, name: str | None = None) -> None:
        query.awaitTermination()


@contextmanager
def watched_progress(spark: SparkSession, path: str | None) -> Iterator[ProgressListener | _Untold]:
    """Appends the progress of the queries waited for inside to the table at ``path``."""
    if path is None:
        yield _Untold()
        return
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
        spark.createDataFrame(listener.rows(), PROGRESS).coalesce(1).write.mode("append").parquet(path)


def dropped_by_run(progress: DataFrame) -> DataFrame:
    """Rows read and rows dropped by the watermark, per run."""
    from pyspark.sql import functions as F

    return progress.groupBy("run_id").agg(
        F.sum("input_rows").alias("input_rows"),
        F.sum("dropped_by_watermark").alias("dropped_by_watermark"),
    )
