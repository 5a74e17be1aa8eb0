"""What a command tells while it runs: tasks done, rows and reject codes seen."""

from __future__ import annotations

import contextlib
import logging
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

log = logging.getLogger("lexiforge")


@contextlib.contextmanager
def told(spark: SparkSession, every: float = 10.0) -> Iterator[None]:
    """Logs the tasks of running stages every few seconds."""
    ended = threading.Event()
    tracker = spark.sparkContext.statusTracker()

    def run() -> None:
        while not ended.wait(every):
            for k in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(k):
                    log.info("stage %d (%s): %d of %d tasks done, %d running", k, info.name.split(" at ")[0], info.numCompletedTasks, info.numTasks, info.numActiveTasks)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()


def observed(df: DataFrame, name: str, codes: tuple[str, ...] = (), code: str = "code") -> tuple[DataFrame, Observation]:
    """df with counters that are filled when an action has run: rows, and rows of each code."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(code) == c).alias(c) for c in codes)), seen


class StreamLog(StreamingQueryListener):
    """Logs each batch of a stream. Register it with spark.streams.addListener()."""

    def __init__(self) -> None:
        self.rows = 0

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += p.numInputRows
        log.info("batch %d: %d rows in, %.0f a second, %d titles kept", p.batchId, p.numInputRows, p.processedRowsPerSecond or 0.0, sum(s.numRowsTotal for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")
