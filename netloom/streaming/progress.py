"""Progress of running loads and streams, to be polled while they run."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query string, name string, event string, batch long, rows long, at string, error string"


class Progress(StreamingQueryListener):
    """Keeps the newest ``most`` events of a session's streams, from ``watch`` to ``close``.

    An event is started, progress (of a batch, with its input rows), idle, or ended, with the error that ended it. Events come
    a little later than what they tell.
    """

    def __init__(self, spark: SparkSession, most: int = 1000):
        self._spark, self._kept = spark, deque(maxlen=most)

    def watch(self) -> Progress:
        self._spark.streams.addListener(self)
        return self

    def close(self) -> None:
        self._spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._kept.append((str(event.id), event.name, "started", None, None, event.timestamp, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._kept.append((str(p.id), p.name, "progress", p.batchId, p.numInputRows, p.timestamp, None))

    def onQueryIdle(self, event) -> None:
        self._kept.append((str(event.id), None, "idle", None, None, event.timestamp, None))

    def onQueryTerminated(self, event) -> None:
        self._kept.append((str(event.id), None, "ended", None, None, None, event.exception))

    def events(self) -> DataFrame:
        """(query, name, event, batch, rows, at, error) in the order in which they came."""
        return self._spark.createDataFrame(list(self._kept), PROGRESS)
