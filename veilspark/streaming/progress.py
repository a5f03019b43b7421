"""Progress of streaming runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Reports, after each micro-batch, the rows taken so far and per second. Register it with ``spark.streams.addListener``."""

    def __init__(self, report: Callable[[str], None] = print):
        self.report, self.rows = report, 0

    def onQueryStarted(self, event) -> None:
        self.report(f"started {event.id}")

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.report(f"{self.rows} rows, {event.progress.processedRowsPerSecond or 0:.0f} a second")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report(f"ended after {self.rows} rows" + (f": {event.exception}" if event.exception else ""))
