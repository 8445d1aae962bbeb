"""Status logs, a JSON line per event: of streaming queries, and of runs that end, fail or are stopped by a signal."""

from __future__ import annotations

import contextlib
import json
import signal
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class StatusLog(StreamingQueryListener):
    """Appends progress of every streaming query of a session to a file of the driver."""

    def __init__(self, path: str):
        self.path = Path(path)

    def write(self, **row) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")

    def onQueryStarted(self, event) -> None:
        self.write(event="started", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.write(event="progress", id=str(p.id), batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write(event="failed" if event.exception else "completed", id=str(event.id))


def attach(spark: SparkSession, path: str) -> StatusLog:
    log = StatusLog(path)
    spark.streams.addListener(log)
    return log


class Stopped(RuntimeError):
    """A signal ended the run; what was appended to its log stays."""


class RunLog:
    """Events of one run (total, progress, completed, failed) and the seconds of its stages."""

    def __init__(self, path: str | None, mode: str = "run"):
        self.path, self.mode, self.began, self.stages = Path(path) if path else None, mode, time.monotonic(), {}

    def write(self, event: str, **row) -> None:
        if self.path:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps({"event": event, "mode": self.mode, "seconds": round(time.monotonic() - self.began, 3), **row}) + "\n")

    def progress(self, done: int, total: int) -> None:
        self.write("progress", done=done, total=total)

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.stages[name] = round(time.monotonic() - began, 3)

    @contextlib.contextmanager
    def running(self, total: int | None = None) -> Iterator[RunLog]:
        """The run itself: its end is logged whatever it is, and a signal to stop becomes an exception, so that what the run
        does on failure is done then too."""

        def stop(number, _frame):
            raise Stopped(signal.Signals(number).name)

        before = {n: signal.signal(n, stop) for n in (signal.SIGINT, signal.SIGTERM)}
        self.write("total", total=total)
        try:
            yield self
        except BaseException as e:
            self.write("failed", error=f"{type(e).__name__}: {e}")
            raise
        else:
            self.write("completed")
        finally:
            for n, f in before.items():
                signal.signal(n, f)
