"""The record of a run: a row for every stage, part of a stage and micro-batch, appended to a table as each ends.

Rows and errors are counted by the work's own action (`DataFrame.observe`), so that nothing is computed twice for the record. What a stage still
needs is what its parts took so far, a part, times the parts that are left.
"""

from __future__ import annotations

import contextlib
import datetime
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, stage string, part string, rows long, errors long, seconds double, done long, total long, remaining_seconds double, failure string, at timestamp"
_METRICS = "run_log"


def _counts(error: str | None) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), (F.count_if(F.col(error).isNotNull()) if error else F.sum(F.lit(0).cast("long"))).alias("errors")]


class Stage:
    """What is counted of one stage or part; several tables of it are summed."""

    def __init__(self) -> None:
        self.observed: list[Observation] = []

    def watch(self, df: DataFrame, error: str | None = None) -> DataFrame:
        """`df`, whose rows, and those with something in the column `error`, are counted while an action of the stage reads them."""
        seen = Observation(f"{_METRICS}-{uuid.uuid4().hex}")
        self.observed.append(seen)
        return df.observe(seen, *_counts(error))

    def counted(self, wait: float = 30.0) -> tuple[int | None, int | None]:
        """(rows, errors), or nothing where no action read a watched table."""
        if not self.observed:
            return None, None
        pool = ThreadPoolExecutor(1)  # an observation that no action reads is waited for without end
        try:
            got = pool.submit(lambda: [o.get for o in self.observed]).result(wait)
        except TimeoutError:
            return None, None
        finally:
            pool.shutdown(wait=False)
        return sum(g["rows"] for g in got), sum(g["errors"] or 0 for g in got)


class RunLog:
    """A run's rows in the record at a path; other runs' rows stay beside them."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None) -> None:
        self.spark, self.path, self.run = spark, path, run or uuid.uuid4().hex

    def read(self) -> DataFrame:
        """All rows of all runs."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    @contextlib.contextmanager
    def stage(self, name: str, part: str = "", done: int = 1, total: int = 1, spent: float = 0.0) -> Iterator[Stage]:
        """Records what its body does: watch tables and run their actions in it. A failure is recorded and goes on.

        `done` counts the parts with this one, of `total`; `spent` is what the parts before took.
        """
        seen, began, failure = Stage(), time.monotonic(), None
        try:
            yield seen
        except BaseException as e:
            failure = f"{type(e).__name__}: {e}"[:2000]
            raise
        finally:
            seconds = time.monotonic() - began
            rows, errors = (None, None) if failure else seen.counted()
            left = (spent + seconds) / done * (total - done)
            self._append([(self.run, name, part, rows, errors, round(seconds, 3), done, total, round(left, 3), failure, datetime.datetime.now())])

    def each(self, name: str, parts: Iterable[str], work: Callable[[str, Stage], object], go_on: bool = False) -> list[str]:
        """`work(part, stage)` for each part, with a row and the remaining time after each; the parts that failed, where failures don't end it."""
        listed, failed, began = list(parts), [], time.monotonic()
        for done, part in enumerate(listed, 1):
            try:
                with self.stage(name, part, done, len(listed), time.monotonic() - began) as seen:
                    work(part, seen)
            except Exception:
                if not go_on:
                    raise
                failed.append(part)
        return failed

    def observed(self, stream: DataFrame, error: str | None = None) -> DataFrame:
        """A stream whose batches are counted for `follow`."""
        return stream.observe(_METRICS, *_counts(error))

    @contextlib.contextmanager
    def follow(self, name: str, wait: float = 60.0) -> Iterator[None]:
        """Records every micro-batch of the streaming queries that start in its body, and how each query ended; waits for those that end in it."""
        listener = _Batches(self, name)
        self.spark.streams.addListener(listener)
        try:
            yield
            listener.idle.wait(wait)
        finally:
            self.spark.streams.removeListener(listener)


class _Batches(StreamingQueryListener):
    def __init__(self, log: RunLog, name: str) -> None:
        self.log, self.name = log, name
        self.running: set[str] = set()
        self.idle = threading.Event()
        self.idle.set()

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.runId))
        self.idle.clear()

    def onQueryProgress(self, event) -> None:
        said = event.progress
        counts = said.observedMetrics.get(_METRICS)
        rows, errors = (counts["rows"], counts["errors"] or 0) if counts is not None else (said.numInputRows, None)
        self._record(f"batch {said.batchId}", rows, errors, said.batchDuration / 1000, None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._record("end", None, None, 0.0, event.exception[:2000])
        self.running.discard(str(event.runId))
        if not self.running:
            self.idle.set()

    def _record(self, part: str, rows: int | None, errors: int | None, seconds: float, failure: str | None) -> None:
        with contextlib.suppress(Exception):  # a record that can't be written does not end the query
            self.log._append([(self.log.run, self.name, part, rows, errors, seconds, None, None, None, failure, datetime.datetime.now())])
