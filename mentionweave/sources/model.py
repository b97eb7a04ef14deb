"""Model calls as a pluggable step: names from passages, classes for residual names, and fetching of files.

The client is any picklable callable; the offline defaults are rules, so that results need no network.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.ids import confidence
from ..functions.names import keyword_filter, strip, text
from ..functions.text import one_of
from ..operators.sets import ensure_columns

_NAME = re.compile(r"\b(?:[A-Z][\w&'’.-]*\s+){0,4}(?:Inc|Corp|Corporation|Company|Co|Ltd|Limited|LLC|PLC|Group|Holdings|AG|SA|NV)\b\.?")


def names_by_rule(passage: str) -> list[str]:
    """Offline extractor: capitalised words that end in a legal form."""
    return [m.group(0).strip() for m in _NAME.finditer(passage)]


def retried(call: Callable, waits: tuple[float, ...] = (10, 20)) -> Callable:
    """The call again after each wait if it fails; the last failure is raised."""

    def run(x):
        for wait in waits:
            try:
                return call(x)
            except Exception:
                time.sleep(wait)
        return call(x)

    return run


def extract_names(passages: DataFrame, key: str, body: str, client: Callable[[str], list[str]] = names_by_rule) -> DataFrame:
    """Key, competitors (sorted, distinct, joined by bars), error: one call a passage, then one row a key."""
    kind = passages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for x in batch[body].to_pylist():
                try:
                    found.append(client(x or ""))
                    errors.append(None)
                except Exception as e:
                    found.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(found, pa.list_(pa.string())), pa.array(errors, pa.string())], [key, "found", "error"])

    rows = passages.select(key, body).mapInArrow(run, f"{key} {kind}, found array<string>, error string")
    names = rows.select(key, "error", F.explode_outer("found").alias("x")).groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("names"), F.max("error").alias("error"))
    return names.select(key, F.array_join("names", "|").alias("competitors"), "error")


def classify(residual: DataFrame, name: str, client: DataFrame | None = None) -> DataFrame:
    """Rules first; where they are silent, the answers of a model run (record_id, llm_classification, llm_decision), else `unclear`."""
    rows = residual.withColumn("__rule", keyword_filter(name))
    answers = client if client is not None else ensure_columns(residual.select("record_id").limit(0), ["llm_classification", "llm_decision"])
    joined = rows.join(answers.select("record_id", "llm_classification", "llm_decision"), "record_id", "left")
    kind = F.coalesce("__rule.kind", "llm_classification", F.lit("unclear"))
    decision = F.coalesce("__rule.decision", "llm_decision", F.lit("manual_review"))
    return joined.withColumns({"llm_classification": kind, "llm_decision": decision}).drop("__rule")


def normalized(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Every asked record with its answer brought into the schema; one that the model left out gets a row for review.

    `answers`: record_id and any of the model's fields, as text. Values outside an enumeration become its default, of several
    answers to a record the least in order counts, and whoever is unsure (confidence under 85) or undecided needs a manual check.
    """
    fields = ["llm_classification", "llm_decision", "llm_confidence", "llm_reason", "suggested_alias_name", "suggested_alias_scope", "suggested_alias_reason"]
    given = ensure_columns(answers, fields).select("record_id", F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("__a"))
    joined = asked.drop(*fields).join(given.groupBy("record_id").agg(F.min("__a").alias("__a")), "record_id", "left")
    said = lambda c: F.col(f"__a.{c}")
    missing = F.when(F.col("__a").isNull(), V.MISSING_ANSWER)
    out = joined.withColumns({
        "llm_classification": one_of(said("llm_classification"), V.CLASSES, "unclear"), "llm_decision": one_of(said("llm_decision"), V.DECISIONS, "manual_review"),
        "llm_confidence": confidence(said("llm_confidence")), "llm_reason": F.coalesce(missing, strip(text(said("llm_reason")))), "suggested_alias_name": strip(text(said("suggested_alias_name"))),
        "suggested_alias_scope": one_of(said("suggested_alias_scope"), V.ALIAS_SCOPES, "unclear"), "suggested_alias_reason": F.coalesce(missing, strip(text(said("suggested_alias_reason")))),
    })
    return out.withColumn("needs_manual_check", (F.col("llm_confidence") < 85) | (F.col("llm_decision") == "manual_review")).drop("__a")


def overlay(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Second-pass answers over the first where there are any; as many rows as before, as `second` is reduced to one a key."""
    one = second.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    out = first.join(one, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns})
    return out.drop(*[f"__{c}" for c in columns])


def status_of(failure: Exception) -> int | None:
    """The status that a failed call came back with, as clients of the usual libraries carry it."""
    held = (failure, getattr(failure, "response", None))
    return next((v for x in held for c in ("status_code", "code", "status") if isinstance(v := getattr(x, c, None), int)), None)


class Slots:
    """A rate that tasks share without talking to each other.

    Time is cut into slots of 1 / rate seconds from a fixed beginning, and task k of n may begin a call in every n-th slot alone, at
    most one a slot. However many of the tasks run at once, and whether one of them was started again, no more than `rate` calls
    begin in a second of a common clock; a machine whose clock is off by x seconds takes its slots x seconds off.
    """

    #: Of a slot's length, what a call may begin late without meeting the next slot's.
    LATE = 0.25

    def __init__(self, rate: float, task: int, tasks: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.length, self.task, self.tasks, self.clock, self.sleep = (1 + self.LATE) / rate, task, tasks, clock, sleep
        self.last = -1

    def wait(self) -> None:
        """Returns within the next slot of this task."""
        while True:
            now = self.clock()
            slot = max(int(now // self.length), self.last + 1)
            slot += (self.task - slot) % self.tasks
            begin = slot * self.length
            if begin > now:
                self.sleep(begin - now)
                now = self.clock()
            if now < begin + self.LATE * self.length:  # woken too late, the task waits for its next slot
                self.last = slot
                return
            self.last = max(self.last, slot - 1) if now < begin else slot


def fetch(links: DataFrame, url: str, client: Callable[[str], bytes], done: DataFrame | None = None, tasks: int = 8, rate: float = 10.0, busy: tuple[int, ...] = (503,), again: float = 1.0) -> DataFrame:
    """Url, content, error, status; links that are done are skipped.

    All tasks together begin at most `rate` calls a second. A call that comes back with a status of `busy` is made once more, in a slot of its
    own after `again` seconds; any other failure is the link's result.
    """
    left = links.select(url).distinct() if done is None else links.select(url).distinct().join(done.select(url), url, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(rate, TaskContext.get().partitionId() % tasks, tasks)

        def call(x: str) -> bytes:
            slots.wait()
            try:
                return client(x)
            except Exception as failure:
                if status_of(failure) not in busy:
                    raise
            time.sleep(again)
            slots.wait()
            return client(x)

        for batch in batches:
            for x in batch[url].to_pylist():
                try:
                    row = [x, call(x), None, None]
                except Exception as failure:
                    row = [x, None, f"{type(failure).__name__}: {failure}", status_of(failure)]
                kinds = (pa.string(), pa.binary(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [url, "content", "error", "status"])

    return left.repartition(tasks).mapInArrow(run, f"`{url}` string, content binary, error string, status int")
