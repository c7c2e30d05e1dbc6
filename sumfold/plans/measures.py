"""What a run really did: rows that each operator took in and put out, observed while the answers were computed.

While a ``Recorder`` is active, every factor, combination and projection is a step whose output rows are counted by an observation in the
plan itself: no further job reads anything. A step's rows are known when the first action over it has ended; those of a step that the
optimizer left out, as beside an empty table, stay unknown.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Seconds that a step's rows are waited for once the run has ended.
PATIENCE = 10.0


@dataclass
class Step:
    number: int
    operator: str
    label: frozenset
    inputs: tuple[int, ...]
    observation: Observation
    rows: int | None = None


@dataclass
class Sent:
    """When a message, an answer or another part of a run was computed."""

    name: str
    began: float
    ended: float


@dataclass
class Recorder:
    steps: list[Step] = field(default_factory=list)
    sent: list[Sent] = field(default_factory=list)

    def observed(self, operator: str, label: Collection[str], df: DataFrame, inputs: Collection[int | None] = ()) -> tuple[DataFrame, int]:
        """``df`` with its rows counted on the way, and the step's number."""
        number = len(self.steps)
        observation = Observation(f"{operator}-{number}-{uuid.uuid4().hex}")
        self.steps.append(Step(number, operator, frozenset(label), tuple(i for i in inputs if i is not None), observation))
        return df.observe(observation, F.count(F.lit(1)).alias("rows")), number

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.time()
        yield
        self.sent.append(Sent(name, began, time.time()))

    def finish(self) -> None:
        """Read what was observed, waiting a bounded time for what never ran."""

        def read(step: Step) -> None:
            with suppress(Py4JJavaError):  # an action that left the step out has no row for it
                step.rows = step.observation.get["rows"]

        threads = [threading.Thread(target=read, args=(s,), daemon=True) for s in self.steps if s.rows is None]
        for t in threads:
            t.start()
        until = time.time() + PATIENCE
        for t in threads:
            t.join(max(0.0, until - time.time()))

    # reports ------------------------------------------------------------------------------------

    def rows_in(self, step: Step) -> list[int | None]:
        return [self.steps[i].rows for i in step.inputs]

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, operator, label, rows_in, rows_out), a row per step: as many as the plan has operators."""
        rows = [(s.number, s.operator, ",".join(sorted(s.label)), self.rows_in(s), s.rows) for s in self.steps]
        return spark.createDataFrame(rows, "step int, operator string, label string, rows_in array<bigint>, rows_out bigint")

    def overlapped(self) -> bool:
        """Whether two parts of the run were computed at the same time."""
        return any(a is not b and a.began < b.ended and b.began < a.ended for a in self.sent for b in self.sent)


_active = threading.local()


def active() -> Recorder | None:
    return getattr(_active, "recorder", None)


@contextmanager
def recording(recorder: Recorder | None) -> Iterator[Recorder | None]:
    """Make ``recorder`` active for what this thread builds."""
    before = active()
    _active.recorder = recorder
    try:
        yield recorder
    finally:
        _active.recorder = before
