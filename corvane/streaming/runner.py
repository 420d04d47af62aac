"""Jobs that are enqueued, run under leases and dispatched again, as a stream with keyed state and timers.

Each job's state (where it stands, its attempt, what was accepted and rejected, when its lease ends) is one value in the state store; a timer in event time
takes a job whose lease has ended back to the queue. Dispatches leave through an outbox that is written by micro-batch: a batch that comes again writes
the same files, so a restart repeats nothing and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.sources.tables import upsert
from corvane.streaming.jobs import MOVES

STATE = "state string, attempt int, accepted long, rejected long, expires long"
OUT = "job_id long, kind string, state string, attempt int, accepted long, rejected long, at timestamp"
#: Needed of the session: only this store has timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def moved(job: tuple, to: str, at: int, lease_ms: int | None) -> tuple[tuple, bool]:
    """A job after an event at `at` (milliseconds), and whether it is dispatched by it. A lease that has ended by then has sent it back before."""
    state, attempt, accepted, rejected, expires = job
    if to not in MOVES[state]:
        return (state, attempt, accepted, rejected + 1, expires), False
    queued = to == "QUEUED"
    return (to, attempt + queued, accepted + 1, rejected, at + lease_ms if lease_ms and to == "RUNNING" else None), queued


class Runner(StatefulProcessor):
    """Rows of kind state after each batch of a job's events, and of kind dispatch for each time that it is queued."""

    def __init__(self, lease_ms: int | None) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _rows(self, key: int, job: tuple, sent: list[tuple[int, int]], at: int) -> pd.DataFrame:
        rows = [(key, "dispatch", "QUEUED", attempt, job[2], job[3], t) for attempt, t in sent] + [(key, "state", job[0], job[1], job[2], job[3], at)]
        out = pd.DataFrame(rows, columns=[x.split(" ")[0] for x in OUT.split(", ")])
        out["at"] = pd.to_datetime(out["at"], unit="ms")
        return out

    def _keep(self, job: tuple) -> None:
        self.job.update(job)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if job[4] is not None:
            self.handle.registerTimer(job[4])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = tuple(self.job.get()) if self.job.exists() else ("PENDING", 0, 0, 0, None)
        frame = pd.concat(list(rows)).sort_values("seq")
        sent = []
        at = [int(t.value // 1_000_000) for t in pd.to_datetime(frame["at"])]
        for to, t in zip(frame["state"], at, strict=True):
            if job[4] is not None and job[4] < t:
                job = ("QUEUED", job[1] + 1, job[2], job[3], None)
                sent.append((job[1], t))
            job, queued = moved(job, to, t, self.lease_ms)
            if queued:
                sent.append((job[1], t))
        self._keep(job)
        yield self._rows(key[0], job, sent, at[-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = tuple(self.job.get())
        t = expiredTimerInfo.getExpiryTimeInMs()
        if job[0] != "RUNNING" or job[4] != t:
            return
        job = ("QUEUED", job[1] + 1, job[2], job[3], None)
        self.job.update(job)
        yield self._rows(key[0], job, [(job[1], t)], t)

    def close(self) -> None:
        pass


def run(events: DataFrame, lease_ms: int | None = 60_000, late: str = "10 seconds") -> DataFrame:
    """OUT rows of a stream of events (job_id, seq, state, at)."""
    own = events.withWatermark("at", late)
    return own.groupBy("job_id").transformWithStateInPandas(Runner(lease_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: dispatches of batch n in `outbox/n=<n>`, all jobs' states after it in `states/v<n>`. A batch that comes again replaces what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        rows.where("kind = 'dispatch'").select("job_id", "attempt", "at").write.mode("overwrite").parquet(f"{folder}/outbox/n={number}")
        last = Window.partitionBy("job_id").orderBy(F.desc(F.col("accepted") + F.col("rejected")), F.desc("attempt"))
        new = rows.where("kind = 'state'").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("job_id", "state", "attempt", "accepted", "rejected")
        if number:
            new = upsert(spark.read.parquet(f"{folder}/states/v{number - 1}"), new, ["job_id"])
        new.write.mode("overwrite").parquet(f"{folder}/states/v{number}")
        rows.unpersist()

    return write
