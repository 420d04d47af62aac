"""Job states and events as streams: deduplication, a keyed state machine with leases, micro-batch indexing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.sources.tables import upsert

#: Fixed: the states that a job can go to from each state.
MOVES = {"PENDING": ("QUEUED",), "QUEUED": ("RUNNING", "FAILED"), "RUNNING": ("SUCCEEDED", "FAILED", "QUEUED"), "SUCCEEDED": (), "FAILED": ()}


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each callback once: the first of equal keys within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def transitions(events: DataFrame, lease_ms: int | None = 60_000) -> DataFrame:
    """job_id, state, accepted, rejected after each batch of a job's events (job_id, seq, state): moves that the state machine has not are counted and left out.

    A job that runs beyond its lease without an event goes back to QUEUED by a processing-time timer. Timers keep a stream running, so
    one that is to end with its input takes no lease.
    """
    schema = "job_id long, state string, accepted long, rejected long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, accepted, rejected = state.get if state.exists else ("PENDING", 0, 0)
        if state.hasTimedOut:
            now = "QUEUED" if now == "RUNNING" else now
        for frame in frames:
            for to in frame.sort_values("seq")["state"]:
                good = to in MOVES[now]
                now, accepted, rejected = (to if good else now), accepted + good, rejected + (not good)
        state.update((now, accepted, rejected))
        if now == "RUNNING" and lease_ms:
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame({"job_id": [key[0]], "state": [now], "accepted": [accepted], "rejected": [rejected]})

    return events.groupBy("job_id").applyInPandasWithState(step, schema, "state string, accepted long, rejected long", "update", GroupStateTimeout.ProcessingTimeTimeout if lease_ms else GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame) -> DataFrame:
    """The same machine over a batch of all events: job_id, state, accepted, rejected, as a fold over each job's events in order."""
    moves = F.create_map(*[y for a, to in MOVES.items() for y in (F.lit(a), F.array(*map(F.lit, to)) if to else F.array().cast("array<string>"))])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda x: x["state"])
    start = F.struct(F.lit("PENDING").alias("s"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"))

    def step(a: F.Column, to: F.Column) -> F.Column:
        good = F.array_contains(moves[a["s"]], to)
        return F.struct(F.when(good, to).otherwise(a["s"]).alias("s"), (a["a"] + good.cast("long")).alias("a"), (a["r"] + (~good).cast("long")).alias("r"))

    out = events.groupBy("job_id").agg(F.aggregate(ordered, start, step).alias("x"))
    return out.select("job_id", F.col("x.s").alias("state"), F.col("x.a").alias("accepted"), F.col("x.r").alias("rejected"))


def index_batches(changes: DataFrame, folder: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that upserts each micro-batch into a versioned table; a batch that comes again writes the same version."""
    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = prepare(batch) if prepare else batch
        if number:
            new = upsert(spark.read.parquet(f"{folder}/v{number - 1}"), new.dropDuplicates(keys), keys)
        new.dropDuplicates(keys).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return sink
