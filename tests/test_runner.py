import random
from pathlib import Path


from pyspark.sql import functions as F

from corvane.streaming import jobs, runner

EVENTS = "job_id long, seq long, state string, at timestamp"


def written(spark, folder, rows, n):
    df = spark.createDataFrame(rows, "job_id long, seq long, state string, at long").withColumn("at", F.timestamp_seconds("at"))
    df.coalesce(1).write.mode("append").parquet(folder)


def drained(spark, source, folder, lease_ms=None, late="10 seconds"):
    spark.conf.set(*runner.STORE)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = runner.run(stream, lease_ms, late).writeStream.foreachBatch(runner.sink(folder)).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert not query.isActive and query.exception() is None
    last = max(int(p.name[1:]) for p in (Path(folder) / "states").iterdir())
    return {r.job_id: r for r in spark.read.parquet(f"{folder}/states/v{last}").collect()}, sorted((r.job_id, r.attempt) for r in spark.read.parquet(f"{folder}/outbox").collect())


def test_restart_and_replay_agree(spark, tmp_path):
    draw = random.Random(6)
    rows = [(draw.randrange(12), i, draw.choice(list(jobs.MOVES)), 1000 + i) for i in range(240)]
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    for i in range(2):
        written(spark, source, rows[i * 60 : i * 60 + 60], i)
    drained(spark, source, folder, late="10 minutes")
    for i in range(2, 4):
        written(spark, source, rows[i * 60 : i * 60 + 60], i)
    states, sent = drained(spark, source, folder, late="10 minutes")
    df = spark.createDataFrame([r[:3] for r in rows], "job_id long, seq long, state string")
    want = {r.job_id: (r.state, r.accepted, r.rejected) for r in jobs.replayed(df).collect()}
    assert {k: (r.state, r.accepted, r.rejected) for k, r in states.items()} == want
    assert len(sent) == len(set(sent)) and {k: max((a for j, a in sent if j == k), default=0) for k in states} == {k: r.attempt for k, r in states.items()}
    again = drained(spark, source, folder, late="10 minutes")
    assert again[1] == sent


def test_ended_leases_are_dispatched_again(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    written(spark, source, [(1, 1, "QUEUED", 100), (1, 2, "RUNNING", 101), (2, 3, "QUEUED", 100), (2, 4, "RUNNING", 101)], 0)
    drained(spark, source, folder, 10_000, "1 second")
    written(spark, source, [(2, 5, "SUCCEEDED", 105), (3, 6, "QUEUED", 200)], 1)
    drained(spark, source, folder, 10_000, "1 second")
    written(spark, source, [(3, 7, "RUNNING", 300)], 2)
    states, sent = drained(spark, source, folder, 10_000, "1 second")
    assert (states[1].state, states[1].attempt) == ("QUEUED", 2) and states[2].state == "SUCCEEDED" and states[3].state == "RUNNING"
    assert sent == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_moves():
    job = ("PENDING", 0, 0, 0, None)
    job, sent = runner.moved(job, "QUEUED", 5, 10)
    assert (job, sent) == (("QUEUED", 1, 1, 0, None), True)
    job, sent = runner.moved(job, "RUNNING", 7, 10)
    assert (job, sent) == (("RUNNING", 1, 2, 0, 17), False)
    assert runner.moved(job, "PENDING", 8, 10) == (("RUNNING", 1, 2, 1, 17), False)
