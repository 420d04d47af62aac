"""Index versions and claims as tables: builds that are staged, judged, promoted and rolled back, chunks by row, and units claimed for embedding.

A table of builds has a row for each version: version, status (STAGED, EVAL_PASSED, EVAL_FAILED, PROMOTED, ROLLED_BACK, RETIRED), active, previous, eval, at.
Each function gives the table anew; the caller writes it where the old one was, as a new folder that is then named by its manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.decisions import first_rule
from corvane.operators.verdicts import holds

#: Fixed: the most units of a claim, and what may be embedded.
BATCH = 200
BUILDS = "version string, status string, active boolean, previous string, eval string, at long"


def with_build(builds: DataFrame, version: str, at: int) -> DataFrame:
    """A build recorded as staged, in place of one of the same version."""
    row = builds.sparkSession.createDataFrame([(version, "STAGED", False, None, None, at)], BUILDS)
    return builds.where(F.col("version") != version).unionByName(row)


def with_eval(builds: DataFrame, evals: DataFrame) -> DataFrame:
    """Builds with the results (version, eval, passed) of their own version; a later one of a version counts."""
    last = evals.groupBy("version").agg(F.max_by(F.struct("eval", "passed"), "eval").alias("e"))
    status = F.when(F.col("e").isNull(), F.col("status")).when(F.col("e.passed"), "EVAL_PASSED").otherwise("EVAL_FAILED")
    return builds.join(last, "version", "left").select("version", status.alias("status"), "active", "previous", F.coalesce(F.col("e.eval"), F.col("eval")).alias("eval"), "at")


def promoted(builds: DataFrame, version: str, at: int) -> DataFrame:
    """The version made the one active build, the active one before it noted; an error unless it has passed its evaluation."""
    known = {r.version: r for r in builds.where((F.col("version") == version) | F.col("active")).collect()}  # two rows at most
    if version not in known or known[version].status != "EVAL_PASSED" or not known[version].eval:
        raise ValueError(f"{version} must have passed an evaluation before it is promoted")
    before = next((v for v, r in known.items() if r.active and v != version), known[version].previous)
    mine = F.col("version") == version
    return builds.select("version", F.when(mine, "PROMOTED").when(F.col("active"), "RETIRED").otherwise(F.col("status")).alias("status"), mine.alias("active"), F.when(mine, F.lit(before)).otherwise(F.col("previous")).alias("previous"), "eval", F.when(mine, F.lit(at)).otherwise(F.col("at")).alias("at"))


def rolled_back(builds: DataFrame, version: str, at: int) -> DataFrame:
    """The version given up and the one before it active again."""
    row = builds.where(F.col("version") == version).first()
    if row is None:
        raise ValueError(f"{version} is not known")
    mine, old = F.col("version") == version, F.col("version") == F.lit(row.previous)
    return builds.select("version", F.when(mine, "ROLLED_BACK").when(holds(old), "PROMOTED").otherwise(F.col("status")).alias("status"), holds(old).alias("active"), "previous", "eval", F.when(mine, F.lit(at)).otherwise(F.col("at")).alias("at"))


def stage(vectors: DataFrame, folder: str, version: str) -> str:
    """Writes rows (row_id, vector, ...) of a version beside what is served; gives the staged folder."""
    path = f"{folder}/stage-{version}-{uuid.uuid4().hex}"
    vectors.write.parquet(path)
    return path


def serve(spark: SparkSession, folder: str, staged: str, version: str, model: str) -> None:
    """Names the staged folder as what is served, in a file of its own, of the next number. Two callers at once may take one number; what is then served is the
    same for all readers, as the last file by name counts, and neither file is lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder}/manifests")
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    body = json.dumps({"path": staged, "manifest": {"index_version": version, "embedding_model": model}}).encode()
    n = max((int(x.partition("-")[0]) for x in _names(spark, folder)), default=-1) + 1
    out = store.create(path(root, f"{n:012d}-{uuid.uuid4().hex}.json"), False)
    out.write(body)
    out.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(root)] if store.exists(root) else []
    return sorted(x for x in names if x.endswith(".json") and x.partition("-")[0].isdigit())


def _served(spark: SparkSession, folder: str) -> dict | None:
    """The last manifest that is whole: one that is being written, or whose writer was lost, is passed over."""
    for name in reversed(_names(spark, folder)):
        text = "\n".join(r.value for r in spark.read.text(f"{folder}/manifests/{name}").collect())
        if text.endswith("}}"):
            return json.loads(text)
    return None


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What is served; None before anything is."""
    found = _served(spark, folder)
    return found["manifest"] if found else None


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors that are served; an error before any are."""
    found = _served(spark, folder)
    if found is None:
        raise FileNotFoundError(f"no index in {folder}")
    return spark.read.parquet(found["path"])


def lookup(chunks: DataFrame, hits: DataFrame, version: str) -> DataFrame:
    """Chunks of a version at the row ids of hits (query_id, rank, row_id), in the hits' order; ids that it lacks are left out."""
    own = chunks.where(F.col("index_version") == version).drop("index_version")
    out = hits.join(own, "row_id")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def replaced(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """A table of chunks with all of a version in place of what it had."""
    return old.where(F.col("index_version") != version).unionByName(new.withColumn("index_version", F.lit(version)))


def stats(documents: DataFrame, chunks: DataFrame, builds: DataFrame) -> DataFrame:
    """One row: how many documents and chunks there are, and the last build."""
    last = builds.agg(F.max_by("version", F.struct("at", "version")).alias("last_version"), F.max("at").alias("last_at"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(last)  # one row each


def location_gap(kind: Column, chunk: Column, place: Column) -> Column:
    """What a unit's place lacks to be cited; null for nothing. place has sheet, cells, page_no, page_label, physical, box, ocr, sure."""
    kind, chunk = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.trim(F.coalesce(chunk, F.lit(""))))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    sheets, pages = kind.isin("xlsx", "spreadsheet"), kind.isin("pdf", "ocr")
    return first_rule([
        (sheets & (chunk != "workbook_summary") & empty(place.sheet), "sheet_name"),
        (sheets & chunk.isin("table", "row_group") & empty(place.cells), "cell_range"),
        (pages & place.page_no.isNull() & place.page_label.isNull() & place.physical.isNull(), "page"),
        (pages & (chunk == "paragraph") & place.box.isNull(), "bbox"),
        (pages & holds(place.ocr) & place.sure.isNull(), "ocr_confidence"),
    ], None)


def claimed(units: DataFrame, now: int, stale_seconds: int, batch: int = BATCH, worker: str = "w") -> DataFrame:
    """The units of one claim of units (id, status, source_ready, claimed_at, at, reason), `batch` (200 and no more) at most: id, result (claimed or skipped), token, reason.

    Looked at are twice the batch of pending units, oldest change first; if these are fewer than the batch, as many stale claims as lack, oldest claim
    first. Of these in turn units that can't be embedded are skipped, others claimed, until the batch is full; what is not reached stays as it is.
    """
    batch = max(1, min(batch, BATCH))
    ready = units.where("source_ready")
    pending = ready.where("status = 'PENDING'").orderBy("at", "id").limit(2 * batch).select("id", "reason", F.lit(0).alias("turn"), F.col("at").alias("since"))
    stale = ready.where((F.col("status") == "EMBEDDING") & holds(F.col("claimed_at") < now - stale_seconds)).orderBy("claimed_at", "id").limit(batch)
    seen = pending.unionByName(stale.select("id", "reason", F.lit(1).alias("turn"), F.col("claimed_at").alias("since")))
    # Three batches at most, by contract, so windows over all of them are bounded.
    every, turns = Window.partitionBy(), Window.partitionBy().orderBy("turn", "since", "id")
    place = F.row_number().over(Window.partitionBy("turn").orderBy("since", "id"))
    lack = F.lit(batch) - F.count_if(F.col("turn") == 0).over(every)
    seen = seen.withColumn("looked", (F.col("turn") == 0) | (place <= lack)).where("looked")
    before = F.coalesce(F.count_if(F.col("reason").isNull()).over(turns.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("before", before).where(F.col("before") < batch)
    fit = F.col("reason").isNull()
    token = F.when(fit, F.concat(F.lit(f"{worker}:"), F.col("id").cast("string")))
    return seen.select("id", F.when(fit, "claimed").otherwise("skipped").alias("result"), token.alias("token"), "reason")


def finished(units: DataFrame, results: DataFrame) -> DataFrame:
    """id, status, outcome of units (id, status, token, hash) after results (id, token, hash): another token applies to nothing, another hash sends the unit back."""
    got = results.select("id", F.col("token").alias("t"), F.col("hash").alias("h"))
    out = units.join(got, "id", "left")
    mine = holds(F.col("token") == F.col("t"))
    fresh = F.col("hash").eqNullSafe(F.col("h"))
    status = F.when(mine & fresh, "EMBEDDED").when(mine, "PENDING").otherwise(F.col("status"))
    outcome = F.when(F.col("t").isNull(), None).when(~mine, "not_applied").when(fresh, "applied").otherwise("stale")
    return out.select("id", status.alias("status"), outcome.alias("outcome"))


def leased(jobs: DataFrame, requests: DataFrame, now: int, seconds: int) -> DataFrame:
    """job_id, token, expires, result of requests (job_id, token) on jobs (job_id, status, token, expires): a free, expired or own lease goes to the least token."""
    first = requests.groupBy("job_id").agg(F.min("token").alias("wish"))
    found = requests.join(first, "job_id").join(jobs.select("job_id", "status", F.col("token").alias("held"), "expires"), "job_id", "left")
    own = holds(F.col("held") == F.col("token"))
    free = F.col("held").isNull() | F.col("expires").isNull() | holds(F.col("expires") < now)
    result = first_rule([(F.col("status").isNull(), "JOB_NOT_FOUND"), (~F.col("status").isin("PENDING", "QUEUED", "RUNNING"), "JOB_TERMINAL"), (own, "CLAIMED"), (~free, "ALREADY_CLAIMED"), (F.col("token") == F.col("wish"), "CLAIMED")], "CLAIM_RACE")
    return found.select("job_id", "token", F.when(result == "CLAIMED", F.lit(now + seconds)).alias("expires"), result.alias("result"))
