"""A sink of JSON lines that can be stopped at any time and resumed: each key is made and written once.

Rows are made and appended in slices of their keys, each a job of its own that commits whole files or none; a run first reads the keys that are there
and makes only what is missing. A file that another writer has left with a torn last line is read without that line, and `mended` rewrites it.
Lines that are blank, malformed, or begin with # hold no rows. One run at a time may write to a folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str) -> list:
    """Hadoop's statuses of the folder's data files."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x for x in store.listStatus(root) if x.isFile() and x.getPath().getName()[0] not in "._"] if store.exists(root) else []


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file, good (a JSON object), of lines that are not blank and no comments."""
    text = F.trim("value")
    own = spark.read.text(path).select(text.alias("line"), F.input_file_name().alias("file")).where((text != "") & ~text.startswith("#"))
    return own.withColumn("good", F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False)))


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that are there, without repeats of a line's text."""
    if not _files(spark, path):
        return spark.createDataFrame([], schema)
    return _lines(spark, path).where("good").select(F.from_json("line", schema).alias("r")).select("r.*")


def append(rows: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame] | None = None, slices: int = 8, upto: int | None = None) -> int:
    """Makes and writes the rows whose key is not there, and gives the number of keys that were. `make` turns the missing rows into those
    to be written, which keep the key; it sees no row twice unless its slice was lost. Of rows with one key one is written; a null key is none.
    `upto` stops after so many slices."""
    spark = rows.sparkSession
    rows = rows.where(F.col(key).isNotNull())
    kind = dict(rows.dtypes)[key]
    known = committed(spark, path, f"{key} {kind}").where(F.col(key).isNotNull()).distinct()
    n = known.count()
    pending = rows.join(known, key, "left_anti") if n else rows
    order = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(c) for c in rows.columns]))
    pending = pending.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    for i in range(min(slices, slices if upto is None else upto)):
        some = pending.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i)
        # Text, as a reader of one file's lines must not meet half a row of a job that failed: files are renamed when the job is whole.
        out = make(some) if make else some
        out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
    return n


def _rewritten(spark: SparkSession, path: str, stays: Column) -> int:
    """Rewrites the files with lines that don't stay; gives their number. New files are written before the old ones go."""
    bad = [r.file for r in _lines(spark, path).where(~stays).select("file").distinct().collect()]
    for file in bad:
        _lines(spark, file).where(stays).select(F.col("line").alias("value")).coalesce(1).write.mode("append").text(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)
    return len(bad)


def mended(spark: SparkSession, path: str) -> int:
    """Rewrites the files that have malformed lines, without these; gives the number of such files. Keys written twice by a stop between write and removal are read once by `committed_once`."""
    return _rewritten(spark, path, F.col("good")) if _files(spark, path) else 0


def drop(spark: SparkSession, path: str, key: str, values: DataFrame, kind: str) -> int:
    """Removes all rows of these keys (a column `key`, of a size to be broadcast); gives the number of files rewritten."""
    if not _files(spark, path):
        return 0
    held = [r[0] for r in values.select(F.col(key).cast(kind)).distinct().limit(10_001).collect()]
    if len(held) > 10_000:
        raise ValueError("more than 10,000 keys to drop: write the folder anew")
    own = F.from_json("line", f"{key} {kind}")[key]
    return _rewritten(spark, path, ~F.coalesce(own.isin(held), F.lit(False)))


def committed_once(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    return committed(spark, path, schema).dropDuplicates([key])
