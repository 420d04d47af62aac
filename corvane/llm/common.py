"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the byte-level contracts: space and 0x09-0x0D, which is also what bytes.split() splits at.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of no more rows than this are never treated as hot.
HOT_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one, and a
    cluster an error, as its executors don't share the driver's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="corvane-"))
        at = context.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`df` computed once, to be broadcast in a join if it has `most` rows or fewer (of a few numbers each)."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def stored(df: DataFrame, *by: str) -> str:
    """The path of `df` written as Parquet in the shared folder, in folders by these columns, one file each."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    return path


def stored_by_part(df: DataFrame) -> str:
    """The path of `df`, whose rows are for parts of another table (`part`, a long), written for PartTable: in as many folders as shuffles
    have partitions, each sorted by part, so that their number does not grow with the parts."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(df.sparkSession)}/parts-{uuid.uuid4().hex}-{n}"
    rows = df.withColumn("bucket", F.pmod("part", F.lit(n)).cast("int")).repartition(n, "bucket").sortWithinPartitions("bucket", "part")
    rows.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
    return path


class PartTable:
    """What a task takes for the parts that it reads, of what stored_by_part has written; holds one part at a time."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.part, self.table = path, columns, None, None
        self.n = int(path.rpartition("-")[2])

    def of(self, part: int) -> pa.Table | None:
        """The rows of a part; None where it has none."""
        if part != self.part:
            store, root = fs.FileSystem.from_uri(f"{self.path}/bucket={part % self.n}")
            found = [x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".parquet")]
            at = ds.field("part") == part
            self.part, self.table = part, ds.dataset(sorted(found), format="parquet", filesystem=store).to_table(columns=self.columns, filter=at) if found else None
        return self.table if self.table is not None and self.table.num_rows else None


def folder_table(path: str, columns: list[str]) -> pa.Table | None:
    """The Parquet files of one folder of the shared storage, for a task; None where there is no such folder."""
    store, root = fs.FileSystem.from_uri(path)
    found = [x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read(columns=columns) for x in sorted(found)]) if found else None


def keyed(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`many` joined with the columns of `one`, which has a row for each key at most. Keys with over a thousandth of the rows, under a
    thousand by count, are joined by a broadcast, so that none meets in one task; rows with a null key have no match."""
    known = many.where(F.col(key).isNotNull())
    counts = known.groupBy(key).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = cut(counts.where(F.col("count") * 1000 > max(total, HOT_ROWS * 1000)).select(key))
    rest = many.join(one, key, how)
    if not hot.isEmpty():
        hot = F.broadcast(hot)
        heads = F.broadcast(one.join(hot, key, "left_semi"))
        rest = known.join(hot, key, "left_anti").join(one, key, how).unionByName(known.join(hot, key, "left_semi").join(heads, key, how))
    elif how == "inner":
        return rest
    else:
        rest = known.join(one, key, how)
    if how == "left":
        rest = rest.unionByName(many.where(F.col(key).isNull()), allowMissingColumns=True)
    return rest


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns. Further columns may have any name, also the same one in other case or twice; of equal names the first counts."""
    at = [df.columns.index(x) for x in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(x) for i, x in zip(at, names, strict=True)])


def per_batch(df: DataFrame, step: Callable[[dict], dict | None], schema: str, setup: Callable[[], object] | None = None, rows: int = 1 << 30) -> DataFrame:
    """`step` over Arrow batches, of `rows` rows at most: takes a dict of Arrow arrays (and `setup`'s result as key ""), gives a dict of columns."""
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for whole in batches:
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                if (out := step({**dict(zip(batch.schema.names, batch.columns, strict=True)), "": state})) is not None:
                    yield from batches_of(out, target)
        del state
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers are used again by later stages, whose own needs would come on top."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}
    fields = []
    for part in schema.split(", "):
        name, kind = part.strip().split(" ")
        fields.append(pa.field(name, kinds[kind]))
    return pa.schema(fields)


def batches_of(columns: dict, target: pa.Schema, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    whole = pa.table([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in target], schema=target)
    yield from whole.to_batches(max_chunksize=rows)


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column from offsets and values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def digest_of(column: Column) -> Column:
    """16 bytes that tell texts apart; null as empty."""
    return F.unhex(F.md5(as_bytes(column)))


def as_bytes(column: Column) -> Column:
    """The text's UTF-8, null as empty."""
    return F.coalesce(column.cast("binary"), F.lit(b""))
