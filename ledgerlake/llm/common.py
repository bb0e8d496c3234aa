"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of so many bytes (or one text, if that is longer) and rows; they bound a worker's
#: own memory. What Spark hands over at once it bounds itself, by spark.sql.execution.arrow.maxBytesPerBatch.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 10_000


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices that hold at most ``size`` bytes of a column (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, n = np.cumsum(lengths, dtype=np.int64), 0, batch.num_rows
    while start < n:
        done = int(ends[start - 1]) if start else 0
        end = int(np.searchsorted(ends, done + size, side="right"))
        end = min(max(end, start + 1), start + SLICE_ROWS, n)
        yield batch.slice(start, end - start)
        start = end


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see.

    Where none is set, a local session gets a folder of its own; on a cluster that
    is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def finished_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this block, Spark removes the shuffle files of each query as soon as it has ended."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back. The schema is stated, so no file is opened to infer it."""
        path = f"{self.root}/{name}"
        with finished_shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            with contextlib.suppress(Exception):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a task no longer needs back to the machine: Spark keeps Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def per_text(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[list], list[tuple]]],
    size: int = SLICE_BYTES,
) -> DataFrame:
    """Apply a function of a list of texts in tasks, batch by batch, without a shuffle.

    make() is called once a task and returns a function that gives, for the texts
    of a slice (None for null), one tuple each, in the order of ``schema``. The
    columns ``keep`` go through unchanged; all other columns are pruned.
    """
    extra = [] if text in keep else [F.col(text).cast("string").alias("__text")]
    picked = df.select(*[F.col(c) for c in keep], *extra)
    n = len(keep)
    at = n if extra else keep.index(text)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n])
    out_schema = f"{kept}, {schema}" if kept else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = make(), _arrow_fields(schema)
        for batch in (part for whole in batches for part in slices(whole, at, size)):
            rows = work(batch.column(at).to_pylist())
            made = [pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(target)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *made], names=[*batch.schema.names[:n], *[x for x, _ in target]]
            )
        del work
        release()

    return picked.mapInArrow(run, out_schema)


_ARROW = {
    "long": pa.int64(),
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def _arrow_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    pairs = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return [(name, _ARROW[kind]) for name, kind in pairs]


class Memo(dict):
    """Results by key, for keys that come again and again.

    Two generations hold half of ``limit`` keys each. When the young one is full it
    becomes the old one, whose keys come back when they are asked for. So keys that
    are met often stay, and the others go in time.
    """

    def __init__(self, make: Callable, limit: int = 1 << 18):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def spelling() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than one in HOT of all rows is joined apart.
HOT = 2_000


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """Inner join of rows with one row of facts for each key, safe where a few keys hold most rows.

    ``facts.count_col`` is the number of rows of each key and ``total`` their sum.
    At most HOT keys can hold more than total / HOT rows each, so their facts are
    broadcast and their rows stay where they are; the others are joined by a shuffle
    in which no key is large.
    """
    hot = F.col(count_col) > total / HOT
    few = F.broadcast(facts.where(hot))
    cold = facts.where(~hot).hint("merge")
    return rows.join(few, key).unionByName(rows.join(cold, key))


#: Rows of one key that meet in one piece of a join of a table with itself.
BLOCK = 4_096


def dealt(rows: DataFrame, count_col: str, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of rows with themselves, with a column ``__piece`` to be joined on beside the key.

    The rows of a key with ``count_col`` rows are dealt into blocks of about BLOCK, and
    every block of one side meets every block of the other in a piece of its own; the
    shuffle spreads the pieces of a large key over many tasks.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(count_col) / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64(*ids), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    left = rows.withColumn("__piece", F.explode(F.transform(every, lambda b: own * blocks + b)))
    right = rows.withColumn("__piece", F.explode(F.transform(every, lambda b: b * blocks + own)))
    return left.drop(count_col), right.drop(count_col)
