"""Helpers shared by the text operators: table access, shared storage, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds on its way to Python. Texts may be long, so batches
#: are small; memory follows the batch, never the partition.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session without other executors takes a new temporary folder; any
    other session is an error, as a folder of one machine would lose tables.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not (found or context.getCheckpointDir()):
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return (found or context.getCheckpointDir()).rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them.

    ``keep`` writes a frame and returns the reread table; ``drop`` removes one that no
    later step reads. What is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, frame: DataFrame) -> DataFrame:
        if not self.count:
            place, files = self._place(self.root)
            files.mkdirs(place)
            files.deleteOnExit(place)
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, frame: DataFrame | None) -> None:
        path = self.paths.pop(id(frame), None)
        if path:
            place, files = self._place(path)
            files.delete(place, True)


#: Rows of identifiers that are sent to every executor at most (about 16 bytes each).
SENT_ROWS = 500_000


def sent_if_small(frame: DataFrame, scratch: Scratch, rows: int = SENT_ROWS) -> DataFrame:
    """``frame`` written down and counted, and marked for sending if it has few rows.

    Spares the other side of a join its shuffle; with more rows both sides are shuffled.
    """
    kept = scratch.keep(frame)
    return F.broadcast(kept) if kept.count() <= rows else kept


#: A key is hot if it has at least this share of all rows; there are at most as many such
#: keys as its inverse, so their rows fit every executor.
HOT_SHARE = 1e-4


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], rows: Column, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined to the one row of ``right`` that its key has; ``how="left"`` keeps
    rows whose key has none.

    ``rows`` says how many rows of ``left`` a key has at most, of ``total`` in all. Hot keys
    are sent to every executor (``1 / HOT_SHARE`` rows at most), so only rows of other keys
    are shuffled, and no task gets all rows of a hot one.
    """
    hot = rows >= max(2, total * HOT_SHARE)
    values = [c for c in right.columns if c != key and c not in key]
    few = F.broadcast(right.where(hot).withColumn("_hot", F.lit(True)))
    split = left.join(few, key, "left")
    near = split.where("_hot").select(*left.columns, *values)
    far = split.where("_hot IS NULL").select(*left.columns).join(right.where(~hot), key, how)
    return near.unionByName(far.select(*left.columns, *values))


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits on Arrow batches, where they are above the ones here.

    The limits are read when a query runs, so they can not be set for one plan alone.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub("[^0-9-]", "", spark.conf.get(key)))
        if now > most or now <= 0:
            spark.conf.set(key, most)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """``run`` as a task's function that gives its memory back when it ends, as Python
    workers are reused; ``forget`` clears what the task remembered."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
                ctypes.CDLL(None).malloc_trim(0)

    return task


def map_batches(
    frame: DataFrame,
    columns: list[str],
    step: Callable[..., Iterable[pa.RecordBatch] | pa.RecordBatch],
    schema: str,
    forget: Callable[[], None] | None = None,
) -> DataFrame:
    """Run ``step`` over the Arrow columns of each batch; it gets one array per column."""
    bound_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                out = step(*part.columns)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    run = tidied(run, forget)
    return frame.select(*columns).mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """A null text counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: Tasks' arrays of one key are first added up in as many groups.
FAN = 64


def tree_summed(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``counts`` (int64 arrays as bytes, of one length for a key) up by ``keys``.

    Groups of tasks first, then groups' sums, so no task reads the arrays of all others. A
    task holds one array for each of its keys.
    """
    session = frame.sparkSession
    spec = ", ".join(f"`{k}` {kind}" for k, kind in frame.dtypes if k in keys) + ", counts binary"
    kinds = [k for k, _ in frame.dtypes if k in keys]
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for *key, counts in zip(*(batch.column(k).to_pylist() for k in [*kinds, "counts"]), strict=True):
                added = np.frombuffer(counts, np.int64)
                at = tuple(key)
                if at in sums:
                    sums[at] += added
                else:
                    sums[at] = added.copy()
        for key, total in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], schema.field(k).type) for k, v in zip(kinds, key, strict=True)), pa.array([total.tobytes()], pa.binary())], [*kinds, "counts"])

    salted = frame.select(*kinds, "counts", F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("salt"))
    some = salted.repartition(parts, *kinds, "salt").select(*kinds, "counts").mapInArrow(tidied(run), spec)
    return some.repartition(parts, *kinds).mapInArrow(tidied(run), spec)
