"""Session helpers that the operators share: tables, scratch space, components of a graph."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomlog-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of an Arrow batch at most: batches lie outside the heap, on the JVM's side and in Python, several at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows for each Arrow batch to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Scratch:
    """Intermediate tables as Parquet in the shared folder; they outlive lost executors and cut lineage.

    What an operator returns reads its last tables, so they stay until drop_scratch() or the end of a scratch_of().
    """

    #: Folders that were not dropped yet.
    made: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/loomlog-{uuid.uuid4().hex}"
        Scratch.made.append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Frees a table that nothing reads any more."""
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables of all operators so far, or of those since the since-th folder; their results can't be read any more."""
    for root in Scratch.made[since:]:
        _delete(spark, root)
    del Scratch.made[since:]


@contextmanager
def scratch_of(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables of operators that were called inside, at the end; their results must be written by then."""
    since = len(Scratch.made)
    yield
    drop_scratch(spark, since)


#: Bytes of a batch that one call of a Python function gets; a single longer row comes alone.
SLICE = 1 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows, at = batch.num_rows, 0
    if not rows:
        return
    sizes = np.full(rows, 8, np.int64)
    for col in batch.columns:
        if pa.types.is_large_string(col.type) or pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
            sizes += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    while at < rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


#: Of a Python worker: what empties its caches. A task that doesn't use them calls these, as workers outlive operators.
CACHES: list[Callable[[], None]] = []


def empty_caches() -> None:
    """By name, so that a task calls its own worker's and not a copy of the driver's list."""
    for empty in CACHES:
        empty()


def arrow_map(df: DataFrame, fn: Callable, schema: str, per_task: bool = False, caches: bool = False) -> DataFrame:
    """fn over the Arrow batches, cut so that each holds one row or SLICE bytes at most.

    With per_task, fn() makes the function once for each task; with caches, the worker keeps its caches.
    """
    given = fn
    small_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not caches:
            empty_caches()
        fn = given() if per_task else given
        for batch in batches:
            for part in sliced(batch):
                if (out := fn(part)) is not None:
                    yield out
        # workers live on between tasks, and so would what their pools hold
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(over, schema)


#: Partial sums that one task adds up, and tasks of a first sum at most, which bounds what their rows hold in all.
FAN_IN, TASKS = 16, 16_384


def summed(df: DataFrame, part: Callable[[pa.RecordBatch, np.ndarray], None], size: int, kind: str = "<f8") -> np.ndarray | None:
    """What part(batch, total) adds to a float64 total of `size` over all batches; None without rows.

    Each task adds up its batches and writes one row of the given kind. Rows are then added about FAN_IN at a time in
    rounds, so that no task and not the driver holds more, whatever the number of tasks.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for piece in sliced(batch):
                total = np.zeros(size) if total is None else total
                part(piece, total)
        if total is not None:
            yield row(TaskContext.get().partitionId(), total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, g = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                total = np.zeros(size) if total is None else total
                g = batch["g"][i].as_py()
                total += np.frombuffer(batch["v"][i].as_buffer(), kind)
        if total is not None:
            yield row(g // FAN_IN, total)

    def row(g: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([total.astype(kind).tobytes()], pa.binary())], ["g", "v"])

    schema, left = "g long, v binary", df.rdd.getNumPartitions()
    if left > TASKS:
        df, left = df.coalesce(TASKS), TASKS
    rows = df.mapInArrow(first, schema)
    while left > 2:
        left = -(-left // FAN_IN)
        rows = rows.repartitionById(left, F.floor(F.col("g") / FAN_IN).cast("int")).mapInArrow(again, schema)
    got = rows.collect()
    return np.sum([np.frombuffer(bytes(r["v"]), kind).astype(float) for r in got], axis=0) if got else None


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, mod n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Connected components by contraction.

    edges (a, b): any pairs; loops and repeats are allowed. Returns (node, comp) with comp the smallest node
    of its component, one row per node that has an edge to another node. Each round joins every node to its
    smallest neighbour, follows the paths three times and contracts, so that edges shrink geometrically; sums are partial
    before each shuffle and a hub's rows are on the side of a join that adaptive execution can split.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.write(edges, f"{tag}-e0")
    first = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    comp = first.select("node", F.col("node").alias("comp"))
    k = 0
    while not edges.isEmpty():
        k += 1
        # the smaller end is itself a candidate, so parents never point upwards
        parent = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        parent = scratch.write(parent, f"{tag}-p{k}")
        up, far = parent.select(F.col("node").alias("to"), F.col("to").alias("up")), parent
        for _ in range(3):
            far = far.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"))
        parent = scratch.write(far, f"{tag}-far{k}")
        comp = scratch.write(comp.join(parent.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), f"{tag}-c{k}")
        pa_, pb = parent.select(F.col("node").alias("a"), F.col("to").alias("ta")), parent.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(pa_, "a", "left").join(pb, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y")).where("x <> y")
        edges = scratch.write(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{tag}-e{k}")
        for old in (f"{tag}-e{k - 1}", f"{tag}-c{k - 1}", f"{tag}-p{k}", f"{tag}-far{k}"):
            scratch.drop(old)
    return comp


__all__ = ["Scratch", "arrow_map", "components", "crc_mod", "drop_scratch", "scratch_of", "shared_dir", "sliced", "summed", "table"]
