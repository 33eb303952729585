"""What several operators share: batches, shared storage, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_root

#: Rows of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 512
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset, on a local master."""
    at = shared_root(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so lost executors cost no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: for large tables, which checkpoints hold uncompressed."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _stored.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what ``stored`` writes within; for callers that write their result before it."""
    before = len(_stored)
    try:
        yield
    finally:
        while len(_stored) > before:
            fs, path = hadoop(spark, _stored.pop())
            fs.delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffles that nothing refers to any more: its cleaner learns of them from the driver's garbage collection alone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, f"_{name}"
    while out.lower() in taken:
        out += "_"
    return out


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; a caller's own smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_rows(df: DataFrame, inputs: list[Column], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """Map ``inputs`` batch by batch; ``make()`` runs once in each task and returns the batch function."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.select(*inputs).mapInArrow(run, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def text_of(df: DataFrame) -> Column:
    """The column ``text`` of ``df`` as a string."""
    return df["text"].cast("string").alias("text")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v long) as rows (node, root), root the smallest node reached.

    Distributed union-find by alternating stars: the large star hangs every
    larger neighbour on the smallest one, the small star hangs the node itself
    and its smaller neighbours on the smallest. A node's links never meet in
    one task: minima are partial aggregates, followed by a join on the node,
    whose skewed keys adaptive execution splits. O(log^2 n) rounds; each is cut into the
    shared folder. Nodes without links don't appear. Only two counters of a round reach
    the driver.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = cut(
        edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # each node u hangs its smaller neighbours, and itself, on its smallest neighbour
        joined = large.join(least, "u")
        small = (
            joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        new = cut(small)
        now = new.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if tuple(now) == before:
            break
        before, e = tuple(now), new
    return new.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        new.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("root"))
    )


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of ``path``, for renames and deletes in stores that only Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

