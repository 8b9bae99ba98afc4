"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every contract: space, tab, LF, VT, FF, CR.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Narrow rows (a few numbers each) that one task of a small table holds.
TASK_ROWS = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names.

    Only a local master without ``spark.checkpoint.dir`` gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """``checkpointed`` as a table of unknown size, for rounds that join what earlier rounds made.

    A checkpoint carries the plan's estimate of its size on, and that of a join is the product of both sides': over rounds
    of joins its digits double each time, until such numbers fill the driver. Partitioning and order stay known.
    """
    spark = df.sparkSession
    jvm, plan = spark._jvm, checkpointed(df)._jdf.queryExecution().logical()
    session, _, constraints = (plan.otherCopyArgs().apply(i) for i in range(3))
    plan = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, jvm.scala.Option.empty(), constraints)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def code_key(column: str):
    """A non-null long stand-in for a nullable id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint only if a count proves it to be small; callers pass checkpointed tables."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: idle workers would hold it beside the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches, column: int, most: int = 2 << 20):
    """Arrow batches in slices with about ``most`` bytes in a string or binary column, so that what Python makes of one is
    bounded whatever the number and length of a batch's rows."""
    from umbra.llm._tokens import by_bytes, utf8

    for batch in batches:
        for a, b in by_bytes(utf8(batch.column(column))[1], most):
            yield batch.slice(a, b - a)
    release()


def row_count(df: DataFrame) -> int:
    """Rows of a checkpointed or read table, counted in place: ``count`` would shuffle a row from every task."""
    return df._jdf.queryExecution().toRdd().count()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as few tasks as its rows need; more than it has change nothing."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def gathered(df: DataFrame, docs: DataFrame, rows: int, most: int = 20_000_000) -> DataFrame:
    """``df``, made from ``docs`` with ``rows`` rows, in no more tasks than these need at TASK_ROWS rows and, by the plan's
    estimate, ``most`` bytes each; fewer than that stay as they are.

    Without Hadoop's native library the JVM launches short processes (chmod) for each file that a task writes to a local
    folder, and until such a process starts its program, it is seen with all of the JVM's memory. So small tables that
    are dealt over many partitions should not become as many files.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(1, -(-rows // TASK_ROWS), -(-size // most)), 1 << 20))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: smaller than a checkpoint, and pruned by column."""
    import uuid

    spark = df.sparkSession
    checkpointed(spark.range(0))  # makes sure that there is a shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
