"""Session defaults and the few session-level helpers operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union that keeps its inputs' partitioning fails in 4.1 when adaptive
    # execution later reads one of the inputs locally, with another number of
    # partitions ("Can't zip RDDs with unequal numbers of partitions").
    "spark.sql.unionOutputPartitioning": "false",
    # Texts are wide rows: smaller Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


# Rows of an Arrow batch of texts, and bytes of texts that are worked on at once.
TEXT_ROWS = 512
SLICE_BYTES = 1 << 20


def local_session(app: str = "lattica", cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain_unions(spark: SparkSession) -> None:
    """Apply the union setting to a session made elsewhere."""
    key = "spark.sql.unionOutputPartitioning"
    spark.conf.set(key, DEFAULTS[key])


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of so few rows that long texts, and what is made of them, fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def text_slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about `size` bytes; one text may be longer."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; choose one only on an unset session."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-checkpoint-", dir=os.environ.get("TMPDIR")))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def new_folder(spark: SparkSession) -> str:
    """Path of a folder, not there yet, for a table in the folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
