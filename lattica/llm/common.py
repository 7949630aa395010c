"""What the operators of this subpackage share: tables, folds, words and Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes -> bytes: A-Z to a-z, nothing else.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of so few rows that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, to be read in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(column, UPPER, LOWER)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """`df` and a column that is computed once per row, however often it is used above.

    Plain projections may be copied into every expression and filter that uses
    them; a generator of one row is not.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
) -> DataFrame:
    """`df` and new columns, computed batch by batch where the rows lie.

    `start` runs once per task and returns the function from a batch to the new
    columns.  Names in `fields` must be free in `df`.
    """
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *step(batch)], names=names)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def few(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """`df`, which holds about `rows` small rows, in tasks of about `per_task` rows and no more tasks than that takes."""
    return df.coalesce(rows // per_task + 1)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table to the folder of checkpoints, and read again.

    Like a checkpoint it survives the loss of any executor; columns are
    compressed, and a reader fetches only those it needs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame) -> DataFrame:
    """`stored`, and the shuffles made for `df` leave the disk as soon as it is written.

    Otherwise they stay until the driver collects its garbage.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df)
    finally:
        conf.set(key, before)
