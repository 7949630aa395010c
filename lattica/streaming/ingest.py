"""Continuous ingest of text files, and of model answers that arrive as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.functions.text import file_type, stable_id
from lattica.operators.chunking import ChunkConfig, chunk_documents
from lattica.operators.mentions import RuleSet, extract
from lattica.operators.vectors import Embedder, embed


def read_text_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(document_id, file_path, file_type, text) of files as they appear; ids repeat on replay."""
    raw = (
        spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    located = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    return located.select(
        stable_id(F.col("file_path")).alias("document_id"), "file_path", file_type(F.col("file_path")).alias("file_type"), "text"
    )


def ingest(
    documents: DataFrame,
    root: str,
    checkpoint: str,
    embedder: Embedder,
    chunking: ChunkConfig = ChunkConfig(),
    rules: RuleSet = RuleSet(),
    available_now: bool = True,
) -> StreamingQuery:
    """Write documents, chunks with vectors, and mentions of a stream of texts.

    Each micro-batch writes one folder named by its number, so a batch that is
    repeated after a failure overwrites what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{root}/documents/{part}")
        stored = batch.sparkSession.read.parquet(f"{root}/documents/{part}")
        chunks = chunk_documents(stored, chunking).withColumn("vector", embed(F.col("content"), embedder))
        chunks.write.mode("overwrite").parquet(f"{root}/chunks/{part}")
        extract(stored, rules).write.mode("overwrite").parquet(f"{root}/mentions/{part}")

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def answer_delta(line: Column) -> Column:
    """Text piece in one line of a streamed model answer; NULL for lines without one.

    Understands server-sent `data:` lines and bare JSON lines.
    """
    body = F.regexp_replace(line, r"^data:\s*", "")
    parsed = F.from_json(
        body, "choices array<struct<delta:struct<content:string>>>, message struct<content:string>, response string"
    )
    return F.coalesce(F.get(parsed["choices"], F.lit(0))["delta"]["content"], parsed["message"]["content"], parsed["response"])


def joined_answers(lines: DataFrame) -> DataFrame:
    """(request_id, answer) from (request_id, position, line); lines without text are skipped."""
    pieces = lines.withColumn("_d", answer_delta(F.col("line"))).filter(F.col("_d").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("position", "_d")))
    return pieces.groupBy("request_id").agg(F.array_join(F.transform(ordered, lambda x: x["_d"]), "").alias("answer"))
