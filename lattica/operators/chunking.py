"""Splitting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ChunkConfig:
    # Sizes in bytes.
    chunk_size: int = 1000
    overlap: int = 200
    min_chunk_size: int = 100
    respect_paragraphs: bool = True
    # Pieces below the minimum are dropped unless this is set.
    keep_tail: bool = False

    def __post_init__(self):
        if self.overlap > self.chunk_size - BREAK_WINDOW - 4:
            raise ValueError("overlap must leave more than the break window and one character, or chunks may not advance")


# Bytes searched for a break on either side of the target, and
# the breaks in the order they are preferred (a paragraph break before these,
# a line break after them).
BREAK_WINDOW = 100
SENTENCE_BREAKS = (". ", "。", "! ", "? ", ".\n", "。\n", "!\n", "?\n")

CHUNK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("content", T.StringType()),
            T.StructField("start_offset", T.LongType()),
            T.StructField("end_offset", T.LongType()),
        ]
    )
)

_BREAKS = tuple(b.encode() for b in ("\n\n", *SENTENCE_BREAKS, "\n"))


class _Text:
    """Bytes of a text and the places where it may be cut."""

    def __init__(self, data: bytes):
        self.data = data

    def floor(self, at: int) -> int:
        """The last character start up to a byte position; a character has at most four bytes."""
        if at >= len(self.data):
            return len(self.data)
        return next((i for i in (at, at - 1, at - 2) if not 0x80 <= self.data[i] < 0xC0), at - 3)

    def last_break(self, low: int, high: int) -> int | None:
        """End of the last break of the best kind that lies between two positions."""
        window = self.data[low:high]
        places = ((window.rfind(mark), mark) for mark in _BREAKS)
        return next((low + n + len(mark) for n, mark in places if n >= 0), None)


def split_spans(data: bytes, config: ChunkConfig) -> list[tuple[int, int]]:
    """Byte spans of the chunks of one text."""
    size, text = len(data), _Text(data)
    if size <= config.chunk_size:
        return [(0, size)]
    spans, start, end = [], 0, 0
    while end < size:
        end = text.floor(start + config.chunk_size)
        if end < size and config.respect_paragraphs:
            window = text.floor(max(end - BREAK_WINDOW, 0)), text.floor(end + BREAK_WINDOW)
            end = text.last_break(*window) or end
        if config.keep_tail or end - start >= config.min_chunk_size:
            spans.append((start, end))
        start = text.floor(end - config.overlap if end > config.overlap else end)
    return spans


def split_text(text: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Array of the overlapping chunks of a text with their byte offsets.

    Where a chunk starts depends on where the previous one broke, which no
    window can express; each text is cut in one pass over its bytes inside an
    Arrow batch.  A projection: no shuffle.
    """

    @F.pandas_udf(CHUNK_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for value in texts:
                data = (value or "").encode()
                out.append([(data[a:b].decode(), a, b) for a, b in split_spans(data, config)])
            yield pd.Series(out, dtype=object)

    return run(text)


def chunk_documents(
    documents: DataFrame, config: ChunkConfig = ChunkConfig(), document_id: str = "document_id", text: str = "text"
) -> DataFrame:
    """(document_id, chunk_index, content, start_offset, end_offset)."""
    return documents.select(document_id, F.posexplode(split_text(F.col(text), config)).alias("chunk_index", "_c")).select(
        document_id, F.col("chunk_index").cast("bigint").alias("chunk_index"), "_c.*"
    )


def chunk_sections(sections: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of sectioned documents, numbered across the sections of a document.

    `sections` has (document_id, section_index, title, start_page, content);
    offsets count from the start of the section.
    """
    pieces = sections.select(
        "document_id", "section_index", "title", "start_page", F.posexplode(split_text(F.col("content"), config)).alias("_i", "_c")
    )
    order = Window.partitionBy("document_id").orderBy("section_index", "_i")
    return pieces.select(
        "document_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("chunk_index"),
        "_c.*",
        F.col("start_page").alias("page"),
        F.col("title").alias("section"),
    )


def fixed_chunks(
    documents: DataFrame, size: int = 1000, overlap: int = 200, document_id: str = "document_id", text: str = "text"
) -> DataFrame:
    """Windows of a fixed number of characters at a fixed stride, built from plain expressions."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return documents.select(document_id, text, F.posexplode(starts).alias("chunk_index", "_start")).select(
        document_id,
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("_start").cast("bigint").alias("start_offset"),
        F.least(F.col("_start") + size, F.length(text)).cast("bigint").alias("end_offset"),
        F.substring(F.col(text), F.col("_start") + 1, F.lit(size)).alias("content"),
    )


def line_chunks(documents: DataFrame, document_id: str = "document_id", text: str = "text") -> DataFrame:
    """One chunk per non-empty line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    return documents.select(document_id, F.posexplode(lines).alias("chunk_index", "content")).withColumn(
        "chunk_index", F.col("chunk_index").cast("bigint")
    )


def overlap_violations(chunks: DataFrame, document_id: str = "document_id") -> DataFrame:
    """Chunks the next chunk of which starts after they end."""
    order = Window.partitionBy(document_id).orderBy("chunk_index")
    return chunks.withColumn("next_start", F.lead("start_offset").over(order)).filter(
        F.col("next_start") > F.col("end_offset")
    )


def register_sql(spark: SparkSession, config: ChunkConfig = ChunkConfig()) -> None:
    """Make ``chunk_text(text)`` callable in a FROM clause."""

    @F.udtf(returnType="chunk_index: bigint, content: string, start_offset: bigint, end_offset: bigint")
    class ChunkText:
        def eval(self, text: str):
            data = (text or "").encode()
            for i, (a, b) in enumerate(split_spans(data, config)):
                yield i, data[a:b].decode(), a, b

    spark.udtf.register("chunk_text", ChunkText)
