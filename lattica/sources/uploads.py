"""Uploaded documents: base64 contents checked before they enter the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import strip

# Largest upload, and leading bytes of the binary types.
MAX_FILE_SIZE = 50 * 1024 * 1024
MAGIC_BYTES = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}
# Rejection reasons.
EMPTY_TITLE = "Title cannot be empty"
EMPTY_CONTENT = "Content cannot be empty"
BAD_BASE64 = "Invalid base64 content"
TOO_LARGE = "File size exceeds maximum allowed size of 50MB"
BAD_PDF = "Invalid PDF file: magic bytes do not match"
BAD_DOCX = "Invalid DOCX file: magic bytes do not match (expected ZIP signature)"
NOT_UTF8 = "Content is not valid UTF-8"


def validate(uploads: DataFrame) -> DataFrame:
    """Add bytes and problem (NULL when the upload is acceptable).

    `uploads` has (title, content, file_type) with base64 content.  Expressions
    only: the check runs inside the scan stage.
    """
    decoded = uploads.withColumn("bytes", F.try_to_binary("content", F.lit("base64")))
    kind = F.lower("file_type")
    data = F.col("bytes")
    starts = {k: F.substring(data, 1, len(v)) == F.lit(v) for k, v in MAGIC_BYTES.items()}
    problem = (
        F.when(strip(F.col("title")) == "", EMPTY_TITLE)
        .when(F.coalesce(F.col("content"), F.lit("")) == "", EMPTY_CONTENT)
        .when(data.isNull(), BAD_BASE64)
        .when(F.octet_length(data) > MAX_FILE_SIZE, TOO_LARGE)
        .when((kind == "pdf") & ~starts["pdf"], BAD_PDF)
        .when((kind == "docx") & ~starts["docx"], BAD_DOCX)
        .when(~kind.isin("pdf", "docx") & ~F.is_valid_utf8(data.cast("string")), NOT_UTF8)
    )
    return decoded.withColumn("problem", problem)


def accepted_texts(validated: DataFrame) -> DataFrame:
    """Text uploads that passed, with their content decoded."""
    return validated.filter(F.col("problem").isNull() & ~F.lower("file_type").isin("pdf", "docx")).withColumn(
        "text", F.col("bytes").cast("string")
    )


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("problem").isNotNull()).drop("bytes", "content")
