"""Sections of extracted text by heading heuristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import heading_level, is_header, strip


def text_lines(documents: DataFrame, document_id: str = "document_id", text: str = "text") -> DataFrame:
    return documents.select(document_id, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def sections(documents: DataFrame, document_id: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, section_index, title, level, start_page, content).

    A heading opens a section and the lines up to the next heading are its
    body; text before the first heading forms an untitled section.  One shuffle
    by document serves the running counts and the grouping.
    """
    running = Window.partitionBy(document_id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        text_lines(documents, document_id, text)
        .withColumn("header", is_header(F.col("line")))
        .withColumn("page", 1 + F.sum(F.col("line").contains("\f").cast("bigint")).over(running))
        .withColumn("section_index", F.sum(F.col("header").cast("bigint")).over(running))
    )
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("line_no", "line")))), lambda x: x["line"]
        ),
        "\n",
    )
    grouped = marked.groupBy(document_id, "section_index").agg(
        F.max(F.when(F.col("header"), strip(F.col("line")))).alias("title"),
        F.coalesce(F.max(F.when(F.col("header"), heading_level(F.col("line")))), F.lit(1)).cast("bigint").alias("level"),
        F.min("page").alias("start_page"),
        strip(body).alias("content"),
    )
    return grouped.filter(F.col("title").isNotNull() | (F.col("content") != ""))


def page_count(text):
    """Pages of a text with form feeds, NULL without any."""
    feeds = F.regexp_count(text, F.lit("\f"))
    return F.when(feeds > 0, (feeds + 1).cast("bigint"))


def parsed_title(first_section_title, text):
    """Title of the first section, else a short first line."""
    line = strip(F.get(F.split(text, "\n"), F.lit(0)))
    return F.coalesce(first_section_title, F.when((line != "") & (F.octet_length(line) < 200), line))
