"""JSON question sets and document metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUESTION = (
    "id string, category string, question string, question_en string, expected_answer string, "
    "expected_sources array<struct<document:string,page:int,section:string,slide:int>>, keywords array<string>, difficulty string"
)
_ACL = "struct<access_level:string,department:string,required_roles:array<string>,allowed_users:array<string>>"
_DOCUMENT = (
    "id string, title string, title_ko string, filename string, file_type string, pages int, slides int, sheets array<string>, "
    "language string, description string, sections array<struct<number:string,title:string,start_page:int>>, "
    f"acl {_ACL}, entities array<string>, created_at string, updated_at string, ocr_required boolean, is_archived boolean"
)
_SCENARIO = (
    "name string, user struct<id:string,roles:array<string>,is_internal:boolean>, "
    "expected_visible array<string>, expected_hidden array<string>"
)


def _struct(fields: str) -> str:
    """Column list as the type of one array element."""
    return "array<struct<" + ",".join(_typed(f) for f in _split(fields)) + ">>"


def _split(fields: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


def _typed(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}:{kind}"


def _rows(spark: SparkSession, path: str, key: str, fields: str) -> DataFrame:
    raw = spark.read.schema(f"{key} {_struct(fields)}").json(path, multiLine=True)
    return raw.select(F.inline(key))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question."""
    return _rows(spark, path, "questions", _QUESTION)


def expected_sources(questions: DataFrame) -> DataFrame:
    """(request_id, document, page, section) a good retrieval must find."""
    return questions.select(F.col("id").alias("request_id"), F.inline("expected_sources"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document metadata with the ACL flattened to the usual columns."""
    rows = _rows(spark, path, "documents", _DOCUMENT)
    empty = F.array().cast("array<string>")
    return rows.select(
        "*",
        F.coalesce("acl.access_level", F.lit("internal")).alias("access_level"),
        F.lit(None).cast("string").alias("owner_id"),
        F.col("acl.department").alias("department"),
        F.coalesce("acl.required_roles", empty).alias("required_roles"),
        F.coalesce("acl.allowed_users", empty).alias("allowed_users"),
    )


def read_access_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Users with the documents they must and must not see."""
    return _rows(spark, path, "test_scenarios", _SCENARIO)
