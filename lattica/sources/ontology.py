"""Ontologies: the default schema, OWL files and validation of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default ontology.
VERSION = "1.0.0"
CLASSES = (
    ("Employee", "직원"),
    ("Department", "부서"),
    ("Position", "직위"),
    ("LeaveType", "휴가유형"),
    ("Policy", "정책"),
    ("ApprovalProcess", "승인절차"),
    ("BenefitType", "복리후생"),
    ("Regulation", "규정"),
)
PROPERTIES = (
    ("belongsTo", "소속", "Employee", "Department"),
    ("manages", "관리", "Employee", "Department"),
    ("requires", "필요", "LeaveType", "ApprovalProcess"),
    ("references", "참조", "Policy", "Regulation"),
    ("appliesTo", "적용대상", "Policy", "Employee"),
)
# Validation messages.
EMPTY_CLASSES = "Classes array cannot be empty"
EMPTY_PROPERTIES = "Properties array cannot be empty"
BAD_CLASS = "Invalid class definition: name and label are required"
BAD_PROPERTY = "Invalid property definition: all fields are required"

# Value types of ontology properties and what they become in a table.
DATA_TYPES = {
    "string": "string",
    "integer": "bigint",
    "float": "double",
    "dateTime": "timestamp",
    "date": "date",
    "decimal": "decimal(10,2)",
    "boolean": "boolean",
}


def default_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, label, None) for n, label in CLASSES], "name string, label string, parent string")


def default_properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROPERTIES), "name string, label string, domain string, range string")


def class_problems(classes: DataFrame) -> DataFrame:
    """Rows that make an update invalid."""
    blank = F.coalesce(F.col("name"), F.lit("")) == ""
    return classes.filter(blank | (F.coalesce(F.col("label"), F.lit("")) == "")).withColumn("problem", F.lit(BAD_CLASS))


def property_problems(properties: DataFrame) -> DataFrame:
    bad = F.lit(False)
    for column in ("name", "label", "domain", "range"):
        bad = bad | (F.coalesce(F.col(column), F.lit("")) == "")
    return properties.filter(bad).withColumn("problem", F.lit(BAD_PROPERTY))


def _local_name(column) -> F.Column:
    return F.regexp_extract(column, r"([^#/]*)$", 1)


def _owl(spark: SparkSession, path: str, tag: str, fields: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(f"`_rdf:about` string, `rdfs:label` string, {fields}").load(path)


def read_owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """(name, label, parent, comment) of an OWL/XML file."""
    raw = _owl(spark, path, "owl:Class", "`rdfs:comment` string, `rdfs:subClassOf` struct<`_rdf:resource`:string>")
    return raw.filter(F.col("`_rdf:about`").isNotNull()).select(
        _local_name(F.col("`_rdf:about`")).alias("name"),
        F.col("`rdfs:label`").alias("label"),
        _local_name(F.col("`rdfs:subClassOf`.`_rdf:resource`")).alias("parent"),
        F.col("`rdfs:comment`").alias("comment"),
    )


def read_owl_properties(spark: SparkSession, path: str) -> DataFrame:
    """(name, label, domain, range, kind) of the object and datatype properties."""
    fields = "`rdfs:domain` struct<`_rdf:resource`:string>, `rdfs:range` struct<`_rdf:resource`:string>"

    def part(tag: str, kind: str) -> DataFrame:
        raw = _owl(spark, path, tag, fields)
        return raw.filter(F.col("`_rdf:about`").isNotNull()).select(
            _local_name(F.col("`_rdf:about`")).alias("name"),
            F.col("`rdfs:label`").alias("label"),
            _local_name(F.col("`rdfs:domain`.`_rdf:resource`")).alias("domain"),
            _local_name(F.col("`rdfs:range`.`_rdf:resource`")).alias("range"),
            F.lit(kind).alias("kind"),
        )

    return part("owl:ObjectProperty", "object").unionByName(part("owl:DatatypeProperty", "datatype"))
