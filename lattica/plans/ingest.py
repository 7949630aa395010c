"""Batch ingest of a folder: parse, chunk by section, embed, extract, load the graph and write the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica import schemas
from lattica.config import Settings
from lattica.functions.text import stable_id
from lattica.operators import chunking, graph, mentions, relations, review
from lattica.operators import sections as headings
from lattica.operators.vectors import Embedder, HashingEmbedder, embed
from lattica.session import plain_unions
from lattica.sources import files, tables
from lattica.sources.snapshots import Snapshots

WRITTEN = ("documents", "sections", "chunks", "vectors", "mentions", "relations", "nodes", "edges")


def declared(df: DataFrame, name: str) -> DataFrame:
    """`df` in the columns and types of a declared table; columns it lacks are null."""
    fields = T._parse_datatype_string(schemas.TABLES[name]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def document_sections(parsed: DataFrame) -> DataFrame:
    """(`document_id`, `section_index`, `title`, `level`, `start_page`, `content`) of parsed documents.

    Sections come from the file where it has some, from the headings of its text
    for PDF, and are the whole text otherwise.
    """
    own = parsed.where(F.size("sections") > 0).select("document_id", F.posexplode("sections").alias("section_index", "s")).select(
        "document_id", F.col("section_index").cast("bigint").alias("section_index"), "s.title", F.col("s.level").cast("bigint").alias("level"),
        F.col("s.start_page").cast("bigint").alias("start_page"), "s.content",
    )
    rest = parsed.where(F.size("sections") == 0)
    pdf = headings.sections(rest.where("file_type = 'pdf'"), text="content")
    whole = rest.where("file_type <> 'pdf'").select(
        "document_id", F.lit(0).cast("bigint").alias("section_index"), F.lit(None).cast("string").alias("title"), F.lit(1).cast("bigint").alias("level"),
        F.lit(None).cast("bigint").alias("start_page"), "content",
    )
    return own.unionByName(pdf.select(*own.columns)).unionByName(whole)


def _unit() -> Column:
    return stable_id(F.col("document_id"), F.lit("section"), F.col("section_index"))


def ingest_folder(
    spark: SparkSession,
    path: str,
    root: str,
    embedder: Embedder | None = None,
    config: chunking.ChunkConfig | None = None,
    decoders: dict | None = None,
    access_level: str = "internal",
    department: str | None = None,
    approve_from: float = review.AUTO_APPROVE_THRESHOLD,
    settings: Settings | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Write the tables of a folder of files under `root`; the result counts rows per table.

    All tables appear together as one version of `Snapshots(spark, root)`, which
    replaces the one before; a run that dies leaves that as it was, and a `batch`
    that is already in is not written again.  Every file is decoded once, into
    `parsed`; all tables derive from it.  Entities and relations are
    found section by section, so each knows its section and page; those of
    confidence `approve_from` and more are loaded into the graph (`nodes`,
    `edges`), the others wait for review.  Tables of `schemas.TABLES` are written
    under these schemas.  Chunks are cut by `config`, else as `settings` say.
    """
    config = config or (settings or Settings()).chunking
    plain_unions(spark)
    known, warehouse = Snapshots(spark, root), root
    if batch is not None and batch in known.manifest()["batches"]:
        return _counted(known)
    root = known.new_folder()
    tables.replace(files.parsed_rows(files.list_files(spark, path), decoders).withColumn("document_id", stable_id(F.col("file_path"))), root, "parsed")
    every = spark.read.parquet(f"{root}/parsed")
    parsed = every.where("error IS NULL")
    tables.replace(every.where("error IS NOT NULL").select("file_path", "file_type", "error"), root, "rejected")
    acl = ["access_level", "owner_id", "department", "required_roles", "allowed_users"]
    rules = [
        F.lit(access_level).alias("access_level"), F.lit(None).cast("string").alias("owner_id"), F.lit(department).cast("string").alias("department"),
        F.array().cast("array<string>").alias("required_roles"), F.array().cast("array<string>").alias("allowed_users"),
    ]
    now = F.current_timestamp()
    documents = parsed.select(
        "document_id", F.coalesce("title", F.regexp_extract("file_path", r"([^/]*)$", 1)).alias("title"), "file_path", "file_type",
        F.octet_length("content").cast("bigint").alias("file_size"), F.sha2("content", 256).alias("file_hash"), *rules,
        F.col("custom").alias("metadata"), now.alias("created_at"), now.alias("updated_at"), now.alias("processed_at"),
    )
    tables.replace(declared(documents, "documents"), root, "documents")
    tables.replace(document_sections(parsed), root, "sections")
    units = spark.read.parquet(f"{root}/sections")

    pieces = chunking.chunk_sections(units, config).withColumn("vector_id", stable_id(F.col("document_id"), F.col("chunk_index")))
    tables.replace(declared(pieces.withColumn("content_hash", F.sha2("content", 256)), "chunks"), root, "chunks")
    written = tables.read_table(spark, root, "chunks")
    vector = embed(F.col("content"), embedder or HashingEmbedder())
    embedded = written.select(F.col("vector_id").alias("id"), "document_id", "chunk_index", "content", vector.alias("vector"), *rules)
    tables.replace(declared(embedded, "vectors").select("id", "document_id", "chunk_index", "content", "vector", *acl), root, "vectors")

    # Sections stand in for documents while texts are searched; their keys lead back.
    keyed = units.withColumn("unit", _unit())
    places = keyed.select(F.col("unit").alias("document_id"), F.col("document_id").alias("_document"), F.col("title").alias("section"), F.col("start_page").alias("page"))
    found = mentions.extract(keyed.select(F.col("unit").alias("document_id"), F.col("content").alias("text")), context_bytes=relations.context_bytes())
    tables.replace(review.enqueue(found, approve_from), root, "_section_mentions")
    in_units = spark.read.parquet(f"{root}/_section_mentions")
    related = review.enqueue(relations.find_relations(in_units), approve_from)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(places, "document_id").withColumn("document_id", F.col("_document")).drop("_document")

    tables.replace(placed(in_units), root, "mentions")
    tables.replace(placed(related), root, "relations")
    all_mentions, all_relations = (spark.read.parquet(f"{root}/{name}") for name in ("mentions", "relations"))
    tables.replace(declared(graph.load_nodes(review.approved(all_mentions)), "nodes"), root, "nodes")
    nodes = tables.read_table(spark, root, "nodes")
    source = F.struct(
        "document_id", F.col("page").cast("int").alias("page"), "section", F.col("subject_start").cast("bigint").alias("offset"), F.col("confidence").cast("double").alias("confidence")
    )
    loaded = graph.load_edges(review.approved(all_relations).withColumn("source", source), nodes, carry=["source"]).withColumn("created_at", now)
    tables.replace(declared(loaded, "edges"), root, "edges")

    known.commit(replaced={name: f"{root}/{name}" for name in (*WRITTEN, "rejected")}, batch=batch)
    return _counted(Snapshots(spark, warehouse))


def _counted(known: Snapshots) -> DataFrame:
    parts = [known.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name in (*WRITTEN, "rejected")]
    return reduce(DataFrame.unionByName, parts)
