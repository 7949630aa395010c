"""The engine's tables, derived from the given ones.

The given tables carry no access rules, queue or graph, so these are defined
from their columns: languages stand for access levels, sources for
departments, labels for review outcomes, the trade tables for the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.access import Principal
from lattica.session import plain_unions, text_batches

PRINCIPALS = {
    "guest": Principal("guest"),
    "employee": Principal("user2", roles=("clerk",), is_internal=True),
    "manager": Principal("mgr1", roles=("analyst",), departments=("src2", "src5"), is_internal=True),
    "owner": Principal("owner_src7", departments=("src7",), is_internal=True),
}

_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


SCHEMAS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "region": "r_regionkey int, r_name string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its declared schema spares a job that reads footers."""
    plain_unions(spark)
    text_batches(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def access_level(lang: Column) -> Column:
    return (
        F.when(lang == "en", "public").when(lang == "de", "internal").when(lang == "es", "confidential").otherwise("restricted")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with access rules; titles are first lines, file types follow the language."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        "text",
        "lang",
        "source",
        F.when(F.col("lang") == "en", "text").when(F.col("lang") == "de", "pdf").when(F.col("lang") == "es", "docx").otherwise("markdown").alias("file_type"),
        access_level(F.col("lang")).alias("access_level"),
        F.concat(F.lit("owner_"), "source").alias("owner_id"),
        F.col("source").alias("department"),
        F.array(F.when(F.col("n_chars") > 2000, "analyst").otherwise("clerk")).alias("required_roles"),
        F.array(F.concat(F.lit("user"), F.floor(F.col("n_chars") / 1000).cast("string"))).alias("allowed_users"),
        (F.lit(_EPOCH) + F.col("n_chars") * 60).alias("created_at"),
    )


def live_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with deleted_at: those labelled toxic are soft-deleted."""
    toxic = read(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("document_id"), F.lit(_EPOCH).alias("deleted_at"))
    return documents(spark, sf_dir).join(toxic, "document_id", "left")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.operators.chunking import line_chunks

    return line_chunks(documents(spark, sf_dir))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction per document: labelled ones are decided, the others pending.

    Long numbers are its entities (as JSON), source and language its relation.
    """
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    numbers = F.regexp_extract_all("text", F.lit(r"[0-9]{4,}"), F.lit(0))
    entity = F.transform(
        numbers,
        lambda n: F.concat(F.lit('{"text":"'), n, F.lit('","entity_type":"Number","start":0,"end":'), F.length(n).cast("string"), F.lit("}")),
    )
    relation = F.concat(
        F.lit('[{"subject":"'), "source", F.lit('","predicate":"writtenIn","object":"'), "lang", F.lit('"}]')
    )
    # Everything derived from the text is derived before the join, so the text is not shuffled.
    extracted = documents(spark, sf_dir).select(
        F.col("document_id").alias("extraction_id"),
        "document_id",
        F.concat(F.lit("["), F.array_join(entity, ","), F.lit("]")).alias("extracted_entities"),
        F.when(F.size(numbers) > 0, relation).otherwise("[]").alias("extracted_relations"),
        F.round(F.least(F.octet_length("text") / 5000.0, F.lit(1.0)), 4).alias("confidence"),
        F.octet_length("source").cast("bigint").alias("priority"),
        "created_at",
    )
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("pending").alias("status")
    return extracted.join(labels, "document_id", "left").select(
        "extraction_id", "document_id", "extracted_entities", "extracted_relations", status, "confidence", "priority", "created_at"
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions: purchases approve and errors reject the extraction their payload names."""
    return (
        read(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "error"))
        .select(
            F.get_json_object("props", "$.k").cast("bigint").alias("extraction_id"),
            F.col("event_id").alias("decision_id"),
            F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("action"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("reviewer"),
            F.col("event_type").alias("reason"),
            F.col("props").alias("notes"),
            F.col("ts").alias("reviewed_at"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one row per event."""
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"), "props"
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and orders as graph nodes."""

    def part(table: str, node_class: str, prefix: str, key: str, text: Column, confidence: float, **props: Column) -> DataFrame:
        pairs = [x for k, v in {"text": text, **props}.items() for x in (F.lit(k), v.cast("string"))]
        return read(spark, sf_dir, table).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"),
            F.lit(node_class).alias("class"),
            text.alias("text"),
            F.create_map(*pairs).alias("properties"),
            F.col(key).cast("bigint").alias("document_id"),
            F.lit(confidence).alias("confidence"),
        )

    return (
        part("region", "Region", "r", "r_regionkey", F.col("r_name"), 1.0)
        .unionByName(part("nation", "Nation", "n", "n_nationkey", F.col("n_name"), 0.95))
        .unionByName(part("customer", "Customer", "c", "c_custkey", F.col("c_name"), 0.9, segment=F.col("c_mktsegment")))
        .unionByName(part("supplier", "Supplier", "s", "s_suppkey", F.col("s_name"), 0.85))
        .unionByName(
            part("orders", "Order", "o", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), 0.8,
                 priority=F.col("o_orderpriority"), status=F.col("o_orderstatus"))
        )
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation -> region, customer -> nation, supplier -> nation, customer -> order."""

    def part(table: str, predicate: str, src: tuple[str, str], dst: tuple[str, str], confidence: float) -> DataFrame:
        return read(spark, sf_dir, table).select(
            F.concat(F.lit(src[0]), F.col(src[1]).cast("string")).alias("src"),
            F.lit(predicate).alias("predicate"),
            F.concat(F.lit(dst[0]), F.col(dst[1]).cast("string")).alias("dst"),
            F.lit(confidence).alias("confidence"),
        )

    return (
        part("nation", "inRegion", ("n", "n_nationkey"), ("r", "n_regionkey"), 0.95)
        .unionByName(part("customer", "inNation", ("c", "c_custkey"), ("n", "c_nationkey"), 0.9))
        .unionByName(part("supplier", "inNation", ("s", "s_suppkey"), ("n", "s_nationkey"), 0.85))
        .unionByName(part("orders", "placed", ("c", "o_custkey"), ("o", "o_orderkey"), 0.8))
    )


# --- the same derivations as SQL, for independent checks -----------------------

DOCUMENTS_SQL = f"""
docs AS (
  SELECT doc_id AS document_id, string_split(text, chr(10))[1] AS title, text, lang, source, n_chars,
    CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'pdf' WHEN 'es' THEN 'docx' ELSE 'markdown' END AS file_type,
    CASE lang WHEN 'en' THEN 'public' WHEN 'de' THEN 'internal' WHEN 'es' THEN 'confidential' ELSE 'restricted' END AS access_level,
    'owner_' || source AS owner_id, source AS department,
    CASE WHEN n_chars > 2000 THEN 'analyst' ELSE 'clerk' END AS required_role,
    'user' || CAST(n_chars // 1000 AS VARCHAR) AS allowed_user,
    CAST({_EPOCH} + n_chars * 60 AS BIGINT) AS created_at
  FROM documents)"""

LIVE_SQL = """
live AS (SELECT d.* FROM docs d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.document_id AND l.toxic = 1))"""

CHUNKS_SQL = """
chunk_rows AS (
  SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS chunk_index, line AS content
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
  WHERE line <> '')"""

QUEUE_SQL = """
queue AS (
  SELECT d.document_id AS extraction_id, d.document_id, d.title, d.lang, d.source, d.created_at,
    regexp_extract_all(d.text, '[0-9]{4,}') AS numbers,
    CASE l.quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS status,
    round(least(strlen(d.text) / 5000.0::DOUBLE, 1.0::DOUBLE), 4) AS confidence,
    CAST(strlen(d.source) AS BIGINT) AS priority
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.document_id)"""

DECISIONS_SQL = """
decisions AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS extraction_id, event_id AS decision_id,
    CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS action,
    'user' || CAST(user_id AS VARCHAR) AS reviewer, event_type AS reason, props AS notes, ts AS reviewed_at
  FROM events WHERE event_type IN ('purchase', 'error'))"""

GRAPH_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS node_id, 'Region' AS class, r_name AS text, '' AS shown, CAST(1.0 AS DOUBLE) AS confidence FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name, '', 0.95 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name, ' - segment: ' || c_mktsegment, 0.9 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name, '', 0.85 FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'Order', 'Order#' || o_orderkey, ' - priority: ' || o_orderpriority || ' - status: ' || o_orderstatus, 0.8 FROM orders),
edges AS (
  SELECT 'n' || n_nationkey AS src, 'inRegion' AS predicate, 'r' || n_regionkey AS dst, CAST(0.95 AS DOUBLE) AS confidence FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey, 0.9 FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey, 0.85 FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'placed', 'o' || o_orderkey, 0.8 FROM orders),
steps AS (SELECT src AS node_id, dst AS neighbor FROM edges UNION ALL SELECT dst, src FROM edges)"""


def acl_sql(name: str) -> str:
    """Condition under which a principal may read a row of docs, as SQL."""
    p = PRINCIPALS[name]
    roles = "(" + ", ".join(f"'{r}'" for r in p.roles or ("",)) + ")"
    departments = "(" + ", ".join(f"'{d}'" for d in p.departments or ("",)) + ")"
    return (
        "CASE access_level WHEN 'public' THEN TRUE "
        f"WHEN 'internal' THEN {str(p.is_internal).upper()} "
        f"WHEN 'confidential' THEN department IN {departments} OR required_role IN {roles} "
        f"ELSE allowed_user = '{p.user_id}' OR owner_id = '{p.user_id}' END"
    )


def with_sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"
