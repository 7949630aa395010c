"""Document listing, access control and review queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as text_functions
from lattica.functions.access import level_rank, visible_by_principal
from lattica.operators import catalog, review
from lattica.plans import tables
from lattica.plans.registry import query
from lattica.session import new_folder
from lattica.sources import lookup


def _principals_sql(columns: str) -> str:
    parts = [
        f"SELECT '{p.user_id}' AS user_id, {columns} FROM docs WHERE {tables.acl_sql(name)}"
        for name, p in tables.PRINCIPALS.items()
    ]
    return " UNION ALL ".join(parts)


@query(sql=tables.with_sql(tables.DOCUMENTS_SQL) + _principals_sql("document_id, access_level"), headline=True)
def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents each principal may read."""
    docs = tables.documents(spark, sf_dir)
    return visible_by_principal(docs, list(tables.PRINCIPALS.values())).select("user_id", "document_id", "access_level")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL)
    + "SELECT user_id, access_level, CAST(CASE access_level WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 ELSE 3 END AS BIGINT) AS level_rank, count(*) AS documents FROM ("
    + _principals_sql("document_id, access_level")
    + ") GROUP BY ALL"
)
def visible_counts_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each level a principal sees."""
    seen = visible_by_principal(tables.documents(spark, sf_dir), list(tables.PRINCIPALS.values()))
    return seen.groupBy("user_id", "access_level", level_rank(F.col("access_level")).cast("bigint").alias("level_rank")).agg(
        F.count("*").alias("documents")
    )


_LISTED = f"SELECT * FROM live WHERE {tables.acl_sql('manager')} ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 20"


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.LIVE_SQL, tables.CHUNKS_SQL)
    + f"""SELECT document_id, title, file_type, access_level, department, created_at,
  (SELECT count(*) FROM chunk_rows c WHERE c.document_id = p.document_id) AS chunk_count FROM ({_LISTED}) p"""
)
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of the documents a manager may read, newest first."""
    docs = catalog.matching(tables.live_documents(spark, sf_dir), tables.PRINCIPALS["manager"])
    listed = catalog.list_page(docs, tables.chunks(spark, sf_dir), number=2, size=20)
    return listed.select("document_id", "title", "file_type", "access_level", "department", "created_at", "chunk_count")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.LIVE_SQL)
    + f"SELECT count(DISTINCT document_id) AS total FROM live WHERE {tables.acl_sql('manager')}"
)
def document_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents behind the pages."""
    return catalog.total(catalog.matching(tables.live_documents(spark, sf_dir), tables.PRINCIPALS["manager"]))


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.LIVE_SQL)
    + f"""SELECT document_id, title, department FROM live
WHERE {tables.acl_sql('manager')} AND file_type = 'text' AND department = 'src3' AND title ILIKE '%the%'"""
)
def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing narrowed by file type, department and title."""
    found = catalog.matching(
        tables.live_documents(spark, sf_dir), tables.PRINCIPALS["manager"], file_type="text", department="src3", title_contains="the"
    )
    return found.select("document_id", "title", "department")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.LIVE_SQL, tables.CHUNKS_SQL, tables.QUEUE_SQL)
    + """SELECT l.document_id, l.access_level,
  (SELECT count(*) FROM chunk_rows c WHERE c.document_id = l.document_id) AS chunk_count,
  (SELECT count(*) FROM queue q WHERE q.document_id = l.document_id AND q.status = 'approved') AS approved_extractions,
  (SELECT count(*) FROM queue q WHERE q.document_id = l.document_id AND q.status = 'pending') AS pending_extractions
FROM live l""",
    headline=True,
)
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and reviewed extractions of every live document."""
    stats = catalog.document_stats(tables.live_documents(spark, sf_dir), tables.chunks(spark, sf_dir), tables.queue(spark, sf_dir))
    return stats.select("document_id", "access_level", "chunk_count", "approved_extractions", "pending_extractions")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.LIVE_SQL, tables.CHUNKS_SQL)
    + """SELECT l.document_id, count(c.chunk_index) AS chunk_count,
  count(d.decision_id) FILTER (WHERE d.status = 'approved') AS approved_extractions,
  count(d.decision_id) FILTER (WHERE d.status = 'pending') AS pending_extractions
FROM live l LEFT JOIN chunk_rows c ON c.document_id = l.document_id
LEFT JOIN (SELECT event_id AS decision_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS document_id,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'view' THEN 'pending' ELSE 'rejected' END AS status
  FROM events WHERE event_type IN ('purchase', 'error', 'view')) d ON d.document_id = l.document_id
GROUP BY l.document_id"""
)
def document_stats_multiplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiplied counts of a plain double outer join, computed without the fan-out."""
    queue = tables.read(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error", "view")).select(
        F.get_json_object("props", "$.k").cast("bigint").alias("document_id"),
        F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "pending").otherwise("rejected").alias("status"),
    )
    docs = tables.live_documents(spark, sf_dir).select("document_id", "deleted_at")
    stats = catalog.document_stats_multiplied(docs, tables.chunks(spark, sf_dir), queue)
    return stats.select("document_id", "chunk_count", "approved_extractions", "pending_extractions")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.LIVE_SQL, tables.CHUNKS_SQL)
    + """SELECT access_level, count(*) AS chunks, CAST(sum(strlen(content)) AS BIGINT) AS bytes
FROM chunk_rows JOIN live USING (document_id) GROUP BY access_level"""
)
def live_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of live documents per access level: deleting a document hides its chunks."""
    docs = tables.live_documents(spark, sf_dir)
    sizes = tables.chunks(spark, sf_dir).select("document_id", F.octet_length("content").cast("bigint").alias("size"))
    levels = docs.select("document_id", "access_level")
    return catalog.live_chunks(sizes, docs).join(levels, "document_id").groupBy("access_level").agg(
        F.count("*").alias("chunks"), F.sum("size").alias("bytes")
    )


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL)
    + """SELECT document_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words,
  CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest, substr(text, 1, 100) AS content_key FROM docs"""
)
def document_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, bytes, digest and content key of every document."""
    return tables.documents(spark, sf_dir).select(
        "document_id",
        text_functions.word_count(F.col("text")).alias("words"),
        text_functions.byte_length(F.col("text")).alias("bytes"),
        F.sha2("text", 256).alias("digest"),
        text_functions.content_key(F.col("text")).alias("content_key"),
    )


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL)
    + "SELECT document_id, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS copies FROM docs"
)
def content_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents share each text; groups are counted by digest before the join back."""
    docs = tables.documents(spark, sf_dir).select("document_id", F.sha2("text", 256).alias("digest"))
    counts = docs.groupBy("digest").agg(F.count("*").alias("copies"))
    return docs.join(counts, "digest").select("document_id", "digest", "copies")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL)
    + "SELECT substr(text, 1, 100) AS content_key, count(*) AS documents, count(DISTINCT text) AS distinct_texts, min(document_id) AS first_document FROM docs GROUP BY ALL"
)
def content_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that fusion would treat as the same content."""
    per_text = (
        tables.documents(spark, sf_dir)
        .groupBy(text_functions.content_key(F.col("text")).alias("content_key"), F.sha2("text", 256).alias("digest"))
        .agg(F.count("*").alias("_n"), F.min("document_id").alias("_first"))
    )
    return per_text.groupBy("content_key").agg(
        F.sum("_n").alias("documents"), F.count("*").alias("distinct_texts"), F.min("_first").alias("first_document")
    )


# --- review ---------------------------------------------------------------------


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL)
    + """SELECT extraction_id, title AS document_title, confidence, priority, created_at
FROM queue WHERE status = 'pending' AND confidence <= 0.6::DOUBLE ORDER BY priority, created_at, extraction_id LIMIT 20"""
)
def pending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of uncertain pending extractions in review order."""
    rows = review.pending_page(tables.queue(spark, sf_dir), tables.documents(spark, sf_dir), max_confidence=0.6)
    return rows.select("extraction_id", "document_title", "confidence", "priority", "created_at")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL)
    + "SELECT count(*) AS total FROM queue WHERE status = 'pending' AND confidence <= 0.6::DOUBLE"
)
def pending_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending extractions behind the page, with the page's filters."""
    return catalog.total(review.pending(tables.queue(spark, sf_dir), tables.documents(spark, sf_dir), max_confidence=0.6))


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL)
    + """SELECT extraction_id, title AS document_title, 'entity' AS extraction_type, n AS text, 'Number' AS entity_type,
  CAST(0 AS BIGINT) AS start, CAST(length(n) AS BIGINT) AS "end", NULL::VARCHAR AS subject, NULL::VARCHAR AS predicate, NULL::VARCHAR AS object
FROM (SELECT *, unnest(numbers) AS n FROM queue WHERE status = 'pending')
UNION ALL
SELECT extraction_id, title, 'relation', NULL, NULL, NULL, NULL, source, 'writtenIn', lang FROM queue WHERE status = 'pending' AND len(numbers) > 0""",
    headline=True,
)
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pending entity and relation as one row."""
    rows = review.pending(tables.queue(spark, sf_dir), tables.documents(spark, sf_dir))
    return review.items(rows, ["extraction_id", "document_title"])


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL)
    + """SELECT s.*, CASE WHEN entity_approved + entity_rejected > 0 THEN entity_approved / (entity_approved + entity_rejected)::DOUBLE * 100 ELSE 0::DOUBLE END AS entity_approval_rate,
  CASE WHEN relation_approved + relation_rejected > 0 THEN relation_approved / (relation_approved + relation_rejected)::DOUBLE * 100 ELSE 0::DOUBLE END AS relation_approval_rate
FROM (SELECT count(*) FILTER (WHERE status = 'pending') AS total_pending, count(*) FILTER (WHERE status = 'approved') AS total_approved,
  count(*) FILTER (WHERE status = 'rejected') AS total_rejected,
  CAST(coalesce(sum(e) FILTER (WHERE status = 'pending'), 0) AS BIGINT) AS entity_pending, CAST(coalesce(sum(e) FILTER (WHERE status = 'approved'), 0) AS BIGINT) AS entity_approved,
  CAST(coalesce(sum(e) FILTER (WHERE status = 'rejected'), 0) AS BIGINT) AS entity_rejected,
  count(*) FILTER (WHERE status = 'approved' AND confidence >= 0.9::DOUBLE AND e > 0) AS entity_auto_approved,
  CAST(coalesce(sum(r) FILTER (WHERE status = 'pending'), 0) AS BIGINT) AS relation_pending, CAST(coalesce(sum(r) FILTER (WHERE status = 'approved'), 0) AS BIGINT) AS relation_approved,
  CAST(coalesce(sum(r) FILTER (WHERE status = 'rejected'), 0) AS BIGINT) AS relation_rejected,
  count(*) FILTER (WHERE status = 'approved' AND confidence >= 0.9::DOUBLE AND r > 0) AS relation_auto_approved
  FROM (SELECT *, len(numbers) AS e, CASE WHEN len(numbers) > 0 THEN 1 ELSE 0 END AS r FROM queue)) s"""
)
def verify_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and approval percentages of the review queue."""
    return review.verify_stats(tables.queue(spark, sf_dir))


def _mixed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity and relation rows with a status: sure pending rows are approved on arrival."""
    queue = tables.queue(spark, sf_dir)
    status = F.when(F.col("status") == "pending", review.initial_status(F.col("confidence"))).otherwise(F.col("status"))
    kinds = F.filter(
        F.array(F.lit("entity"), F.when(F.json_array_length("extracted_relations") > 0, F.lit("relation"))), lambda k: k.isNotNull()
    )
    return queue.select(F.explode(kinds).alias("kind"), status.alias("status"))


def _queue_stats_sql() -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{k}' AND status = '{s}') AS {s}_{k}"
        for k in ("entity", "relation")
        for s in ("pending", "approved", "auto_approved", "rejected")
    )
    extra = ", ".join(
        f"pending_{k} + approved_{k} + auto_approved_{k} + rejected_{k} AS total_{k}, "
        f"CASE WHEN approved_{k} + auto_approved_{k} + rejected_{k} > 0 THEN (approved_{k} + auto_approved_{k}) / (approved_{k} + auto_approved_{k} + rejected_{k})::DOUBLE ELSE 0::DOUBLE END AS {k}_approval_rate"
        for k in ("entity", "relation")
    )
    return (
        tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL)
        + f"""SELECT s.*, {extra} FROM (SELECT {counts} FROM (
  SELECT 'entity' AS kind, CASE WHEN status = 'pending' AND confidence >= 0.95::DOUBLE THEN 'auto_approved' ELSE status END AS status FROM queue
  UNION ALL SELECT 'relation', CASE WHEN status = 'pending' AND confidence >= 0.95::DOUBLE THEN 'auto_approved' ELSE status END FROM queue WHERE len(numbers) > 0)) s"""
    )


@query(sql=_queue_stats_sql())
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, totals and approval rates of the queue."""
    return review.queue_stats(_mixed_queue(spark, sf_dir))


def _decided_sql(order: str, guard: str) -> str:
    return (
        tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL, tables.DECISIONS_SQL)
        + f"""SELECT q.extraction_id, CASE WHEN {guard} AND d.action IS NOT NULL THEN d.action ELSE q.status END AS status,
  CASE WHEN {guard} THEN d.reviewer END AS reviewer_id,
  CASE WHEN {guard} THEN CASE d.action WHEN 'rejected' THEN 'REJECTED: ' || d.reason || chr(10) || d.notes ELSE d.notes END END AS review_notes
FROM queue q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY reviewed_at {order}, decision_id {order}) AS rn FROM decisions) WHERE rn = 1) d
ON d.extraction_id = q.extraction_id"""
    )


@query(sql=_decided_sql("ASC", "q.status = 'pending'"))
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue after the decision log: the first decision on a pending row stands."""
    decided = review.decide(tables.queue(spark, sf_dir), tables.decisions(spark, sf_dir))
    return decided.select("extraction_id", "status", "reviewer_id", "review_notes")


@query(sql=_decided_sql("DESC", "TRUE"))
def review_latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue after the decision log when any state can be decided again."""
    decided = review.decide_latest(tables.queue(spark, sf_dir), tables.decisions(spark, sf_dir))
    return decided.select("extraction_id", "status", "reviewer_id", "review_notes")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL, tables.DECISIONS_SQL)
    + """SELECT q.extraction_id, CASE WHEN q.status = 'pending' AND d.action = 'approved'
    THEN '[{"text":"' || d.reviewer || '","entity_type":"Reviewer","start":0,"end":1}]'
    ELSE '[' || array_to_string(list_transform(q.numbers, lambda n: '{"text":"' || n || '","entity_type":"Number","start":0,"end":' || length(n) || '}'), ',') || ']' END AS extracted_entities
FROM queue q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY reviewed_at, decision_id) AS rn FROM decisions) WHERE rn = 1) d
ON d.extraction_id = q.extraction_id"""
)
def review_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals that replace the entity list by a corrected item."""
    fix = F.concat(F.lit('{"text":"'), "reviewer", F.lit('","entity_type":"Reviewer","start":0,"end":1}'))
    decisions = tables.decisions(spark, sf_dir).withColumn("corrected_entity", fix)
    return review.decide(tables.queue(spark, sf_dir), decisions).select("extraction_id", "extracted_entities")


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL, tables.QUEUE_SQL)
    + "SELECT status, count(*) AS extractions, CAST(sum(len(numbers)) AS BIGINT) AS entities FROM queue GROUP BY status"
)
def extractions_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and items per state."""
    return tables.queue(spark, sf_dir).groupBy("status").agg(
        F.count("*").alias("extractions"), F.sum(F.json_array_length("extracted_entities").cast("bigint")).alias("entities")
    )


@query(
    sql="""SELECT doc_id AS document_id, CASE lang WHEN 'en' THEN 'a.' || source || '.TXT' WHEN 'de' THEN source || '.pdf' WHEN 'es' THEN source || '/x.Docx' ELSE source END AS path,
  CASE lang WHEN 'en' THEN 'text' WHEN 'de' THEN 'pdf' WHEN 'es' THEN 'docx' ELSE 'unknown' END AS file_type,
  CASE lang WHEN 'en' THEN 'text/plain' WHEN 'de' THEN 'application/pdf' WHEN 'es' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS mime_type FROM documents"""
)
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and MIME types of document paths."""
    path = (
        F.when(F.col("lang") == "en", F.concat(F.lit("a."), "source", F.lit(".TXT")))
        .when(F.col("lang") == "de", F.concat("source", F.lit(".pdf")))
        .when(F.col("lang") == "es", F.concat("source", F.lit("/x.Docx")))
        .otherwise(F.col("source"))
    )
    paths = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), path.alias("path"))
    kind = text_functions.file_type(F.col("path"))
    return paths.withColumn("file_type", kind).withColumn("mime_type", text_functions.mime_type(F.col("file_type")))


@query(
    sql="""SELECT doc_id AS document_id, CASE WHEN lang = 'fr' AND n_chars < 500 THEN 'Title cannot be empty'
  WHEN lang = 'de' THEN 'Invalid PDF file: magic bytes do not match' WHEN lang = 'es' THEN 'Invalid DOCX file: magic bytes do not match (expected ZIP signature)' END AS problem,
  CASE WHEN lang = 'en' OR (lang = 'fr' AND n_chars >= 500) THEN sha256(text) END AS accepted_digest FROM documents"""
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent as base64 uploads: untitled ones and texts posing as PDF or DOCX are rejected."""
    from lattica.sources import uploads

    docs = tables.read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "pdf").when(F.col("lang") == "es", "DOCX").otherwise("txt")
    sent = docs.select(
        F.col("doc_id").alias("document_id"),
        F.when((F.col("lang") == "fr") & (F.col("n_chars") < 500), " \n").otherwise(F.col("source")).alias("title"),
        F.base64(F.encode("text", "UTF-8")).alias("content"),
        kind.alias("file_type"),
    )
    digest = F.when(F.col("problem").isNull(), F.sha2("bytes", 256))
    return uploads.validate(sent).select("document_id", "problem", digest.alias("accepted_digest"))


@query(
    sql=tables.with_sql(tables.DOCUMENTS_SQL)
    + "SELECT document_id, title, source FROM docs WHERE document_id IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events)"
)
def documents_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids the payloads of events name, looked up in a table laid out for that."""
    folder = new_folder(spark)
    lookup.write(tables.documents(spark, sf_dir).select("document_id", "title", "source"), folder, "document_id")
    named = tables.read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k")).distinct()
    return lookup.find(spark, folder, "document_id", [r.k for r in named.limit(lookup.MOST_KEYS + 1).collect()])
