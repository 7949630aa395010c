"""Hybrid retrieval over a batch of questions, and its parts as checked queries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import Settings
from lattica.functions.access import Principal, visible_to
from lattica.functions.text import STOPWORDS
from lattica.operators import answers, evaluation, fusion, graph, inverted_index, keyword_search, vectors
from lattica.operators.fusion import RetrievalConfig
from lattica.plans import tables
from lattica.plans.registry import query
from lattica.session import cut_lineage, new_folder

DIMENSION = 64
# Digits of scores in results; ranks are decided on RANK_DIGITS of scoring.
SCORE_DIGITS = 6


class SearchBackend(Protocol):
    """A search whose hits take part in the fusion."""

    name: str
    weight: float

    def search(self, questions: DataFrame) -> DataFrame:
        """(request_id, hit_id string, content, score) and, where known, `place` of the hits of (request_id, question)."""
        ...


# What is known of where a chunk stands; columns a table lacks are left out.
_PLACE = ("document_id", "page", "section")


def _chunk_hits(found: DataFrame) -> DataFrame:
    return found.select("request_id", F.col("item_id").cast("string").alias("hit_id"), "_hit.*", F.round("score", SCORE_DIGITS).alias("score"))


def with_place(chunks: DataFrame) -> DataFrame:
    """Chunks with `_hit`: the content and its `place` (document, page, section), which winners of a search take along."""
    place = F.struct(*[c for c in _PLACE if c in chunks.columns]) if any(c in chunks.columns for c in _PLACE) else None
    return chunks.withColumn("_hit", F.struct("content", *([place.alias("place")] if place is not None else [])))


@dataclass
class VectorBackend:
    """Chunks whose vectors are nearest to the question's; vectors are computed where the table has none."""

    chunks: DataFrame
    embedder: vectors.Embedder
    k: int = 20
    min_score: float | None = None
    weight: float = 1.0
    name: str = "vector"

    def search(self, questions: DataFrame) -> DataFrame:
        asked = questions.select("request_id", vectors.embed(F.col("question"), self.embedder).alias("vector"))
        chunks = with_place(self.chunks)
        if "vector" not in chunks.columns:
            chunks = chunks.withColumn("vector", vectors.embed(F.col("content"), self.embedder))
        return _chunk_hits(vectors.search(chunks, asked, self.k, min_score=self.min_score, id_column="chunk_id", vector="vector", carry="_hit"))


@dataclass
class KeywordBackend:
    """Chunks that hold the question's keywords, from a written index where there is one."""

    chunks: DataFrame
    k: int = 10
    min_score: float | None = None
    index: DataFrame | None = None
    weight: float = 0.8
    name: str = "keyword"

    def search(self, questions: DataFrame) -> DataFrame:
        return _chunk_hits(keyword_search.search(
            with_place(self.chunks), questions, self.k, min_score=self.min_score, id_column="chunk_id", text="content", carry="_hit", index=self.index
        ))


@dataclass
class GraphBackend:
    """Nodes that match the question, what they reach, and their relations."""

    nodes: DataFrame
    edges: DataFrame
    k: int = 20
    depth: int = 2
    min_score: float | None = None
    weight: float = 1.5
    name: str = "graph"

    def search(self, questions: DataFrame) -> DataFrame:
        found = graph.search(self.nodes, self.edges, questions, self.k, depth=self.depth).select("request_id", "hit_id", "content", "score")
        return found if self.min_score is None else found.filter(F.col("score") >= self.min_score)


def retrieve_from(questions: DataFrame, backends: list[SearchBackend], config: RetrievalConfig = RetrievalConfig(), top_k: int | None = None) -> DataFrame:
    """Fused results per question of any searches; of equal contents the first search's hit stays."""
    hits = None
    for backend in backends:
        found = backend.search(questions).withColumn("result_type", F.lit(backend.name))
        hits = found if hits is None else hits.unionByName(found, allowMissingColumns=True)
    return fusion.fuse(hits, config, top_k, weights={b.name: b.weight for b in backends})


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    principal: Principal,
    embedder: vectors.Embedder | None = None,
    config: RetrievalConfig | None = None,
    top_k: int | None = None,
    document_filter: DataFrame | None = None,
    more: list[SearchBackend] | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """Fused results per question from vectors, graph and keywords, and from further searches in `more`.

    `document_filter` (document_id) limits the chunks; `config.min_score` holds
    for the hits of all three searches, `config.graph_depth` for the graph.

    `questions` (request_id, question); `chunks` (chunk_id, content and ACL
    columns, and a vector column when already embedded); `nodes`/`edges` hold
    what the principal may see of the graph.  Access control is applied to the
    chunks before any ranking.  Results carry `place`, the document, page and
    section of a chunk as far as the table knows them.  Depths and weights are
    those of `config`, else of `settings`.
    """
    config = config or (settings or Settings()).retrieval
    readable = visible_to(chunks, principal)
    if document_filter is not None:
        readable = readable.join(document_filter.select("document_id").distinct(), "document_id", "left_semi")
    least = config.min_score or None
    weights = config.weights()
    backends: list[SearchBackend] = [
        VectorBackend(readable, embedder or vectors.HashingEmbedder(DIMENSION), config.vector_top_k, least, weights["vector"]),
        GraphBackend(nodes, edges, config.vector_top_k, config.graph_depth, least, weights["graph"]),
        KeywordBackend(readable, config.keyword_top_k, least, weight=weights["keyword"]),
    ]
    return retrieve_from(questions, [*backends, *(more or [])], config, top_k)


# --- given tables as questions, chunks and graph --------------------------------


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark texts are the question set."""
    return tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("question"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line chunks with ids and the access rules of their documents."""
    docs = tables.documents(spark, sf_dir)
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    acl = ["access_level", "owner_id", "department", "required_roles", "allowed_users"]
    return docs.select("document_id", *acl, F.posexplode(lines).alias("chunk_index", "content")).withColumn(
        "chunk_id", F.concat_ws(":", "document_id", "chunk_index")
    )


def document_graph(spark: SparkSession, sf_dir: str, principal: Principal) -> tuple[DataFrame, DataFrame]:
    """Readable documents, their sources and languages.

    Nodes and edges are asked for in many places; the few columns they are made
    of are written once, so that the texts are read once.
    """
    docs = cut_lineage(visible_to(tables.documents(spark, sf_dir), principal).select("document_id", "title", "source", "lang"))

    def hub(column: str, node_class: str) -> DataFrame:
        return docs.select(column).distinct().select(
            F.concat(F.lit(f"{column}:"), column).alias("node_id"),
            F.lit(node_class).alias("class"),
            F.col(column).alias("text"),
            F.create_map(F.lit("text"), F.col(column)).alias("properties"),
            F.lit(0.5).alias("confidence"),
        )

    doc_id = F.concat(F.lit("doc:"), F.col("document_id").cast("string"))
    nodes = (
        docs.select(
            doc_id.alias("node_id"),
            F.lit("Document").alias("class"),
            F.col("title").alias("text"),
            F.create_map(F.lit("text"), F.col("title"), F.lit("lang"), F.col("lang")).alias("properties"),
            F.lit(0.9).alias("confidence"),
        )
        .unionByName(hub("source", "Source"))
        .unionByName(hub("lang", "Language"))
    )
    edges = docs.select(
        doc_id.alias("src"), F.lit("fromSource").alias("predicate"), F.concat(F.lit("source:"), "source").alias("dst"), F.lit(0.7).alias("confidence")
    ).unionByName(
        docs.select(doc_id.alias("src"), F.lit("inLanguage").alias("predicate"), F.concat(F.lit("lang:"), "lang").alias("dst"), F.lit(0.6).alias("confidence"))
    )
    return nodes, edges


def _results(spark: SparkSession, sf_dir: str, name: str = "manager", top_k: int | None = None) -> DataFrame:
    principal = tables.PRINCIPALS[name]
    nodes, edges = document_graph(spark, sf_dir, principal)
    config = RetrievalConfig(graph_depth=1)
    return retrieve(questions(spark, sf_dir), chunk_table(spark, sf_dir), nodes, edges, principal, config=config, top_k=top_k)


# --- SQL of the parts -----------------------------------------------------------

_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"

QUESTIONS_SQL = "questions AS (SELECT item_id AS request_id, text AS question FROM benchmark)"

TERMS_SQL = f"""
raw_words AS (SELECT request_id, w FROM (SELECT request_id, unnest(regexp_split_to_array(question, '\\s+')) AS w FROM questions)
  WHERE strlen(w) > 1 AND lower(w) NOT IN {_STOP_SQL}),
terms AS (SELECT DISTINCT request_id, lower(w) AS term FROM raw_words),
term_counts AS (SELECT request_id, count(*) AS n_terms FROM terms GROUP BY request_id)"""


def _embed_sql(out: str, source: str, key: str, text: str) -> str:
    return f"""
{out}_words AS (SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h
  FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS w FROM {source}) WHERE w <> ''),
{out} AS (SELECT {key}, h % {DIMENSION} AS position, CAST(sum(1 - 2 * ((h // {DIMENSION}) % 2)) AS DOUBLE) AS weight FROM {out}_words GROUP BY ALL),
{out}_norm AS (SELECT {key}, sqrt(sum(weight * weight)) AS norm FROM {out} GROUP BY {key})"""


def _cosine_sql(out: str, requests: str, items: str, source: str, key: str, k: int) -> str:
    """Top-k of embedded items per embedded request; every pair counts, an empty overlap scores 0."""
    return f"""
{out}_dots AS (SELECT q.request_id, i.{key}, sum(q.weight * i.weight) AS dot FROM {requests} q JOIN {items} i USING (position) GROUP BY ALL),
{out}_scores AS (
  SELECT q.request_id, s.{key},
    round(coalesce(CASE WHEN qn.norm > 0 AND n.norm > 0 THEN d.dot / (qn.norm * n.norm) END, 0::DOUBLE), 12) + 0.0::DOUBLE AS score
  FROM questions q CROSS JOIN (SELECT {key} FROM {source}) s
  LEFT JOIN {requests}_norm qn ON qn.request_id = q.request_id LEFT JOIN {items}_norm n ON n.{key} = s.{key}
  LEFT JOIN {out}_dots d ON d.request_id = q.request_id AND d.{key} = s.{key}),
{out} AS (SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, {key}) AS rank FROM {out}_scores) WHERE rank <= {k})"""


def _keyword_sql(out: str, source: str, key: str, text: str, k: int) -> str:
    return f"""
{out}_tf AS (SELECT {key}, w AS term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS w FROM {source}) GROUP BY ALL),
{out}_scores AS (SELECT t.request_id, f.{key}, round(sum(f.tf / (f.tf + 1.2::DOUBLE)) / any_value(c.n_terms), 12) AS score
  FROM terms t JOIN {out}_tf f USING (term) JOIN term_counts c USING (request_id) GROUP BY t.request_id, f.{key}),
{out} AS (SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, {key}) AS rank FROM {out}_scores WHERE score > 0) WHERE rank <= {k})"""


_CENTROID_SQL = """
WITH centroid AS (
  SELECT label, list(m ORDER BY i) AS vector FROM (
    SELECT label, i, avg(x) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
  GROUP BY label),
"""


def _centroid_search(spark: SparkSession, sf_dir: str, k: int, principal: Principal | None = None) -> DataFrame:
    stored = tables.read(spark, sf_dir, "embeddings")
    asked = vectors.centroids(stored, "label", "embedding", DIMENSION).select(F.col("label").cast("bigint").alias("request_id"), "vector")
    if principal is not None:
        acl = tables.documents(spark, sf_dir).select(
            F.col("document_id").alias("vec_id"), "access_level", "owner_id", "department", "required_roles", "allowed_users"
        )
        stored = stored.join(acl, "vec_id")
    return vectors.search(stored, asked, k, principal=principal)


@query(
    sql=_CENTROID_SQL
    + """scored AS (SELECT c.label AS request_id, e.vec_id, round(list_cosine_similarity(c.vector, e.embedding::DOUBLE[]), 12) AS score
  FROM centroid c CROSS JOIN embeddings e)
SELECT CAST(request_id AS BIGINT) AS request_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20""",
    headline=True,
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to the mean of each label."""
    return _centroid_search(spark, sf_dir, 20).select(
        "request_id", F.col("item_id").alias("vec_id"), F.round("score", SCORE_DIGITS).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


@query(
    sql=_CENTROID_SQL
    + tables.DOCUMENTS_SQL
    + f""",
readable AS (SELECT e.* FROM embeddings e JOIN docs ON document_id = vec_id WHERE {tables.acl_sql('manager')}),
scored AS (SELECT c.label AS request_id, e.vec_id, round(list_cosine_similarity(c.vector, e.embedding::DOUBLE[]), 12) AS score
  FROM centroid c CROSS JOIN readable e)
SELECT CAST(request_id AS BIGINT) AS request_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""
)
def vector_search_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the vectors a manager may read: access control below the top-k."""
    found = _centroid_search(spark, sf_dir, 20, tables.PRINCIPALS["manager"])
    return found.select("request_id", F.col("item_id").alias("vec_id"), F.round("score", SCORE_DIGITS).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    sql=_CENTROID_SQL
    + """scored AS (SELECT c.label AS request_id, e.label AS found, e.vec_id, round(list_cosine_similarity(c.vector, e.embedding::DOUBLE[]), 12) AS score
  FROM centroid c CROSS JOIN embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT CAST(request_id AS BIGINT) AS request_id,
  round(count(*) FILTER (WHERE rank <= 1 AND found = request_id) / 1::DOUBLE, 6) AS p_at_1,
  round(count(*) FILTER (WHERE rank <= 3 AND found = request_id) / 3::DOUBLE, 6) AS p_at_3,
  round(count(*) FILTER (WHERE rank <= 5 AND found = request_id) / 5::DOUBLE, 6) AS p_at_5
FROM ranked WHERE rank <= 20 GROUP BY request_id"""
)
def retrieval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision@K of the label search: a hit is relevant when it carries the label."""
    relevant = tables.read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("request_id"), F.col("vec_id").alias("item_id")
    )
    return evaluation.precision_at_k(_centroid_search(spark, sf_dir, 20), relevant)


@query(
    sql=tables.with_sql(_embed_sql("emb", "documents", "doc_id", "text"))
    + "SELECT doc_id AS document_id, position, weight FROM emb WHERE weight <> 0",
    headline=True,
)
def text_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents, each distinct text embedded once."""
    embedded = vectors.embed_distinct(
        tables.read(spark, sf_dir, "documents").select("doc_id", "text"), "text", vectors.HashingEmbedder(DIMENSION)
    )
    return (
        embedded.select(F.col("doc_id").alias("document_id"), F.posexplode("vector").alias("position", "weight"))
        .filter(F.col("weight") != 0)
        .select("document_id", F.col("position").cast("bigint").alias("position"), F.col("weight").cast("double").alias("weight"))
    )


@query(
    sql=tables.with_sql(QUESTIONS_SQL, TERMS_SQL, tables.DOCUMENTS_SQL, _keyword_sql("found", "docs", "document_id", "text", 10))
    + "SELECT request_id, document_id, score, rank FROM found",
    headline=True,
)
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents matching each question's keywords best."""
    found = keyword_search.search(
        tables.documents(spark, sf_dir), questions(spark, sf_dir), 10, id_column="document_id"
    )
    return found.select("request_id", F.col("item_id").alias("document_id"), F.round("score", SCORE_DIGITS).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    sql=tables.with_sql(QUESTIONS_SQL, TERMS_SQL, tables.DOCUMENTS_SQL, _keyword_sql("found", "docs", "document_id", "text", 10))
    + "SELECT request_id, document_id, score, rank FROM found"
)
def keyword_hits_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a written index: blocks that cannot reach a question's ten best are not read."""
    folder = new_folder(spark)
    docs = tables.documents(spark, sf_dir)
    inverted_index.write(docs, folder, "document_id")
    found = keyword_search.search(docs, questions(spark, sf_dir), 10, id_column="document_id", index=inverted_index.read(spark, folder))
    return found.select("request_id", F.col("item_id").alias("document_id"), F.round("score", SCORE_DIGITS).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_READABLE_SQL = f"readable AS (SELECT * FROM docs WHERE {tables.acl_sql('manager')})"

_DOCGRAPH_SQL = """
gnodes AS (
  SELECT 'doc:' || document_id AS node_id, 'Document' AS class, title AS text, ' - lang: ' || lang AS shown, 0.9::DOUBLE AS confidence FROM readable
  UNION ALL SELECT DISTINCT 'source:' || source, 'Source', source, '', 0.5::DOUBLE FROM readable
  UNION ALL SELECT DISTINCT 'lang:' || lang, 'Language', lang, '', 0.5::DOUBLE FROM readable),
gedges AS (
  SELECT 'doc:' || document_id AS src, 'fromSource' AS predicate, 'source:' || source AS dst, 0.7::DOUBLE AS confidence FROM readable
  UNION ALL SELECT 'doc:' || document_id, 'inLanguage', 'lang:' || lang, 0.6::DOUBLE FROM readable),
gsteps AS (SELECT src AS node_id, dst AS neighbor FROM gedges UNION ALL SELECT dst, src FROM gedges),
gwords AS (SELECT DISTINCT request_id, w FROM raw_words),
gseeds AS (SELECT * FROM (
  SELECT request_id, node_id, row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, node_id) AS seed_rank FROM (
    SELECT request_id, node_id, count(*) AS hits FROM gwords JOIN gnodes ON contains(text, w) GROUP BY ALL)) WHERE seed_rank <= 10),
greached AS (
  SELECT request_id, neighbor AS node_id, row_number() OVER (PARTITION BY request_id ORDER BY neighbor) AS seed_rank FROM (
    SELECT DISTINCT s.request_id, t.neighbor FROM gseeds s JOIN gsteps t USING (node_id)
    WHERE NOT EXISTS (SELECT 1 FROM gseeds x WHERE x.request_id = s.request_id AND x.node_id = t.neighbor))),
gfound AS (SELECT *, 0 AS hops FROM gseeds UNION ALL SELECT *, 1 FROM greached WHERE seed_rank <= 5),
gtouching AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY src, predicate, dst) AS n FROM (
    SELECT DISTINCT f.request_id, e.* FROM gfound f JOIN gedges e ON e.src = f.node_id OR e.dst = f.node_id)),
glisted AS (
  SELECT f.request_id, 'node' AS kind, f.node_id AS hit_id, '[' || g.class || '] - ' || g.text || g.shown AS content, g.confidence AS score, hops, seed_rank
  FROM gfound f JOIN gnodes g USING (node_id)
  UNION ALL
  SELECT t.request_id, 'relation', t.src || '|' || t.predicate || '|' || t.dst,
    coalesce(s.text, t.src) || ' [' || t.predicate || '] ' || coalesce(o.text, t.dst), t.confidence, NULL, t.n
  FROM gtouching t LEFT JOIN gnodes s ON s.node_id = t.src LEFT JOIN gnodes o ON o.node_id = t.dst WHERE t.n <= 5),
graph_found AS (SELECT * FROM (
  SELECT request_id, kind, hit_id, content, score,
    row_number() OVER (PARTITION BY request_id ORDER BY kind, hops NULLS FIRST, seed_rank, hit_id) AS position FROM glisted) WHERE position <= 20)"""


@query(
    sql=tables.with_sql(QUESTIONS_SQL, TERMS_SQL, tables.DOCUMENTS_SQL, _READABLE_SQL, _DOCGRAPH_SQL)
    + "SELECT request_id, kind, hit_id, content, score, position FROM graph_found"
)
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph context per question: matching documents, their neighbours and relations."""
    nodes, edges = document_graph(spark, sf_dir, tables.PRINCIPALS["manager"])
    found = graph.search(nodes, edges, questions(spark, sf_dir), 20, depth=1)
    return found.withColumn("position", F.col("position").cast("bigint"))


_HYBRID_SQL = tables.with_sql(
    QUESTIONS_SQL,
    TERMS_SQL,
    tables.DOCUMENTS_SQL,
    _READABLE_SQL,
    """
lines AS (SELECT document_id || ':' || n AS chunk_id, content FROM (
  SELECT document_id, line AS content, row_number() OVER (PARTITION BY document_id ORDER BY line_no) - 1 AS n FROM (
    SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM readable)
  WHERE line <> ''))""",
    _embed_sql("qv", "questions", "request_id", "question"),
    _embed_sql("lv", "lines", "chunk_id", "content"),
    _cosine_sql("by_vector", "qv", "lv", "lines", "chunk_id", 20),
    _keyword_sql("by_keyword", "lines", "chunk_id", "content", 10),
    _DOCGRAPH_SQL,
    """
hits AS (
  SELECT request_id, 'vector' AS result_type, 0 AS priority, 1.0::DOUBLE AS weight, chunk_id AS hit_id, content, score FROM by_vector JOIN lines USING (chunk_id)
  UNION ALL SELECT request_id, 'graph', 1, 1.5::DOUBLE, hit_id, content, score FROM graph_found WHERE content <> ''
  UNION ALL SELECT request_id, 'keyword', 2, 0.8::DOUBLE, chunk_id, content, score FROM by_keyword JOIN lines USING (chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, result_type ORDER BY score DESC, hit_id) AS rn FROM hits),
fused AS (
  SELECT request_id, content AS content_key, round(sum(weight / (60.0::DOUBLE + rn)), 9) AS score,
    arg_min(result_type, priority * 1000 + rn) AS result_type, arg_min(hit_id, priority * 1000 + rn) AS hit_id,
    arg_min(content, priority * 1000 + rn) AS content
  FROM ranked GROUP BY ALL),
final AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, content_key) AS rank FROM fused)""",
)


@query(
    sql=_HYBRID_SQL + "SELECT request_id, rank, result_type, hit_id, content, score FROM final WHERE rank <= 5",
    headline=True,
)
def hybrid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the five best results per question from vector, graph and keyword search under access control."""
    return _results(spark, sf_dir).select(
        "request_id", F.col("rank").cast("bigint").alias("rank"), "result_type", "hit_id", "content", "score"
    )


# Which documents hold which windows of a question's words, and how the flagship's five best meet them.
_QUALITY_SQL = """,
qwords AS (SELECT request_id, list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '') AS w FROM questions),
qsized AS (SELECT request_id, w, least(len(w), 8) AS size FROM qwords WHERE len(w) > 0),
qpieces AS (SELECT DISTINCT request_id, size, array_to_string(w[i:i + size - 1], ' ') AS piece FROM (
  SELECT request_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM qsized)),
qcounts AS (SELECT request_id, count(*) AS n FROM qpieces GROUP BY 1),
dwords AS (SELECT document_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM docs),
dpieces AS (SELECT DISTINCT document_id, size, array_to_string(w[i:i + size - 1], ' ') AS piece FROM (
  SELECT document_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dwords, (SELECT DISTINCT size FROM qsized) WHERE len(w) >= size)),
judged AS (SELECT request_id, document_id, count(*)::DOUBLE / any_value(n) AS gain FROM dpieces JOIN qpieces USING (size, piece) JOIN qcounts USING (request_id) GROUP BY ALL),
ideal AS (SELECT request_id, count(*) AS relevant, sum(gain / log2(place + 1)) FILTER (place <= 5) AS best FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY gain DESC, document_id) AS place FROM judged) GROUP BY 1),
listed AS (SELECT request_id, document_id, min(rank) AS rank FROM (
  SELECT request_id, rank, CAST(CASE WHEN starts_with(hit_id, 'doc:') THEN substr(hit_id, 5) WHEN result_type <> 'graph' THEN string_split(hit_id, ':')[1] END AS BIGINT) AS document_id
  FROM final WHERE rank <= 5 AND hit_id NOT LIKE '%|%') WHERE document_id IS NOT NULL GROUP BY ALL),
met AS (SELECT request_id, count(*) AS found, min(rank) AS first_rank, sum(gain / log2(rank + 1)) AS gained FROM listed JOIN judged USING (request_id, document_id) GROUP BY 1)
SELECT request_id, relevant, coalesce(found, 0) AS found, round(coalesce(found::DOUBLE / relevant, 0.0::DOUBLE), 6) AS recall,
  round(coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE), 6) AS reciprocal_rank, round(coalesce(gained / best, 0.0::DOUBLE), 6) AS ndcg
FROM ideal LEFT JOIN met USING (request_id)"""


@query(sql=_HYBRID_SQL.rstrip() + _QUALITY_SQL)
def hybrid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and nDCG of the flagship against the documents that hold passages of each question."""
    asked = questions(spark, sf_dir).select("request_id", F.col("question").alias("text"))
    judged = evaluation.held_passages(tables.documents(spark, sf_dir).select("document_id", "text"), asked)
    hit = F.col("hit_id")
    document = F.when(hit.startswith("doc:"), F.substring_index(hit, ":", -1)).when(F.col("result_type") != "graph", F.substring_index(hit, ":", 1))
    listed = _results(spark, sf_dir).where(~hit.contains("|")).select("request_id", document.cast("bigint").alias("document_id"), "rank").where("document_id IS NOT NULL")
    quality = evaluation.ranking_quality(listed, judged)
    return quality.select("request_id", "relevant", "found", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query(
    sql=_HYBRID_SQL
    + "SELECT request_id, round(least(avg(score) * 10, 1.0::DOUBLE), 6) AS confidence FROM final WHERE rank <= 5 GROUP BY request_id"
)
def hybrid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence per question from the fused scores."""
    return fusion.confidence(_results(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    sql=_HYBRID_SQL.rstrip()
    + f""",
running AS (SELECT *, sum(strlen(content)) OVER (PARTITION BY request_id ORDER BY rank) AS used FROM final WHERE rank <= 5),
quoted AS (
  SELECT request_id, string_agg(substr(content, 1, 200) || ' [{answers.SOURCE_MARK}: ' || rank || ']', chr(10) ORDER BY rank) AS answer,
    string_agg(hit_id, ',' ORDER BY rank) AS sources
  FROM running WHERE used <= 8000 GROUP BY request_id)
SELECT q.request_id, coalesce(answer, '{answers.NOT_FOUND_ANSWER}') AS answer, coalesce(sources, '') AS sources,
  coalesce(c.confidence, 0.0::DOUBLE) AS confidence
FROM questions q LEFT JOIN quoted USING (request_id) LEFT JOIN (
  SELECT request_id, round(least(avg(score) * 10, 1.0::DOUBLE), 6) AS confidence FROM final WHERE rank <= 5 GROUP BY request_id) c USING (request_id)"""
)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question answering end to end: search, fuse, pack, answer, cite, with the confidence of each answer."""
    asked = questions(spark, sf_dir)
    results = cut_lineage(_results(spark, sf_dir).withColumnRenamed("hit_id", "source"))  # five rows a question, used three times
    packed = fusion.pack_context(results, ["request_id"], [F.col("rank")])
    answered = answers.extractive_answers(asked, packed)
    cited = answers.citations(answered, packed).groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", "source"))), lambda x: x["source"]), ",").alias("sources")
    )
    sure = fusion.confidence(results).withColumn("confidence", F.round("confidence", 6))
    return answered.join(cited, "request_id", "left").join(sure, "request_id", "left").select(
        "request_id", "answer", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


# --- prompts, answers, citations ------------------------------------------------


def keyword_results(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Whole documents found by keyword, as results to build answers from."""
    docs = tables.documents(spark, sf_dir)
    found = keyword_search.search(docs, questions(spark, sf_dir), k, id_column="document_id", carry="text")
    return found.select(
        "request_id", F.col("rank").cast("bigint").alias("rank"), F.col("item_id").cast("string").alias("source"),
        F.col("text").alias("content"), F.round("score", SCORE_DIGITS).alias("score"),
    )


_KEYWORD_RESULTS_SQL = tables.with_sql(
    QUESTIONS_SQL,
    TERMS_SQL,
    tables.DOCUMENTS_SQL,
    _keyword_sql("found", "docs", "document_id", "text", 5),
    """
results AS (SELECT request_id, rank, CAST(document_id AS VARCHAR) AS source, text AS content, score FROM found JOIN docs USING (document_id)),
running AS (SELECT *, sum(strlen(content)) OVER (PARTITION BY request_id ORDER BY rank) AS used FROM results)""",
)


@query(
    sql=_KEYWORD_RESULTS_SQL
    + "SELECT request_id, rank, source, CAST(used AS BIGINT) AS used_bytes FROM running WHERE used <= 8000"
)
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that fit the context budget of each question."""
    packed = fusion.pack_context(keyword_results(spark, sf_dir), ["request_id"], [F.col("rank")])
    return packed.select("request_id", "rank", "source", "used_bytes")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    sql=_KEYWORD_RESULTS_SQL
    + f"""SELECT q.request_id, {_sql_text("<s>" + chr(10) + answers.PROMPT_SYSTEM + "</s>" + chr(10) * 2 + "<context>" + chr(10))} || coalesce(c.context, '') ||
  {_sql_text("</context>" + chr(10) * 2 + "<question>" + chr(10))} || q.question ||
  {_sql_text(chr(10) + "</question>" + chr(10) * 2 + "<instructions>" + chr(10) + answers.PROMPT_INSTRUCTIONS + "</instructions>" + chr(10))} AS prompt
FROM questions q LEFT JOIN (
  SELECT request_id, string_agg('[' || rank || '] {answers.SOURCE_MARK}: ' || source || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) AS context
  FROM running WHERE used <= 8000 GROUP BY request_id) c USING (request_id)"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of every question with its packed context."""
    return answers.assemble_prompts(questions(spark, sf_dir), keyword_results(spark, sf_dir))


@query(
    sql=_KEYWORD_RESULTS_SQL
    + f"""SELECT q.request_id, CASE WHEN c.context IS NULL
  THEN {_sql_text(answers.STREAM_SYSTEM + answers.STREAM_WITHOUT_CONTEXT)} || q.question || {_sql_text(answers.STREAM_ANSWER)}
  ELSE {_sql_text(answers.STREAM_SYSTEM + answers.STREAM_WITH_CONTEXT)} || c.context || {_sql_text(answers.STREAM_QUESTION)} || q.question || {_sql_text(answers.STREAM_ANSWER)} END AS prompt
FROM questions q LEFT JOIN (
  SELECT request_id, string_agg('[문서 ' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS context
  FROM results GROUP BY request_id) c USING (request_id)"""
)
def stream_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of the streaming variant for every question."""
    return answers.stream_prompts(questions(spark, sf_dir), keyword_results(spark, sf_dir))


_ANSWERS_SQL = f"""
answered AS (
  SELECT q.request_id, coalesce(c.answer, '{answers.NOT_FOUND_ANSWER}') AS answer FROM questions q LEFT JOIN (
    SELECT request_id, string_agg(substr(content, 1, 200) || ' [{answers.SOURCE_MARK}: ' || rank || ']', chr(10) ORDER BY rank) AS answer
    FROM results GROUP BY request_id) c USING (request_id))"""


@query(
    sql=_KEYWORD_RESULTS_SQL.rstrip()
    + ","
    + _ANSWERS_SQL
    + """
SELECT n.request_id, n.n AS citation, substr(r.content, 1, 200) AS quote, r.source, 'Document ' || r.source AS document_title
FROM (SELECT DISTINCT request_id, CAST(unnest(regexp_extract_all(answer, '\\[출처:\\s*(\\d+)\\]', 1)) AS BIGINT) AS n FROM answered) n
JOIN results r ON r.request_id = n.request_id AND r.rank = n.n"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cited by the extractive answers."""
    results = keyword_results(spark, sf_dir)
    return answers.citations(answers.extractive_answers(questions(spark, sf_dir), results), results)


@query(
    sql=_KEYWORD_RESULTS_SQL.rstrip()
    + ","
    + _ANSWERS_SQL
    + r""",
sentences AS (SELECT unnest(regexp_split_to_array(answer, '[.!?]\s+|\n')) AS s FROM answered)
SELECT count(*) AS sentences, count(*) FILTER (WHERE NOT regexp_matches(s, '\[출처:\s*(\d+)\]')) AS uncited_sentences,
  count(*) FILTER (WHERE NOT regexp_matches(s, '\[출처:\s*(\d+)\]')) / count(*)::DOUBLE AS hallucination_rate
FROM sentences WHERE trim(s) <> ''"""
)
def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of sentences without a source among the answers."""
    results = keyword_results(spark, sf_dir)
    return evaluation.hallucination_rate(answers.extractive_answers(questions(spark, sf_dir), results))


_USER_TURNS_SQL = "turns AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user')"


def _intent_sql() -> str:
    branches = []
    for name, triggers in answers.INTENT_TRIGGERS.items():
        test = " OR ".join(f"contains(lower(question), '{t}')" for t in triggers)
        branches.append(f"WHEN {test} THEN '{name}'")
    return "CASE " + " ".join(branches) + " ELSE 'general' END"


@query(
    sql=f"""WITH {_USER_TURNS_SQL}, i AS (SELECT *, {_intent_sql()} AS intent FROM turns)
SELECT conv_id, turn, intent, CASE intent WHEN 'procedural' THEN 'list' WHEN 'comparative' THEN 'comparison' WHEN 'factual' THEN 'single_fact'
  WHEN 'definitional' THEN 'explanation' ELSE 'unknown' END AS answer_type FROM i"""
)
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and answer type of every user turn."""
    turns = tables.read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return answers.analyze(turns, "text").select("conv_id", "turn", "intent", "answer_type")


@query(
    sql=f"""WITH {_USER_TURNS_SQL}
SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: strlen(w) > 1 AND lower(w) NOT IN {_STOP_SQL}), ' ') AS keywords
FROM turns"""
)
def question_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of every user turn."""
    turns = tables.read(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return answers.analyze(turns, "text").select("conv_id", "turn", F.array_join("keywords", " ").alias("keywords"))
