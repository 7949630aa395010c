"""Chunking, sections, mentions, relations, their evaluation and loading into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as text_functions
from lattica.operators import chunking, evaluation, graph, mentions, relations, review, sections
from lattica.operators.mentions import RuleSet
from lattica.operators.relations import RelationRule
from lattica.plans import tables
from lattica.plans.registry import query

# Rules that find something in the given texts, beside the default ones.
TEXT_RULES = RuleSet(
    patterns=(
        (r"[0-9]{4,}", "Number", 0.85, ""),
        (r"[A-Za-z0-9.]+@[a-z0-9.]+", "Email", 0.95, "@"),
        (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "Address", 0.9, "."),
        (r"[A-Z][a-z]+\.", "Closing", 0.8, "."),
    ),
    dictionary=(("with", "Preposition", ("para", "von", "pour")), ("that", "Pronoun", ("nicht", "que", "le")), ("TL", "Manager", ())),
)
STRICT_RULES = RuleSet(
    patterns=(
        (r"[0-9]{5,}", "Number", 0.85, ""),
        (r"[A-Za-z0-9.]+@[a-z0-9.]+", "Email", 0.95, "@"),
        (r"[A-Z][a-z]+\.", "Closing", 0.8, "."),
        (r"(with|para|von|pour)", "Preposition", 0.9, ""),
        (r"(that|nicht|que)", "Pronoun", 0.9, ""),
    ),
    dictionary=(),
)
TEXT_RELATIONS = (
    RelationRule("Pronoun", "Preposition", "precedes", ("the", "de", "der", "que"), 60, 0.85),
    RelationRule("Preposition", "Closing", "closes", ("in", "en"), 100, 0.8),
    RelationRule("Email", "Number", "near", ("#", "&", "a"), 150, 0.9),
)
CLOSE_RELATIONS = (
    RelationRule("Pronoun", "Preposition", "precedes", ("the", "de", "der", "que"), 30, 0.85),
    RelationRule("Preposition", "Closing", "closes", ("in", "en"), 100, 0.8),
)


CONTEXT = relations.context_bytes(TEXT_RELATIONS)


# --- chunks ---------------------------------------------------------------------

_HEX = "IN ('8', '9', 'A', 'B')"


def _boundary(p: str) -> str:
    """Start of the character at a byte position of the hex string h."""
    return (
        f"({p} - CASE WHEN {p} >= n OR substr(h, 2*({p})+1, 1) NOT {_HEX} THEN 0 WHEN substr(h, 2*({p})-1, 1) NOT {_HEX} THEN 1 "
        f"WHEN substr(h, 2*({p})-3, 1) NOT {_HEX} THEN 2 ELSE 3 END)"
    )


def _break_end() -> str:
    """End of a chunk inside the window win, which begins at byte lo."""
    tries = []
    for mark in ("\n\n", *chunking.SENTENCE_BREAKS, "\n"):
        code = mark.encode().hex().upper()
        tries.append(f"nullif(strlen(regexp_extract(win, '^(?:..)*{code}')), 0)")
    return f"CASE WHEN t >= n THEN n ELSE coalesce(lo + coalesce({', '.join(tries)}) // 2, t) END"


def _chunk_step(source: str) -> str:
    """(doc_id, step, s, e, n) from (doc_id, step, s, h, n), one computed column per level."""
    return f"""(SELECT doc_id, step, s, n, {_break_end()} AS e FROM (SELECT *, substr(h, 2*lo+1, 2*(hi-lo)) AS win FROM (
  SELECT *, {_boundary('l0')} AS lo, {_boundary('h0')} AS hi FROM (SELECT *, greatest(t - 100, 0) AS l0, least(t + 100, n) AS h0 FROM (
    SELECT *, {_boundary('t0')} AS t FROM (SELECT *, least(s + 1000, n) AS t0 FROM {source})))))) """


_EXACT_CHUNKS_SQL = f"""
raw AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
walk AS (
  SELECT doc_id, step, s, CASE WHEN n <= 1000 THEN n ELSE e END AS e FROM {_chunk_step("(SELECT doc_id, 0 AS step, 0::BIGINT AS s, h, n FROM raw)")}
  UNION ALL
  SELECT doc_id, step, s, e FROM {_chunk_step(f"(SELECT doc_id, step, {_boundary('o')} AS s, h, n FROM (SELECT w.doc_id, w.step + 1 AS step, r.h, r.n, CASE WHEN w.e > 200 THEN w.e - 200 ELSE w.e END AS o FROM walk w JOIN raw r ON r.doc_id = w.doc_id AND w.e < r.n))")}),
exact_chunks AS (
  SELECT w.doc_id AS document_id, CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY step) - 1 AS BIGINT) AS chunk_index,
    w.s AS start_offset, CAST(w.e AS BIGINT) AS end_offset, decode(unhex(substr(h, 2*w.s+1, 2*(w.e-w.s)))) AS content
  FROM walk w JOIN raw r USING (doc_id) WHERE w.e - w.s >= 100 OR r.n <= 1000)"""


@query(
    sql=tables.with_sql(_EXACT_CHUNKS_SQL) + "SELECT document_id, chunk_index, start_offset, end_offset, content FROM exact_chunks",
    headline=True,
)
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks that break at paragraphs, sentences or lines."""
    return chunking.chunk_documents(tables.documents(spark, sf_dir).select("document_id", "text"))


@query(
    sql=tables.with_sql(_EXACT_CHUNKS_SQL)
    + """SELECT document_id, count(*) AS chunks, CAST(sum(end_offset - start_offset) AS BIGINT) AS bytes, max(end_offset) AS covered_to,
  count(*) FILTER (WHERE next_start > end_offset) AS gaps
FROM (SELECT *, lead(start_offset) OVER (PARTITION BY document_id ORDER BY chunk_index) AS next_start FROM exact_chunks) GROUP BY document_id"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, bytes and gaps per document: consecutive chunks must overlap or touch."""
    from pyspark.sql import Window

    chunks = text_chunks(spark, sf_dir)
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    spaced = chunks.withColumn("next_start", F.lead("start_offset").over(order))
    return spaced.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.sum(F.col("end_offset") - F.col("start_offset")).alias("bytes"),
        F.max("end_offset").alias("covered_to"),
        F.count_if(F.col("next_start") > F.col("end_offset")).alias("gaps"),
    )


@query(
    sql="""SELECT document_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 800 AS BIGINT) AS start_offset, CAST(least(i * 800 + 1000, length(text)) AS BIGINT) AS end_offset,
  substr(text, i * 800 + 1, 1000) AS content
FROM (SELECT doc_id AS document_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 800 + 1)) AS i FROM documents)"""
)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1000 characters every 800 characters."""
    return chunking.fixed_chunks(tables.documents(spark, sf_dir)).select(
        "document_id", "chunk_index", "start_offset", "end_offset", "content"
    )


@query(sql=tables.with_sql(tables.CHUNKS_SQL) + "SELECT document_id, chunk_index, content FROM chunk_rows")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per line."""
    return tables.chunks(spark, sf_dir)


# --- sections -------------------------------------------------------------------

_TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_HEADERS_SQL = f"""
text_lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
trimmed AS (SELECT *, {_TRIM} AS t FROM text_lines),
marked AS (
  SELECT *, t <> '' AND strlen(t) <= 100 AND (regexp_matches(t, '^(\\p{{N}}|제|Chapter|Section)')
      OR (regexp_matches(t, '\\p{{Lu}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]')) OR (contains(t, '조') AND strlen(t) < 50)) AS header,
    CASE WHEN regexp_matches(t, '^(Chapter|제|CHAPTER)') THEN 1 WHEN regexp_matches(t, '^(Section|절)') THEN 2
      WHEN length(regexp_replace(regexp_extract(t, '^([\\p{{N}}.]*)', 1), '[^.]', '', 'g')) > 0
        THEN least(length(regexp_replace(regexp_extract(t, '^([\\p{{N}}.]*)', 1), '[^.]', '', 'g')) + 1, 6) ELSE 1 END AS level
  FROM trimmed),
islands AS (SELECT *, CAST(sum(header::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS BIGINT) AS section_index,
  1 + CAST(sum(contains(line, chr(12))::INT) OVER (PARTITION BY document_id ORDER BY line_no) AS BIGINT) AS page FROM marked)"""


@query(
    sql=tables.with_sql(_HEADERS_SQL)
    + r"""SELECT * FROM (SELECT document_id, section_index, max(CASE WHEN header THEN t END) AS title,
  CAST(coalesce(max(CASE WHEN header THEN level END), 1) AS BIGINT) AS level, min(page) AS start_page,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT header), ''), '^\s+|\s+$', '', 'g') AS content
FROM islands GROUP BY document_id, section_index) WHERE title IS NOT NULL OR content <> ''""",
    headline=True,
)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document by heading heuristics."""
    return sections.sections(tables.documents(spark, sf_dir))


@query(
    sql=tables.with_sql(_HEADERS_SQL) + "SELECT document_id, CAST(line_no - 1 AS BIGINT) AS line_no, t AS title, CAST(level AS BIGINT) AS level FROM marked WHERE header"
)
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heading with its level."""
    lines = sections.text_lines(tables.documents(spark, sf_dir))
    return lines.filter(text_functions.is_header(F.col("line"))).select(
        "document_id", "line_no", text_functions.strip(F.col("line")).alias("title"), text_functions.heading_level(F.col("line")).alias("level")
    )


# --- mentions -------------------------------------------------------------------


def _rules_sql(rules: RuleSet) -> str:
    rows = [(p, kind, conf) for p, kind, conf, _ in rules.patterns] + [(f"(?i){t}", kind, conf) for t, kind, conf in rules.terms()]
    return " UNION ALL ".join(
        f"SELECT doc_id AS document_id, {i} AS rule_id, '{kind}' AS entity_type, {conf}::DOUBLE AS confidence, "
        f"string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS pieces FROM documents"
        for i, (pattern, kind, conf) in enumerate(rows)
    )


def _mentions_sql(out: str, rules: RuleSet) -> str:
    """All matches: the texts are cut at the matches and the pieces measured."""
    return f"""
{out}_pieces AS (SELECT document_id, rule_id, entity_type, confidence, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM ({_rules_sql(rules)}) WHERE len(pieces) > 1),
{out}_placed AS (SELECT *, sum(strlen(piece)) OVER (PARTITION BY document_id, rule_id ORDER BY i) AS upto FROM {out}_pieces),
{out} AS (SELECT document_id, CAST(upto - strlen(piece) AS BIGINT) AS start, CAST(upto AS BIGINT) AS "end", piece AS text, entity_type, confidence
  FROM {out}_placed WHERE i % 2 = 0)"""


def _selected_sql(out: str, source: str) -> str:
    """Greedy choice, one mention after the other."""
    return f"""
{out}_ordered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start, confidence DESC, "end" - start DESC, entity_type, text) AS rn FROM {source}),
{out}_walk AS (
  SELECT document_id, rn, "end" AS last, TRUE AS kept FROM {out}_ordered WHERE rn = 1
  UNION ALL
  SELECT o.document_id, o.rn, CASE WHEN o.start >= w.last THEN o."end" ELSE w.last END, o.start >= w.last
  FROM {out}_walk w JOIN {out}_ordered o ON o.document_id = w.document_id AND o.rn = w.rn + 1),
{out} AS (SELECT o.document_id, o.start, o."end", o.text, o.entity_type, o.confidence FROM {out}_ordered o JOIN {out}_walk w ON w.document_id = o.document_id AND w.rn = o.rn WHERE w.kept)"""


_MENTION_COLUMNS = ["document_id", "start", "end", "text", "entity_type", "confidence"]
_MENTION_SQL = 'document_id, start, "end", text, entity_type, confidence'


@query(sql=tables.with_sql(_mentions_sql("found", RuleSet())) + f"SELECT {_MENTION_SQL} FROM found")
def default_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the default rules."""
    return mentions.extract(tables.documents(spark, sf_dir), selected=False).select(*_MENTION_COLUMNS)


@query(sql=tables.with_sql(_mentions_sql("found", TEXT_RULES)) + f"SELECT {_MENTION_SQL} FROM found", headline=True)
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of rules that fit the given texts."""
    return mentions.extract(tables.documents(spark, sf_dir), TEXT_RULES, selected=False).select(*_MENTION_COLUMNS)


@query(
    sql=tables.with_sql(_mentions_sql("found", TEXT_RULES), _selected_sql("chosen", "found")) + f"SELECT {_MENTION_SQL} FROM chosen",
    headline=True,
)
def selected_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping choice among the matches."""
    return mentions.extract(tables.documents(spark, sf_dir), TEXT_RULES).select(*_MENTION_COLUMNS)


@query(
    sql=tables.with_sql(_mentions_sql("a", TEXT_RULES), _mentions_sql("b", STRICT_RULES))
    + """, weighted AS (SELECT * REPLACE (confidence * 0.6::DOUBLE AS confidence) FROM a UNION ALL SELECT * REPLACE (confidence * (1.0::DOUBLE - 0.6::DOUBLE) AS confidence) FROM b),
by_type AS (SELECT document_id, start, "end", entity_type, min(text) AS text, least(round(sum(confidence), 9), 1.0::DOUBLE) AS confidence FROM weighted GROUP BY ALL)
SELECT document_id, start, "end", text, entity_type, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, start, "end" ORDER BY confidence DESC, entity_type DESC) AS rn FROM by_type)
WHERE rn = 1 AND confidence >= 0.5::DOUBLE""".replace(", weighted", ", weighted", 1).replace("weighted AS", "weighted AS", 1)
)
def merged_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractors merged by span with weighted confidences."""
    docs = tables.documents(spark, sf_dir)
    merged = mentions.merge_extractors(
        mentions.extract(docs, TEXT_RULES, selected=False), mentions.extract(docs, STRICT_RULES, selected=False)
    )
    return merged.select(*_MENTION_COLUMNS)


@query(
    sql="""WITH numbers AS (SELECT doc_id AS document_id, text, list_distinct(regexp_extract_all(text, '[0-9]{4,}')) AS found FROM documents)
SELECT document_id, CAST(strlen(substr(text, 1, strpos(text, n) - 1)) AS BIGINT) AS start, CAST(strlen(substr(text, 1, strpos(text, n) - 1)) + strlen(n) AS BIGINT) AS "end",
  n AS text, 'Number' AS entity_type, 0.8::DOUBLE AS confidence
FROM (SELECT document_id, text, unnest(found) AS n FROM numbers)"""
)
def model_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions read from JSON answers, located at their first occurrence; unknown texts vanish."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]{4,}"), F.lit(0)))
    items = F.transform(
        F.concat(numbers, F.array(F.lit("no such text"))),
        lambda n: F.concat(F.lit('{"text":"'), n, F.lit('","entity_type":"Number"}')),
    )
    response = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    answered = tables.documents(spark, sf_dir).select("document_id", "text", response.alias("response"))
    located = answered.select("document_id", mentions.parse_response(F.col("response"), F.col("text")).alias("_m"))
    return located.select("document_id", F.inline("_m"))


# --- relations ------------------------------------------------------------------


def _relations_sql(out: str, source: str, rules: tuple[RelationRule, ...]) -> str:
    """All pairs within a document; contexts are cut from the bytes of the text as hex."""
    values = ", ".join(
        f"({i}, '{r.subject_type}', '{r.object_type}', '{r.predicate}', ["
        + ", ".join(f"'{k.lower().encode().hex().upper()}'" for k in r.keywords)
        + f"], {r.max_distance}, {r.confidence}::DOUBLE)"
        for i, r in enumerate(rules)
    )
    return f"""
{out}_rules AS (SELECT * FROM (VALUES {values}) v(rule_id, subject_type, object_type, predicate, keywords, max_distance, confidence)),
{out}_bytes AS (SELECT doc_id AS document_id, hex(encode(lower(text))) AS h, strlen(text) AS n, strlen(lower(text)) = strlen(text) AS same FROM documents),
{out}_pairs AS (
  SELECT s.document_id, s.text AS subject, s.start AS subject_start, o.text AS object, o.start AS object_start, r.predicate, r.confidence, r.keywords, r.max_distance,
    CASE WHEN s.start < o.start THEN s."end" ELSE o."end" END AS first_end, CASE WHEN s.start < o.start THEN o.start ELSE s.start END AS second_start,
    CASE WHEN s.start < o.start THEN o."end" ELSE s."end" END AS second_end
  FROM {out}_rules r JOIN {source} s ON s.entity_type = r.subject_type JOIN {source} o ON o.entity_type = r.object_type AND o.document_id = s.document_id AND o.start <> s.start
    AND o.start <= s."end" + r.max_distance AND s.start <= o."end" + r.max_distance),
{out}_slices AS (
  SELECT document_id, first_end, upto, substr(h, 2*first_end+1, 2*(least(upto, n) - first_end)) AS slice
  FROM (SELECT DISTINCT document_id, first_end, second_end + max_distance AS upto FROM {out}_pairs) JOIN {out}_bytes USING (document_id)),
{out}_words AS (SELECT DISTINCT unnest(keywords) AS k FROM {out}_rules),
{out}_held AS (
  SELECT document_id, first_end, upto, k FROM {out}_slices, {out}_words
  WHERE contains(slice, k) AND regexp_matches(slice, '^(?:..)*' || k)),
{out} AS (
  SELECT document_id, subject, subject_start, predicate, object, object_start, confidence FROM {out}_pairs p
  WHERE EXISTS (SELECT 1 FROM {out}_held w WHERE w.document_id = p.document_id AND w.first_end = p.first_end
    AND w.upto = p.second_end + p.max_distance AND list_contains(p.keywords, w.k)))"""


_RELATION_COLUMNS = ["document_id", "subject", "subject_start", "predicate", "object", "object_start", "confidence"]


@query(
    sql=tables.with_sql(
        _mentions_sql("found", TEXT_RULES), _selected_sql("chosen", "found"), _relations_sql("related", "chosen", TEXT_RELATIONS)
    )
    + "SELECT * FROM related",
    headline=True,
)
def text_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between mentions near each other."""
    found = mentions.extract(tables.documents(spark, sf_dir), TEXT_RULES, context_bytes=CONTEXT)
    return relations.find_relations(found, TEXT_RELATIONS).select(*_RELATION_COLUMNS)


@query(
    sql=tables.with_sql(_mentions_sql("found", TEXT_RULES), _relations_sql("related", "found", TEXT_RELATIONS)) + "SELECT * FROM related"
)
def overlapping_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations among all matches, overlapping ones included."""
    found = mentions.extract(tables.documents(spark, sf_dir), TEXT_RULES, selected=False, context_bytes=CONTEXT)
    return relations.find_relations(found, TEXT_RELATIONS).select(*_RELATION_COLUMNS)


@query(
    sql=tables.with_sql(
        _mentions_sql("found", TEXT_RULES), _selected_sql("chosen", "found"),
        _relations_sql("a", "chosen", TEXT_RELATIONS), _relations_sql("b", "chosen", CLOSE_RELATIONS),
    )
    + """SELECT document_id, subject, predicate, object, least(round(sum(c), 9), 1.0::DOUBLE) AS confidence FROM (
  SELECT document_id, subject, predicate, object, confidence * 0.6::DOUBLE AS c FROM a UNION ALL
  SELECT document_id, subject, predicate, object, confidence * (1.0::DOUBLE - 0.6::DOUBLE) FROM b) GROUP BY ALL HAVING least(round(sum(c), 9), 1.0::DOUBLE) >= 0.5::DOUBLE"""
)
def merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of two extractors merged by subject, predicate and object."""
    found = mentions.extract(tables.documents(spark, sf_dir), TEXT_RULES, context_bytes=CONTEXT)
    return relations.merge_extractors(
        relations.find_relations(found, TEXT_RELATIONS), relations.find_relations(found, CLOSE_RELATIONS)
    )


# --- evaluation -----------------------------------------------------------------


def _scores_sql(counts: str) -> str:
    def div(a: str, b: str) -> str:
        return f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b})::DOUBLE ELSE 0::DOUBLE END, 6)"

    return (
        f"SELECT c.*, {div('tp', '(tp + fp)')} AS precision, {div('tp', '(tp + fn)')} AS recall, "
        f"{div('2 * tp', '(2 * tp + fp + fn)')} AS f1, {div('tp', '(tp + fp + fn)')} AS accuracy FROM ({counts}) c"
    )


def _entity_counts_sql(key: str) -> str:
    return f"""
p AS (SELECT document_id, {key}, count(*) AS n FROM predicted GROUP BY ALL), g AS (SELECT document_id, {key}, count(*) AS n FROM gold GROUP BY ALL),
matched AS (SELECT document_id, coalesce(p.n, 0) AS p, coalesce(g.n, 0) AS g FROM p FULL JOIN g USING (document_id, {key})),
counts AS (SELECT document_id, CAST(sum(least(p, g)) AS BIGINT) AS tp, CAST(sum(p - least(p, g)) AS BIGINT) AS fp, CAST(sum(g - least(p, g)) AS BIGINT) AS fn,
  CAST(sum(g) AS BIGINT) AS gold_total, CAST(sum(p) AS BIGINT) AS predicted_total FROM matched GROUP BY document_id)"""


_PREDICTED_SQL = (
    _mentions_sql("a", TEXT_RULES),
    _selected_sql("predicted", "a"),
    _mentions_sql("b", STRICT_RULES),
    _selected_sql("gold", "b"),
)


def _predicted_and_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Case-insensitive rules are judged against stricter, case-sensitive ones."""
    docs = tables.documents(spark, sf_dir)
    return mentions.extract(docs, TEXT_RULES, context_bytes=CONTEXT), mentions.extract(docs, STRICT_RULES, context_bytes=CONTEXT)


@query(sql=tables.with_sql(*_PREDICTED_SQL, _entity_counts_sql("text, entity_type")) + _scores_sql("SELECT * FROM counts"), headline=True)
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of mentions per document, matched by text and type."""
    predicted, gold = _predicted_and_gold(spark, sf_dir)
    return evaluation.scores(evaluation.entity_counts(predicted, gold, ["document_id"]))


@query(sql=tables.with_sql(*_PREDICTED_SQL, _entity_counts_sql('start, "end", entity_type')) + _scores_sql("SELECT * FROM counts"))
def entity_scores_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matched by exact span."""
    predicted, gold = _predicted_and_gold(spark, sf_dir)
    return evaluation.scores(evaluation.entity_counts(predicted, gold, ["document_id"], strict=True))


_TOTALS = "CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn, CAST(coalesce(sum(gold_total), 0) AS BIGINT) AS gold_total, CAST(coalesce(sum(predicted_total), 0) AS BIGINT) AS predicted_total, count(*) AS num_documents"


@query(sql=tables.with_sql(*_PREDICTED_SQL, _entity_counts_sql("text, entity_type")) + _scores_sql(f"SELECT {_TOTALS} FROM counts"))
def entity_scores_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-average over all documents."""
    predicted, gold = _predicted_and_gold(spark, sf_dir)
    return evaluation.scores(evaluation.total_counts(evaluation.entity_counts(predicted, gold, ["document_id"])))


_RELATION_COUNTS_SQL = """
p AS (SELECT DISTINCT document_id, subject, predicate, object FROM predicted_relations), g AS (SELECT DISTINCT document_id, subject, predicate, object FROM gold_relations),
relation_counts AS (
  SELECT document_id, CAST(sum(in_p * in_g) AS BIGINT) AS tp, CAST(sum(in_p * (1 - in_g)) AS BIGINT) AS fp, CAST(sum((1 - in_p) * in_g) AS BIGINT) AS fn,
    coalesce((SELECT count(*) FROM gold_relations x WHERE x.document_id = m.document_id), 0) AS gold_total, CAST(sum(in_p) AS BIGINT) AS predicted_total
  FROM (SELECT document_id, CASE WHEN p.subject IS NULL THEN 0 ELSE 1 END AS in_p, CASE WHEN g.subject IS NULL THEN 0 ELSE 1 END AS in_g
    FROM p FULL JOIN g USING (document_id, subject, predicate, object)) m GROUP BY document_id)"""
_RELATION_COUNTS_SQL = _RELATION_COUNTS_SQL.replace(
    "FROM p FULL JOIN g USING (document_id, subject, predicate, object)) m",
    "FROM (SELECT document_id, subject, predicate, object FROM p UNION SELECT document_id, subject, predicate, object FROM g) k\n"
    "    LEFT JOIN p USING (document_id, subject, predicate, object) LEFT JOIN g USING (document_id, subject, predicate, object)) m",
).replace("CASE WHEN p.subject IS NULL", "CASE WHEN NOT EXISTS (SELECT 1 FROM p x WHERE x.document_id = k.document_id AND x.subject = k.subject AND x.predicate = k.predicate AND x.object = k.object)").replace(
    "CASE WHEN g.subject IS NULL", "CASE WHEN NOT EXISTS (SELECT 1 FROM g x WHERE x.document_id = k.document_id AND x.subject = k.subject AND x.predicate = k.predicate AND x.object = k.object)"
)


@query(
    sql=tables.with_sql(
        *_PREDICTED_SQL,
        _relations_sql("predicted_relations", "predicted", TEXT_RELATIONS),
        _relations_sql("gold_relations", "gold", CLOSE_RELATIONS),
        _RELATION_COUNTS_SQL,
    )
    + _scores_sql("SELECT * FROM relation_counts")
)
def relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and accuracy of relations per document."""
    predicted, gold = _predicted_and_gold(spark, sf_dir)
    return evaluation.scores(
        evaluation.relation_counts(
            relations.find_relations(predicted, TEXT_RELATIONS), relations.find_relations(gold, CLOSE_RELATIONS), ["document_id"]
        )
    )


# --- review and load ------------------------------------------------------------


def _approved(spark: SparkSession, sf_dir: str, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Mentions and relations sure enough to need no reviewer."""
    found = mentions.extract(tables.documents(spark, sf_dir), TEXT_RULES, context_bytes=CONTEXT)
    related = relations.find_relations(found, TEXT_RELATIONS)
    return review.approved(review.enqueue(found, threshold)), review.approved(review.enqueue(related, threshold))


_LOAD_SQL = tables.with_sql(
    _mentions_sql("found", TEXT_RULES),
    _selected_sql("chosen", "found"),
    _relations_sql("related", "chosen", TEXT_RELATIONS),
    """
sure AS (SELECT * FROM chosen WHERE confidence >= 0.85::DOUBLE), sure_relations AS (SELECT * FROM related WHERE confidence >= 0.85::DOUBLE),
loaded AS (SELECT *, sha256(document_id || chr(31) || text) AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY start, confidence DESC, entity_type, "end") AS rn FROM sure) WHERE rn = 1),
loaded_nodes AS (SELECT substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) AS node_id,
  entity_type AS class, text, document_id, confidence, start FROM loaded),
loaded_edges AS (SELECT r.document_id, s.node_id AS src, r.predicate, o.node_id AS dst, r.confidence FROM sure_relations r
  JOIN loaded_nodes s ON s.document_id = r.document_id AND s.text = r.subject JOIN loaded_nodes o ON o.document_id = r.document_id AND o.text = r.object)""",
)


@query(sql=_LOAD_SQL + "SELECT node_id, class, text, document_id, confidence, CAST(start AS VARCHAR) AS first_start FROM loaded_nodes")
def loaded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes of the approved mentions."""
    sure, _ = _approved(spark, sf_dir)
    return graph.load_nodes(sure).select(
        "node_id", "class", "text", "document_id", "confidence", F.col("properties")["start"].alias("first_start")
    )


@query(sql=_LOAD_SQL + "SELECT document_id, src, predicate, dst, confidence FROM loaded_edges", headline=True)
def loaded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges of the approved relations whose ends were loaded."""
    sure, related = _approved(spark, sf_dir)
    return graph.load_edges(related, graph.load_nodes(sure))


@query(
    sql=_LOAD_SQL
    + """SELECT document_id, count(*) AS entities_loaded, (SELECT count(*) FROM loaded_edges e WHERE e.document_id = n.document_id) AS relations_loaded
FROM loaded_nodes n GROUP BY document_id"""
)
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges loaded per document."""
    sure, related = _approved(spark, sf_dir)
    nodes = graph.load_nodes(sure)
    return graph.load_summary(nodes, graph.load_edges(related, nodes))
