"""The operators applied to the given tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import classlm, cross_polytope, decontaminate, jaccard, language, licences, multi_index, packing, prefix_trie, quality, secrets, toxicity, whitening
from lattica.llm.common import LOWER, UPPER, fold, table
from lattica.plans.registry import Query

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query of this subpackage under its function name."""

    def register(build):
        QUERIES[build.__name__] = Query(build.__name__, build, sql, False)
        return build

    return register


DECONTAMINATION_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS piece
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS piece
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows USING (piece) WHERE p.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query(DECONTAMINATION_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0)


@query()
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query()
def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.scored(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


# DuckDB has no positions of matches: the text up to each match is rebuilt from
# the pieces between marks that stand for the matches.
def _secret_sql() -> str:
    kinds = {
        "assign": ("(?i)" + secrets.BASE_RULES[0].pattern.replace("'", "''"), 2, 6),
        "access": (secrets.BASE_RULES[1].pattern, 0, 20),
        "hex": ("[0-9a-f]+", 0, 24),
        **{r.kind: (r.pattern, 0, 0) for r in secrets.MORE_RULES},
    }
    parts = [
        f"""
  SELECT doc_id, {k} AS k, '{kind}' AS kind, size, kept >= {least} AS good,
         gap + coalesce(sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (
    SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(g, lambda x: len(x))) AS kept,
           unnest(list_transform(m, lambda x: len(x))) AS size, unnest(list_transform(string_split_regex(t, '{pattern}')[1:len(m)], lambda x: len(x))) AS gap
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d))"""
        for k, (kind, (pattern, group, least)) in enumerate(kinds.items())
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT doc_id, k, kind, s, concat_ws(':', kind, CAST(s AS BIGINT), CAST(s + size AS BIGINT)) AS x FROM found WHERE good),
per AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(x, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


@query(_secret_sql())
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


JACCARD_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""


@query(JACCARD_SQL)
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


def tokenizer() -> dict[str, str]:
    """Where the vocabulary of byte_bpe_50k lies, and how it splits texts."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def added_tokens() -> dict[str, int]:
    """Ids of the strings that byte_bpe_50k reads as one token wherever a text holds them."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as handle:
        return {t["content"]: t["id"] for t in json.load(handle)["added_tokens"]}


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer(), special=added_tokens())


@query()
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.documents(table(spark, sf_dir, "documents"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
