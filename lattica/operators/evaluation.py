"""Quality of extraction and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import ratio
from lattica.operators.answers import CITATION_PATTERN

# Precision an extractor must reach.
NER_PRECISION_TARGET = 0.80
RE_PRECISION_TARGET = 0.70
# Retrieval targets.
PRECISION_AT_K_TARGET = 0.85
HALLUCINATION_RATE_TARGET = 0.05
LATENCY_P95_TARGET_MS = 3000


def entity_counts(
    predicted: DataFrame, gold: DataFrame, keys: list[str], strict: bool = False, match_types: bool = True
) -> DataFrame:
    """tp, fp, fn per group.

    Mentions match one to one when their keys agree (text, or the exact span
    when strict; plus the type), so the matches of a key are the smaller of
    its two counts.
    """
    match = [*keys, *(["start", "end"] if strict else ["text"]), *(["entity_type"] if match_types else [])]
    p = predicted.groupBy(*match).agg(F.count("*").alias("_p"))
    g = gold.groupBy(*match).agg(F.count("*").alias("_g"))
    zero = F.lit(0)
    joined = p.join(g, match, "full_outer").select(
        *keys, F.coalesce("_p", zero).alias("_p"), F.coalesce("_g", zero).alias("_g")
    )
    both = F.least("_p", "_g")
    aggregates = [
        F.sum(both).alias("tp"),
        F.sum(F.col("_p") - both).alias("fp"),
        F.sum(F.col("_g") - both).alias("fn"),
        F.sum("_g").alias("gold_total"),
        F.sum("_p").alias("predicted_total"),
    ]
    return joined.groupBy(*keys).agg(*aggregates) if keys else joined.agg(*aggregates)


def relation_counts(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn over distinct (subject, predicate, object) per group.

    One grouping with a flag per side replaces the intersection and the two
    differences.
    """
    columns = [*keys, "subject", "predicate", "object"]
    sides = predicted.select(*columns, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionAll(
        gold.select(*columns, F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    )
    flags = sides.groupBy(*columns).agg(
        F.max("_p").alias("_p"), F.max("_g").alias("_g"), F.sum("_g").alias("_gold_rows")
    )
    aggregates = [
        F.count_if((F.col("_p") == 1) & (F.col("_g") == 1)).alias("tp"),
        F.count_if((F.col("_p") == 1) & (F.col("_g") == 0)).alias("fp"),
        F.count_if((F.col("_p") == 0) & (F.col("_g") == 1)).alias("fn"),
        F.sum("_gold_rows").alias("gold_total"),
        F.sum("_p").alias("predicted_total"),
    ]
    return flags.groupBy(*keys).agg(*aggregates) if keys else flags.agg(*aggregates)


def scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and accuracy (tp over everything seen)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        F.round(ratio(tp, tp + fp), 6).alias("precision"),
        F.round(ratio(tp, tp + fn), 6).alias("recall"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round(ratio(tp, tp + fp + fn), 6).alias("accuracy"),
    )


def total_counts(counts: DataFrame) -> DataFrame:
    """Micro-average: counts summed over the groups before any ratio."""
    return counts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "gold_total", "predicted_total")],
        F.count("*").alias("num_documents"),
    )


def targets_met(entity_scores: DataFrame, relation_scores: DataFrame) -> DataFrame:
    """Both one-row score tables side by side, and whether their precision reaches the targets."""
    sides = [
        scores.select("num_documents", *[F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1")])
        for name, scores in (("entity", entity_scores), ("relation", relation_scores))
    ]
    return sides[0].join(sides[1], "num_documents").select(
        "*", (F.col("entity_precision") >= NER_PRECISION_TARGET).alias("ner_ok"), (F.col("relation_precision") >= RE_PRECISION_TARGET).alias("re_ok")
    )


def precision_at_k(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of relevant items among the first k results of each request.

    `results` has (request_id, item_id, rank), `relevant` (request_id, item_id).
    """
    marks = relevant.select("request_id", "item_id").distinct().withColumn("_hit", F.lit(1))
    judged = results.join(marks, ["request_id", "item_id"], "left")
    return judged.groupBy("request_id").agg(
        *[
            F.round(F.sum(F.when((F.col("rank") <= k) & F.col("_hit").isNotNull(), 1).otherwise(0)) / k, 6).alias(f"p_at_{k}")
            for k in ks
        ]
    )


def hallucination_rate(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Share of sentences without a source mark, over all answers.

    A sentence ends at a full stop, question or exclamation mark followed by
    white space, or at a line break; the mark belongs to the sentence before it.
    """
    sentences = F.filter(F.split(answer, r"[.!?]\s+|\n"), lambda s: F.trim(s) != "")
    uncited = F.filter(sentences, lambda s: ~s.rlike(CITATION_PATTERN))
    return answers.agg(
        F.coalesce(F.sum(F.size(sentences)), F.lit(0)).cast("bigint").alias("sentences"),
        F.coalesce(F.sum(F.size(uncited)), F.lit(0)).cast("bigint").alias("uncited_sentences"),
    ).withColumn("hallucination_rate", ratio(F.col("uncited_sentences"), F.col("sentences")))


def held_passages(documents: DataFrame, items: DataFrame, window: int = 8, document_id: str = "document_id", item_id: str = "request_id", text: str = "text") -> DataFrame:
    """(item, document, `gain`): the share of an item's windows of words that a document holds word for word.

    Windows are `window` words in a row, lower-case; a shorter item is one window.
    Documents meet items by an equi-join of windows of one length.
    """
    spaced = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+"), lambda w: w != "")

    def pieces(words: Column, size: Column) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " ")))

    asked = items.select(item_id, spaced.alias("_w")).where(F.size("_w") > 0).withColumn("_size", F.least(F.size("_w"), F.lit(window)))
    asked = asked.select(item_id, "_size", pieces(F.col("_w"), F.col("_size")).alias("_p"))
    wanted = asked.select(item_id, "_size", F.size("_p").alias("_n"), F.explode("_p").alias("_piece"))
    sizes = F.broadcast(wanted.select("_size").distinct())  # `window` rows at most
    words = documents.select(document_id, spaced.alias("_w"), F.explode(F.sequence(F.lit(1), F.lit(window))).alias("_size")).join(sizes, "_size")
    held = words.select(document_id, "_size", F.explode(pieces(F.col("_w"), F.col("_size"))).alias("_piece"))
    found = held.join(wanted, ["_size", "_piece"]).groupBy(item_id, document_id).agg((F.count("*") / F.max("_n")).alias("gain"))
    return found


def ranking_quality(results: DataFrame, judgments: DataFrame, k: int = 5, request: str = "request_id", item: str = "document_id") -> DataFrame:
    """Per request with a judged item: `relevant`, `found`, `recall`, `reciprocal_rank` and `ndcg` of its first `k` results.

    `results` has (request, item, rank), `judgments` (request, item, gain).  An
    item that is listed several times counts at its best rank.
    """
    discount = lambda rank: 1.0 / F.log2(rank + 1.0)
    ideal = Window.partitionBy(request).orderBy(F.desc("gain"), item)
    judged = judgments.withColumn("_place", F.row_number().over(ideal)).groupBy(request).agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("_place") <= k, F.col("gain") * discount(F.col("_place")))).alias("_ideal")
    )
    best = results.where(F.col("rank") <= k).groupBy(request, item).agg(F.min("rank").alias("rank"))
    hits = best.join(judgments, [request, item]).groupBy(request).agg(
        F.count("*").alias("found"), F.min("rank").alias("_first"), F.sum(F.col("gain") * discount(F.col("rank"))).alias("_gain")
    )
    zero = F.lit(0.0)
    return judged.join(hits, request, "left").select(
        request, "relevant", F.coalesce("found", F.lit(0).cast("bigint")).alias("found"), F.coalesce(F.col("found") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(1.0 / F.col("_first"), zero).alias("reciprocal_rank"), F.coalesce(F.col("_gain") / F.col("_ideal"), zero).alias("ndcg"),
    )
