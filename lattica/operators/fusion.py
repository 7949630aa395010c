"""Reciprocal-rank fusion of hit lists and what is derived from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import content_key
from lattica.operators.topk import top_k_per_group


@dataclass(frozen=True)
class RetrievalConfig:
    # Default depths, weights and budgets of hybrid retrieval.
    vector_top_k: int = 20
    graph_depth: int = 2
    keyword_top_k: int = 10
    final_top_k: int = 5
    min_score: float = 0.0
    rrf_k: float = 60.0
    vector_weight: float = 1.0
    graph_weight: float = 1.5
    keyword_weight: float = 0.8
    max_context_length: int = 8000
    # Hits are one result if this many leading characters agree; all of them by default.
    content_key_chars: int | None = None

    def weights(self) -> dict[str, float]:
        return {"vector": self.vector_weight, "graph": self.graph_weight, "keyword": self.keyword_weight}


# Backends in the order that decides which copy of a content represents it.
RESULT_TYPES = ("vector", "graph", "keyword")


def fuse(
    hits: DataFrame, config: RetrievalConfig = RetrievalConfig(), top_k: int | None = None, digits: int = 9, weights: dict[str, float] | None = None
) -> DataFrame:
    """Fused ranking per request.

    `weights` names the kinds of hits and their weights, those of `config` by
    default; the order of kinds decides which copy of a content represents it.

    `hits` has (request_id, result_type, hit_id, content, score) and any
    further columns, which follow the representative of a content.  Scores are
    rounded before ranking so that ties do not depend on the order of summing.
    The input holds at most a few dozen rows per request, so the windows are
    small however large the corpus is.
    """
    extra = [c for c in hits.columns if c not in ("request_id", "result_type", "score")]
    by_type = Window.partitionBy("request_id", "result_type").orderBy(F.col("score").desc(), F.col("hit_id"))
    ranked = hits.filter(~F.isnan("score")).withColumn("_rn", F.row_number().over(by_type))
    weight = F.lit(None).cast("double")
    priority = F.lit(None).cast("int")
    weights = weights or {kind: config.weights()[kind] for kind in RESULT_TYPES}
    for position, kind in reversed(list(enumerate(weights))):
        weight = F.when(F.col("result_type") == kind, F.lit(weights[kind])).otherwise(weight)
        priority = F.when(F.col("result_type") == kind, F.lit(position)).otherwise(priority)
    fused = (
        ranked.withColumn("_term", weight / (F.lit(config.rrf_k) + F.col("_rn")))
        .groupBy("request_id", content_key(F.col("content"), config.content_key_chars).alias("content_key"))
        .agg(
            F.round(F.sum("_term"), digits).alias("score"),
            F.min_by(F.struct("result_type", *extra), F.struct(priority, "_rn")).alias("_hit"),
        )
        .select("request_id", "content_key", "score", "_hit.*")
    )
    order = [F.col("score").desc(), F.col("content_key")]
    return top_k_per_group(fused, ["request_id"], order, top_k or config.final_top_k)


def confidence(results: DataFrame) -> DataFrame:
    """Mean score of the final results times ten, at most 1."""
    return results.groupBy("request_id").agg(
        F.coalesce(F.least(F.avg("score") * 10.0, F.lit(1.0)), F.lit(0.0)).alias("confidence")
    )


def pack_context(results: DataFrame, keys: list[str], order: list, budget: int = RetrievalConfig.max_context_length, content: str = "content") -> DataFrame:
    """Results in order until the next one would exceed the byte budget.

    Lengths are never negative, so the running sum only grows and the filter
    equals stopping at the first result that does not fit.
    """
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.octet_length(content).cast("bigint")).over(window)
    return results.withColumn("used_bytes", used).filter(F.col("used_bytes") <= budget)
