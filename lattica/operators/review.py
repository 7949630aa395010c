"""Human review of extractions: queue, decisions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import ratio
from lattica.operators.topk import page

# Thresholds above which an extraction needs no reviewer.
AUTO_APPROVE_THRESHOLD = 0.95
AUTO_APPROVE_STATISTIC = 0.9
# Queue states.
APPROVED_STATES = ("approved", "auto_approved")

ENTITY_ITEMS = "array<struct<text:string,entity_type:string,start:bigint,end:bigint>>"
RELATION_ITEMS = "array<struct<subject:string,predicate:string,object:string>>"


def initial_status(confidence: Column, threshold: float = AUTO_APPROVE_THRESHOLD) -> Column:
    return F.when(confidence >= threshold, "auto_approved").otherwise("pending")


def enqueue(extractions: DataFrame, threshold: float = AUTO_APPROVE_THRESHOLD) -> DataFrame:
    """New queue rows; sure extractions are approved on arrival."""
    return extractions.withColumn("status", initial_status(F.col("confidence"), threshold))


def approved(queue: DataFrame) -> DataFrame:
    return queue.filter(F.col("status").isin(*APPROVED_STATES))


def rejection_note(reason: Column, notes: Column) -> Column:
    return F.concat(F.lit("REJECTED: "), reason, F.lit("\n"), F.coalesce(notes, F.lit("")))


_DECISION = ("action", "reviewer", "reason", "notes", "reviewed_at", "corrected_entity", "corrected_relation")


def _apply(queue: DataFrame, chosen: DataFrame, guard: Column) -> DataFrame:
    joined = queue.join(chosen, "extraction_id", "left").withColumn("_acts", guard & F.col("action").isNotNull())
    acts = F.col("_acts")
    note = F.when(F.col("action") == "rejected", rejection_note(F.col("reason"), F.col("notes"))).otherwise(F.col("notes"))
    changed = {
        "status": F.when(acts, F.col("action")).otherwise(F.col("status")),
        "reviewer_id": F.when(acts, F.col("reviewer")),
        "review_notes": F.when(acts, note),
        "reviewed_at": F.when(acts, F.col("reviewed_at")),
    }
    for items, fix in (("extracted_entities", "corrected_entity"), ("extracted_relations", "corrected_relation")):
        if items in queue.columns and fix in joined.columns:
            corrected = acts & (F.col("action") == "approved") & F.col(fix).isNotNull()
            one = F.concat(F.lit("["), F.col(fix), F.lit("]"))
            changed[items] = F.when(corrected, one).otherwise(F.col(items))
    kept = [c for c in queue.columns if c not in changed]
    return joined.select(*kept, *[column.alias(name) for name, column in changed.items()])


def _choose(decisions: DataFrame, pick) -> DataFrame:
    columns = [c for c in _DECISION if c in decisions.columns]
    order = F.struct("reviewed_at", "decision_id")
    chosen = decisions.groupBy("extraction_id").agg(pick(F.struct(*columns), order).alias("_d"))
    return chosen.select("extraction_id", "_d.*")


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply a log of decisions; only a pending row can be decided, so the first one stands.

    Decisions are append-only rows (extraction_id, decision_id, action,
    reviewer, reason, notes, reviewed_at [, corrected_entity,
    corrected_relation]).  A correction replaces the item list by that one item.
    """
    return _apply(queue, _choose(decisions, F.min_by), F.col("status") == "pending")


def decide_latest(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply decisions from any state; the last one stands."""
    return _apply(queue, _choose(decisions, F.max_by), F.lit(True))


def pending(
    queue: DataFrame,
    documents: DataFrame,
    document_id: int | str | None = None,
    max_confidence: float | None = None,
) -> DataFrame:
    """Pending rows with the title of their document."""
    rows = queue.filter(F.col("status") == "pending")
    if document_id is not None:
        rows = rows.filter(F.col("document_id") == document_id)
    if max_confidence is not None:
        rows = rows.filter(F.col("confidence") <= max_confidence)
    return rows.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id")


def pending_page(queue: DataFrame, documents: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """A page of the review list: by priority, then age."""
    order = [F.col("priority"), F.col("created_at"), F.col("extraction_id")]
    return page(pending(queue, documents, **filters), order, number, size)


def items(rows: DataFrame, keep: list[str], extraction_type: str | None = None) -> DataFrame:
    """One row per extracted entity or relation; unreadable items are skipped.

    The JSON lists are parsed and expanded inside the scan stage.
    """
    entity = F.from_json("extracted_entities", ENTITY_ITEMS)
    relation = F.from_json("extracted_relations", RELATION_ITEMS)
    entities = rows.select(*keep, F.explode(entity).alias("e")).select(
        *keep,
        F.lit("entity").alias("extraction_type"),
        F.col("e.text").alias("text"),
        F.col("e.entity_type").alias("entity_type"),
        F.col("e.start").alias("start"),
        F.col("e.end").alias("end"),
        F.lit(None).cast("string").alias("subject"),
        F.lit(None).cast("string").alias("predicate"),
        F.lit(None).cast("string").alias("object"),
    ).filter(F.col("text").isNotNull() & F.col("entity_type").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    relations = rows.select(*keep, F.explode(relation).alias("r")).select(
        *keep,
        F.lit("relation").alias("extraction_type"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("entity_type"),
        F.lit(None).cast("bigint").alias("start"),
        F.lit(None).cast("bigint").alias("end"),
        F.col("r.subject").alias("subject"),
        F.col("r.predicate").alias("predicate"),
        F.col("r.object").alias("object"),
    ).filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull())
    both = entities.unionByName(relations)
    return both if extraction_type is None else both.filter(F.col("extraction_type") == extraction_type)


def queue_stats(queue: DataFrame) -> DataFrame:
    """Counts per kind and state with totals and approval rates, in one pass.

    `queue` has (kind, status) with kind entity or relation.
    """
    counts = []
    for kind in ("entity", "relation"):
        for status in ("pending", "approved", "auto_approved", "rejected"):
            counts.append(F.count_if((F.col("kind") == kind) & (F.col("status") == status)).alias(f"{status}_{kind}"))
    grouped = queue.agg(*counts)
    extra = []
    for kind in ("entity", "relation"):
        good = F.col(f"approved_{kind}") + F.col(f"auto_approved_{kind}")
        bad = F.col(f"rejected_{kind}")
        extra.append((F.col(f"pending_{kind}") + good + bad).alias(f"total_{kind}"))
        extra.append(ratio(good, good + bad).alias(f"{kind}_approval_rate"))
    return grouped.select("*", *extra)


def verify_stats(queue: DataFrame, threshold: float = AUTO_APPROVE_STATISTIC) -> DataFrame:
    """Row and item counts by state, approval percentages and sure approvals, in one pass."""
    entities = F.coalesce(F.json_array_length("extracted_entities"), F.lit(0)).cast("bigint")
    relations = F.coalesce(F.json_array_length("extracted_relations"), F.lit(0)).cast("bigint")
    is_pending = F.col("status").isin("pending", "in_review")
    is_approved = F.col("status") == "approved"
    is_rejected = F.col("status") == "rejected"
    sure = is_approved & (F.col("confidence") >= threshold)
    aggregates = [
        F.count_if(is_pending).alias("total_pending"),
        F.count_if(is_approved).alias("total_approved"),
        F.count_if(is_rejected).alias("total_rejected"),
    ]
    for kind, n in (("entity", entities), ("relation", relations)):
        for name, test in (("pending", is_pending), ("approved", is_approved), ("rejected", is_rejected)):
            aggregates.append(F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("bigint").alias(f"{kind}_{name}"))
        aggregates.append(F.count_if(sure & (n > 0)).alias(f"{kind}_auto_approved"))
    stats = queue.agg(*aggregates)
    rates = [
        (ratio(F.col(f"{k}_approved"), F.col(f"{k}_approved") + F.col(f"{k}_rejected")) * 100.0).alias(f"{k}_approval_rate")
        for k in ("entity", "relation")
    ]
    return stats.select("*", *rates)
