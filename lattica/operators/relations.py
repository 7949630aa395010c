"""Rule-based relations between mentions of one document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.text import lookup
from lattica.operators.topk import first_per_group

# Bytes of a document whose mentions are compared in one task.
STRETCH = 1 << 16
# Pairs that are in memory at once, and a number beyond all offsets of a text.
PAIRS = 20_000
FAR = 1 << 40

# Relation types a model may answer with.
RELATION_TYPES = (
    "worksIn",
    "hasPosition",
    "hasGrade",
    "managedBy",
    "reportsTo",
    "requestsLeave",
    "approvesLeave",
    "requiresDuration",
    "requiresDocument",
    "hasStep",
    "approvedBy",
    "nextStep",
    "definedIn",
    "references",
    "requires",
    "hasValue",
    "relatedTo",
)


@dataclass(frozen=True)
class RelationRule:
    subject_type: str
    object_type: str
    predicate: str
    keywords: tuple[str, ...]
    max_distance: int
    confidence: float


# Relation rules (subject, object, predicate, keywords, bytes, confidence).
RELATION_RULES = (
    RelationRule("AnnualLeave", "Days", "requiresDuration", ("최대", "기본", "부여", "사용"), 100, 0.85),
    RelationRule("SickLeave", "Days", "requiresDuration", ("최대", "한도", "까지"), 100, 0.85),
    RelationRule("ParentalLeave", "Duration", "requiresDuration", ("최대", "까지", "동안"), 100, 0.85),
    RelationRule("SickLeave", "Document", "requiresDocument", ("필요", "제출", "첨부"), 150, 0.80),
    RelationRule("ApprovalProcess", "ApprovalStep", "hasStep", ("단계", "거쳐", "순서"), 100, 0.80),
    RelationRule("ApprovalStep", "Manager", "approvedBy", ("승인", "결재", "허가"), 80, 0.85),
    RelationRule("LeaveType", "Regulation", "definedIn", ("정의", "규정", "따라", "의거"), 100, 0.80),
    RelationRule("Employee", "Department", "worksIn", ("소속", "근무", "배치"), 80, 0.85),
    RelationRule("Employee", "Position", "hasPosition", ("직위", "직급", "임명"), 80, 0.85),
)


def _by_rule(rules: tuple[RelationRule, ...], value) -> Column:
    """A value of the rule the row's rule_id names."""
    branches = F.when(F.col("rule_id") == 0, value(rules[0]))
    for i, rule in enumerate(rules[1:], 1):
        branches = branches.when(F.col("rule_id") == i, value(rule))
    return branches


def _any_keyword(context: Column, rules: tuple[RelationRule, ...]) -> Column:
    def holds(bound: Column) -> Column:
        def of(rule: RelationRule) -> Column:
            found = F.lit(False)
            for keyword in rule.keywords:
                found = found | F.contains(bound, F.lit(keyword.lower()))
            return found

        return _by_rule(rules, of)

    # The one-element array makes Spark build the context once, not once per keyword.
    return F.exists(F.array(context), holds)


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def _slice(data: Column, start: Column, length: Column) -> Column:
    return F.when(length > 0, F.substring(data, start, length)).otherwise(F.lit(b""))


def context_bytes(rules: tuple[RelationRule, ...] = RELATION_RULES) -> int:
    """Bytes behind a mention the rules may look at."""
    return max(r.max_distance for r in rules)


def _near_pairs(mentions: DataFrame, rules: tuple[RelationRule, ...]) -> DataFrame:
    """Pairs of mentions in rows of (_doc, _w, start, end, text, entity_type, after, _own) that fit a rule.

    Rows come sorted by (_doc, _w, start), so the partners of a mention are the
    next rows up to its reach: a task holds one batch and the few rows before it
    that still reach into it.
    """
    kinds = sorted({t for r in rules for t in (r.subject_type, r.object_type)})
    sides = [(i, kinds.index(r.subject_type), kinds.index(r.object_type), r.max_distance) for i, r in enumerate(rules)]
    most = context_bytes(rules)
    carried = ("start", "end", "text", "entity_type", "after")
    kind_of = {f.name: f.dataType for f in mentions.schema.fields}
    schema = T.StructType(
        [T.StructField("_doc", kind_of["_doc"]), T.StructField("rule_id", T.IntegerType()), T.StructField("reach", T.LongType()),
         T.StructField("subject_first", T.BooleanType()), *[T.StructField(f"{s}_{c}", kind_of[c]) for s in "ab" for c in carried]]
    )

    def pairs_of(rows: pa.Table, old: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
        start = rows.column("start").to_numpy().astype(np.int64)
        end = pc.fill_null(rows.column("end"), -FAR).to_numpy().astype(np.int64)
        kind = pc.index_in(rows.column("entity_type"), pa.array(kinds)).to_numpy()
        own = rows.column("_own").to_numpy()
        key = _groups(rows) * FAR + np.minimum(start, FAR - 1)
        low = np.searchsorted(key, key, "right")
        high = np.searchsorted(key, key - start + np.minimum(end + most, FAR - 1), "right")
        low = np.maximum(low, old)
        count = np.maximum(high - low, 0)
        for at in _stretches(count):
            n = count[at]
            a = np.repeat(np.arange(at.start, at.stop), n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at], n)
            gap = start[b] - end[a]
            for rule, subject, object_, reach in sides:
                near = own[b] & (gap <= reach)
                for first, second, subject_first in ((subject, object_, True), (object_, subject, False)):
                    fit = np.flatnonzero(near & (kind[a] == first) & (kind[b] == second))
                    for i in range(0, len(fit), PAIRS):
                        yield a[fit[i : i + PAIRS]], b[fit[i : i + PAIRS]], rule, reach, subject_first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            old = kept.num_rows if kept is not None else 0
            rows = (pa.concat_tables([kept, new]) if old else new).combine_chunks()
            for a, b, rule, reach, subject_first in pairs_of(rows, old):
                n = len(a)
                first, second = rows.take(pa.array(a)), rows.take(pa.array(b))
                columns = [first.column("_doc"), pa.array(np.full(n, rule, np.int32)), pa.array(np.full(n, reach, np.int64)), pa.array(np.full(n, subject_first))]
                columns += [side.column(c) for side in (first, second) for c in carried]
                yield from pa.Table.from_arrays(columns, names=schema.names).to_batches()
            group = _groups(rows)
            end = pc.fill_null(rows.column("end"), -FAR).to_numpy()
            kept = rows.filter(pa.array((group == group[-1]) & (end + most >= rows.column("start").to_numpy()[-1])))

    return mentions.mapInArrow(run, schema)


def _groups(rows: pa.Table) -> np.ndarray:
    """Number of the (_doc, _w) of each row; rows of a group are neighbours."""
    fresh = np.zeros(rows.num_rows, np.int64)
    for name in ("_doc", "_w"):
        column = rows.column(name).combine_chunks()
        fresh[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def _stretches(count: np.ndarray) -> Iterator[slice]:
    """Slices of about PAIRS pairs, if rows have `count` pairs."""
    number, total = np.cumsum(count) // PAIRS, int(count.sum())
    cuts = np.flatnonzero(np.diff(number)) + 1 if total else np.empty(0, np.int64)
    edges = [0, *cuts.tolist(), len(count)]
    return (slice(x, y) for x, y in zip(edges, edges[1:]) if y > x)


def find_relations(
    mentions: DataFrame, rules: tuple[RelationRule, ...] = RELATION_RULES, document_id: str = "document_id"
) -> DataFrame:
    """Pairs of mentions of fitting types, near each other, with a keyword close by.

    One shuffle by document and stretch of STRETCH bytes, and a sweep over the
    sorted mentions of each: a pair is found where its later mention starts, and
    the few mentions that reach into the next stretch are copied there.  Work
    grows with the mentions near each other, never with all pairs of a document,
    and one huge document spreads over its stretches.  Mentions carry the bytes
    that follow them (column after, at least `context_bytes(rules)` of them), so
    the texts are not joined back; as neighbours stay together, these overlapping
    bytes compress well in the shuffle.
    """
    types = sorted({t for r in rules for t in (r.subject_type, r.object_type)})
    base = mentions.filter(F.col("entity_type").isin(types) & F.col(document_id).isNotNull() & F.col("start").isNotNull()).select(
        F.col(document_id).alias("_doc"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), "text", "entity_type", "after"
    )
    width = F.lit(STRETCH)
    home = F.floor(F.col("start") / width)
    reached = F.floor((F.coalesce(F.col("end"), F.col("start")) + context_bytes(rules)) / width)
    dealt = base.select("*", home.alias("_home"), F.explode(F.sequence(home, F.greatest(home, reached))).alias("_w"))
    placed = dealt.withColumn("_own", F.col("_w") == F.col("_home")).drop("_home").repartition("_doc", "_w").sortWithinPartitions("_doc", "_w", "start")
    pairs = _near_pairs(placed, rules)
    gap = F.col("b_start") - F.col("a_end")
    behind = _slice(_bytes(F.col("b_after")), F.lit(1), F.col("reach"))
    context = (
        F.when(
            gap >= 0,
            F.concat(_slice(_bytes(F.col("a_after")), F.lit(1), gap), _bytes(F.col("b_text")), behind),
        )
        .when(
            F.col("b_end") >= F.col("a_end"),
            F.concat(_slice(_bytes(F.col("b_text")), 1 - gap, F.col("b_end") - F.col("a_end")), behind),
        )
        .otherwise(_slice(_bytes(F.col("a_after")), F.lit(1), F.col("b_end") + F.col("reach") - F.col("a_end")))
    )
    found = pairs.filter(_any_keyword(F.lower(context.cast("string")), rules))
    subject_first = F.col("subject_first")

    def side(when_first: bool, column: str) -> Column:
        a, b = F.col(f"a_{column}"), F.col(f"b_{column}")
        return F.when(subject_first == F.lit(when_first), a).otherwise(b)

    return found.select(
        F.col("_doc").alias(document_id),
        side(True, "text").alias("subject"),
        side(True, "entity_type").alias("subject_type"),
        side(True, "start").alias("subject_start"),
        side(True, "end").alias("subject_end"),
        _by_rule(rules, lambda r: F.lit(r.predicate)).alias("predicate"),
        side(False, "text").alias("object"),
        side(False, "entity_type").alias("object_type"),
        side(False, "start").alias("object_start"),
        side(False, "end").alias("object_end"),
        _by_rule(rules, lambda r: F.lit(r.confidence)).alias("confidence"),
    )


def relation_type(name: Column) -> Column:
    """Canonical spelling of a relation name, NULL when it is unknown."""
    return lookup({r.lower(): r for r in RELATION_TYPES}, F.lower(name))


def model_prompt(system: Column, relation_types: list[str], entities_json: Column, text: Column) -> Column:
    # The words around the parts.
    return F.concat(
        system,
        F.lit(f"\n\nRelation types to extract: {', '.join(relation_types)}\n\nEntities:\n"),
        entities_json,
        F.lit("\n\nText:\n"),
        text,
        F.lit("\n\nExtract relations in JSON format:"),
    )


def parse_responses(
    responses: DataFrame, mentions: DataFrame, document_id: str = "document_id", default_confidence: float = 0.8
) -> DataFrame:
    """Relations named in model answers, both ends resolved to the first mention of that text.

    `responses` has (document_id, response).
    """
    items = F.from_json("response", "array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    named = responses.select(document_id, F.explode(items).alias("r")).select(
        document_id, "r.subject", "r.predicate", "r.object", F.coalesce("r.confidence", F.lit(default_confidence)).alias("confidence")
    )
    first = first_per_group(
        mentions.select(document_id, "text", "start", "end", "entity_type"),
        [document_id, "text"],
        [F.col("start"), F.col("end"), F.col("entity_type")],
    )

    def end(prefix: str) -> DataFrame:
        return first.select(
            document_id, F.col("text").alias(prefix), F.col("entity_type").alias(f"{prefix}_type"),
            F.col("start").alias(f"{prefix}_start"), F.col("end").alias(f"{prefix}_end"),
        )

    return named.join(end("subject"), [document_id, "subject"]).join(end("object"), [document_id, "object"])


def merge_extractors(
    rule_relations: DataFrame,
    model_relations: DataFrame,
    rule_weight: float = 0.6,
    threshold: float = 0.5,
    document_id: str = "document_id",
) -> DataFrame:
    """Weighted confidences of the same (subject, predicate, object) add up, at most 1."""
    columns = [document_id, "subject", "predicate", "object"]
    weighted = rule_relations.select(*columns, (F.col("confidence") * rule_weight).alias("confidence")).unionAll(
        model_relations.select(*columns, (F.col("confidence") * (1.0 - rule_weight)).alias("confidence"))
    )
    merged = weighted.groupBy(*columns).agg(F.least(F.round(F.sum("confidence"), 9), F.lit(1.0)).alias("confidence"))
    return merged.filter(F.col("confidence") >= threshold)
