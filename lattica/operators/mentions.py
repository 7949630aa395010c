"""Rule-based entity mentions, span selection and merging of extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import text_slices

# Pattern rules (pattern, entity type, confidence, text every match contains).
PATTERN_RULES = (
    (r"\d+일", "Days", 0.9, "일"),
    (r"\d+개월", "Duration", 0.9, "개월"),
    (r"\d+년", "Duration", 0.9, "년"),
    (r"\d+주", "Duration", 0.9, "주"),
    (r"\d+\s*days?", "Days", 0.9, "day"),
    (r"\d+\s*months?", "Duration", 0.9, "month"),
    (r"\d+\s*years?", "Duration", 0.9, "year"),
    (r"\d+\s*weeks?", "Duration", 0.9, "week"),
    (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", "Date", 0.95, ""),
    (r"\d{1,2}[-/]\d{1,2}[-/]\d{4}", "Date", 0.95, ""),
    (r"\d{1,3}(,\d{3})*원", "Amount", 0.9, "원"),
    (r"\d+만원", "Amount", 0.9, "만원"),
    (r"제\d+조", "Regulation", 0.85, "제"),
    (r"제\d+항", "Regulation", 0.85, "제"),
    (r"\S+신청서", "Form", 0.8, "신청서"),
    (r"\S+양식", "Form", 0.8, "양식"),
    (r"[1-9]급", "Grade", 0.85, "급"),
    (r"(사원|대리|과장|차장|부장|이사|상무|전무|부사장|사장)", "Position", 0.9, ""),
)

# Dictionary (term, entity type, aliases).
DICTIONARY = (
    ("연차", "AnnualLeave", ("연차휴가", "연가", "유급휴가")),
    ("병가", "SickLeave", ("병가휴가", "질병휴가")),
    ("육아휴직", "ParentalLeave", ("육아휴가", "출산휴가", "육휴")),
    ("경조휴가", "CongratulatoryLeave", ("경조사휴가", "경조")),
    ("특별휴가", "LeaveType", ("특휴",)),
    ("공가", "LeaveType", ("공무휴가",)),
    ("대체휴가", "LeaveType", ("대휴",)),
    ("승인", "ApprovalProcess", ("결재", "허가")),
    ("팀장승인", "ApprovalStep", ("팀장결재", "팀장허가")),
    ("부서장승인", "ApprovalStep", ("부서장결재",)),
    ("인사팀승인", "ApprovalStep", ("인사팀결재", "HR승인")),
    ("팀장", "Manager", ("TL", "팀리더")),
    ("부서장", "Manager", ("본부장",)),
    ("인사담당자", "HRStaff", ("HR담당", "인사담당")),
    ("취업규칙", "Regulation", ("근로규칙",)),
    ("인사규정", "Regulation", ("인사규칙",)),
    ("급여규정", "Regulation", ("임금규정", "보수규정")),
    ("복리후생규정", "Regulation", ("복지규정",)),
    ("진단서", "Document", ("의사소견서", "진료확인서")),
    ("출장비", "Expense", ("출장경비", "여비")),
    ("교통비", "Expense", ("차비",)),
    ("식대", "Expense", ("식비", "중식비")),
    ("인사팀", "Department", ("인사부", "HR팀")),
    ("총무팀", "Department", ("총무부", "관리팀")),
    ("재무팀", "Department", ("재무부", "경리팀")),
)
# Confidence of dictionary terms and of their aliases.
TERM_CONFIDENCE, ALIAS_CONFIDENCE = 0.95, 0.9

# Merging of rule and model extractions.
RULE_WEIGHT = 0.6
MERGE_THRESHOLD = 0.5
MODEL_CONFIDENCE = 0.8

MENTION = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
# Text that follows a mention; relations look for their keywords in it.
CONTEXT = T.StructField("after", T.StringType())


@dataclass(frozen=True)
class RuleSet:
    """Extraction rules; small and fixed per job, so they travel inside the task."""

    patterns: tuple[tuple[str, str, float, str], ...] = PATTERN_RULES
    dictionary: tuple[tuple[str, str, tuple[str, ...]], ...] = DICTIONARY

    def with_pattern(self, pattern: str, entity_type: str, confidence: float, contains: str = "") -> RuleSet:
        return RuleSet((*self.patterns, (pattern, entity_type, confidence, contains)), self.dictionary)

    def with_term(self, term: str, entity_type: str, aliases: tuple[str, ...] = ()) -> RuleSet:
        return RuleSet(self.patterns, (*self.dictionary, (term, entity_type, aliases)))

    def terms(self) -> list[tuple[str, str, float]]:
        """Terms and aliases with their types and confidences."""
        listed = []
        for term, kind, aliases in self.dictionary:
            listed.append((term, kind, TERM_CONFIDENCE))
            listed += [(alias, kind, ALIAS_CONFIDENCE) for alias in aliases]
        return listed


def _finder(rules: RuleSet) -> Callable[[str], list[tuple[int, int, str, float]]]:
    """Function giving all (start, end, type, confidence) of a text in characters, by start."""
    patterns = [(re.compile(p), kind, conf, needed) for p, kind, conf, needed in rules.patterns]
    terms = [(t.lower(), re.compile(re.escape(t), re.IGNORECASE), kind, conf) for t, kind, conf in rules.terms()]

    def find(text: str) -> list[tuple[int, int, str, float]]:
        found = []
        for rule, kind, conf, needed in patterns:
            if needed in text:
                found += [(*m.span(), kind, conf) for m in rule.finditer(text)]
        lowered = text.lower()
        aligned = len(lowered) == len(text)
        for term, rule, kind, conf in terms:
            if aligned:
                at, size = lowered.find(term), len(term)
                while at >= 0:
                    found.append((at, at + size, kind, conf))
                    at = lowered.find(term, at + size)
            else:
                found += [(*m.span(), kind, conf) for m in rule.finditer(text)]
        found.sort()
        return found

    return find


def _non_overlapping(found: list[tuple[int, int, str, float]], text: str) -> list[tuple[int, int, str, float]]:
    """Greedy choice by start, then higher confidence, longer span, type and text."""
    kept, last = [], -1
    for m in sorted(found, key=lambda m: (m[0], -m[3], m[0] - m[1], m[2], text[m[0] : m[1]])):
        if m[0] >= last:
            kept.append(m)
            last = m[1]
    return kept


def extract(
    documents: DataFrame,
    rules: RuleSet = RuleSet(),
    document_id: str = "document_id",
    text: str = "text",
    selected: bool = True,
    context_bytes: int = 0,
) -> DataFrame:
    """One row per mention: byte span, text, type, confidence.

    Spark's regular expressions return matches without offsets and know \\d and
    \\s as ASCII only, so the rules run over Arrow batches: one pass over each
    text where it lies, no shuffle; a worker holds the mentions of a slice of a
    batch.  `selected` keeps only the non-overlapping choice.  With `context_bytes` the column after holds that many bytes of
    the text behind the mention.
    """
    id_field = documents.schema[document_id]
    fields = [id_field, *MENTION.fields, *([CONTEXT] if context_bytes else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(rules)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            ids = batch.column(0)
            rows, starts, ends, texts, kinds, confidences, afters = [], [], [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                if not value:
                    continue
                found = find(value)
                if selected:
                    found = _non_overlapping(found, value)
                at, offset = 0, 0
                for start, end, kind, conf in found:
                    offset += len(value[at:start].encode())
                    at = start
                    piece = value[start:end]
                    rows.append(row)
                    starts.append(offset)
                    ends.append(offset + len(piece.encode()))
                    texts.append(piece)
                    kinds.append(kind)
                    confidences.append(conf)
                    if context_bytes:
                        following = value[end : end + context_bytes].encode()[:context_bytes]
                        afters.append(following.decode(errors="ignore"))
            columns = [ids.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                       pa.array(texts, pa.string()), pa.array(kinds, pa.string()), pa.array(confidences, pa.float64())]
            if context_bytes:
                columns.append(pa.array(afters, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return documents.select(document_id, text).mapInArrow(run, T.StructType(fields))


def select_spans(mentions: Column) -> Column:
    """Greedy selection of non-overlapping mentions in an array column.

    For mentions that come from elsewhere; `extract` selects while it scans.
    Ordered by start, then higher confidence, longer span, type and text; a
    mention is kept when it begins at or after the end of the last kept one.
    """
    ordered = F.array_sort(
        F.transform(
            mentions,
            lambda m: F.struct(
                m["start"].alias("start"),
                (-m["confidence"]).alias("order_confidence"),
                (m["start"] - m["end"]).alias("order_length"),
                m["entity_type"].alias("entity_type"),
                m["text"].alias("text"),
                m["end"].alias("end"),
                m["confidence"].alias("confidence"),
            ),
        )
    )
    # Spans are visited by start, so the last kept end is also the largest one.
    empty = F.array().cast(
        "array<struct<start:bigint,order_confidence:double,order_length:bigint,entity_type:string,"
        "text:string,end:bigint,confidence:double>>"
    )
    kept = F.aggregate(
        ordered,
        F.struct(F.lit(-1).cast("bigint").alias("last"), empty.alias("kept")),
        lambda acc, m: F.struct(
            F.when(m["start"] >= acc["last"], m["end"]).otherwise(acc["last"]).alias("last"),
            F.when(m["start"] >= acc["last"], F.array_append(acc["kept"], m)).otherwise(acc["kept"]).alias("kept"),
        ),
        lambda acc: acc["kept"],
    )
    return F.transform(kept, lambda m: F.struct(*[m[c].alias(c) for c in MENTION.fieldNames()]))


# --- language-model extraction -------------------------------------------------


def model_prompt(system: Column, entity_types: list[str], text: Column) -> Column:
    # The words around the parts.
    return F.concat(
        system,
        F.lit(f"\n\nEntity types to extract: {', '.join(entity_types)}\n\nText:\n"),
        text,
        F.lit("\n\nExtract entities in JSON format:"),
    )


def parse_response(response: Column, text: Column) -> Column:
    """Mentions named in a model's JSON answer, located at their first occurrence.

    Unreadable answers give no mentions; items not found in the text are dropped.
    """
    items = F.coalesce(
        F.from_json(response, "array<struct<text:string,entity_type:string,confidence:double>>"),
        F.array().cast("array<struct<text:string,entity_type:string,confidence:double>>"),
    )
    usable = F.filter(items, lambda i: i["text"].isNotNull() & i["entity_type"].isNotNull() & (F.instr(text, i["text"]) > 0))

    def located(i: Column) -> Column:
        start = F.octet_length(F.substring(text, F.lit(1), F.instr(text, i["text"]) - 1)).cast("bigint")
        return F.struct(
            start.alias("start"),
            (start + F.octet_length(i["text"])).alias("end"),
            i["text"].alias("text"),
            i["entity_type"].alias("entity_type"),
            F.coalesce(i["confidence"], F.lit(MODEL_CONFIDENCE)).alias("confidence"),
        )

    return F.transform(usable, located)


def merge_extractors(
    rule_mentions: DataFrame,
    model_mentions: DataFrame,
    rule_weight: float = RULE_WEIGHT,
    threshold: float = MERGE_THRESHOLD,
    document_id: str = "document_id",
) -> DataFrame:
    """One mention per span from two extractors.

    Weighted confidences of the same type add up (at most 1); between types the
    stronger one wins, then the one later in the alphabet.
    """
    rule_weight = min(max(rule_weight, 0.0), 1.0)
    columns = [document_id, "start", "end", "text", "entity_type"]
    weighted = rule_mentions.select(*columns, (F.col("confidence") * rule_weight).alias("confidence")).unionAll(
        model_mentions.select(*columns, (F.col("confidence") * (1.0 - rule_weight)).alias("confidence"))
    )
    by_type = weighted.groupBy(document_id, "start", "end", "entity_type").agg(
        F.min("text").alias("text"), F.least(F.round(F.sum("confidence"), 9), F.lit(1.0)).alias("confidence")
    )
    best = by_type.groupBy(document_id, "start", "end").agg(
        F.max(F.struct("confidence", "entity_type", "text")).alias("_b")
    )
    return best.select(document_id, "start", "end", "_b.*").filter(F.col("confidence") >= threshold)
