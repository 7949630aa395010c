"""Secret scans by a trigram index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived:
an AND of clauses, each an OR of strings, each of which needs all its trigrams.
Any match of the rule satisfies the query.

The index is partitioned by document, as search engines shard theirs: the
postings of a trigram are one bit per document, held beside the rows of their
partition, for all trigrams that some rule asks for.  Intersecting postings is
bit arithmetic within the partition, so neither texts nor postings are shuffled,
and a source that holds a third of all rows is no hot key.  Only candidates of a
rule are verified by its expression; a rule without mandatory trigrams verifies
every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import free_name, once

# re's own reader of regular expressions; the module moved in Python 3.11.
try:
    from re import _parser as regex_reader
except ImportError:  # pragma: no cover
    import sre_parse as regex_reader

MAX_STRINGS = 64  # alternatives of a literal part that are followed; beyond, the part is cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern`, found leftmost and without overlap, as the kind's spans.

    `group` and `least` drop matches whose group has fewer than `least` characters.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


# The patterns and lengths of the first three kinds.
BASE_RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Well-known forms of published credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def _trigrams(string: str) -> frozenset[str]:
    return frozenset(string[i : i + 3] for i in range(len(string) - 2))


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Clauses that every match of `pattern` satisfies, over lower-case trigrams.

    Literals, small character sets, alternatives and optional parts extend a set
    of possible strings; anything else ends it.  A finished set becomes a clause
    unless one of its strings is too short to hold a trigram.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def finish(strings: set[str]) -> None:
        if all(len(s) > 2 for s in strings):
            sets = {_trigrams(s.lower()) for s in strings}
            clauses.append(frozenset(a for a in sets if not any(b < a for b in sets)))  # a superset asks for nothing new

    def exact(items) -> set[str] | None:
        """All strings that a part matches, or None if they are too many."""
        strings = {""}
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                found: set[str] | None = {chr(value)}
            elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in value):
                codes = [c for k, v in value for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
                found = {chr(c).lower() for c in codes} if len(codes) <= 8 else None
            elif name == "BRANCH":
                parts = [exact(x) for x in value[1]]
                found = None if any(p is None for p in parts) else set().union(*parts)
            elif name == "SUBPATTERN":
                found = exact(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1 and value[0] <= 1:
                part = exact(value[2])
                found = None if part is None else part | ({""} if value[0] == 0 else set())
            else:
                found = None
            if found is None or len(found) * len(strings) > MAX_STRINGS:
                return None
            strings = {a + b for a in strings for b in found}
        return strings

    strings = {""}
    for item in regex_reader.parse(pattern):
        found = exact([item])
        if found is not None and len(found) * len(strings) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in found}
            continue
        finish(strings)
        strings = found if found is not None else {""}
    finish(strings)
    return clauses


def with_postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, str, list[str]]:
    """Documents and their bits in the postings of every trigram that a rule asks for.

    Returns the frame, the name of the new column (an array of longs, 62
    trigrams each) and the trigrams in order of their bits.
    """
    grams = sorted({g for rule in rules for clause in trigram_query(rule.pattern) for string in clause for g in string})
    lower = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    name, small = free_name(docs, "_postings"), free_name(docs, "_lower")
    words = []
    for at in range(0, len(grams), 62):
        bits = [F.when(F.contains(F.col(small), F.lit(g)), F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                for k, g in enumerate(grams[at : at + 62])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    lowered = once(docs, lower, small)
    return once(lowered, F.array(*words) if words else F.array().cast("array<bigint>"), name).drop(small), name, grams


def candidate(rule: Rule, postings: Column, grams: list[str]) -> Column:
    """Whether a document is in the intersection that the rule's trigram query describes."""
    place = {g: i for i, g in enumerate(grams)}

    def holds(string: frozenset[str]) -> Column:
        need: dict[int, int] = {}
        for g in string:
            need[place[g] // 62] = need.get(place[g] // 62, 0) | 1 << place[g] % 62
        tests = [postings[k].bitwiseAND(F.lit(bits).cast("bigint")) == bits for k, bits in sorted(need.items())]
        return reduce(lambda a, b: a & b, tests)

    clauses = [reduce(lambda a, b: a | b, [holds(s) for s in sorted(clause, key=sorted)]) for clause in trigram_query(rule.pattern)]
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def _spans(rule: Rule, number: int, text: Column) -> Column:
    """Array of (start, rank of kind, end) of a rule's matches, in code points.

    The text between matches and the matches themselves add up to the positions.
    """
    between = F.transform(F.split(text, rule.java, -1), F.char_length)
    found = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else found
    pieces = F.arrays_zip(between.alias("gap"), F.transform(found, F.char_length).alias("size"), F.transform(kept, F.char_length).alias("kept"))
    item = "struct<s:int,k:int,e:int>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start, size = s["at"] + x["gap"], F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("s"), F.lit(number).alias("k"), (start + size).alias("e"))
        good = (size > 0) & (F.coalesce(x["kept"], F.lit(0)) >= rule.least)
        return F.struct((start + size).alias("at"), F.when(good, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, state, step, lambda s: s["out"])


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> tuple[DataFrame, str]:
    """Documents and the name of a new column: spans of all rules, by start, then kind as listed.

    A null or empty text has no spans.  Rows keep their place: repeated rows are
    scanned alike.
    """
    out, postings, grams = with_postings(docs, rules, text_col)
    name = free_name(out, "_spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    parts = []
    for number, rule in enumerate(rules):
        # regexp_like stops at the first match, so most candidates cost one search.
        verify = candidate(rule, F.col(postings), grams) & F.rlike(text, F.lit(rule.java))
        parts.append(F.when(verify, _spans(rule, number, text)).otherwise(none))
    return once(out, F.array_sort(F.concat(*parts)), name).drop(postings), name


def listed(spans: Column, rules: tuple[Rule, ...], first: int | None = None) -> Column:
    """`kind:start:end` of the spans (of the first kinds only), comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    chosen = spans if first is None else F.filter(spans, lambda x: x["k"] < first)
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"], x["e"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, spans of each base kind, digest of these and all spans."""
    out, spans = with_spans(docs.select(id_col, text_col), RULES, text_col)
    count = lambda k: F.size(F.filter(F.col(spans), lambda x: x["k"] == k)).cast("bigint")
    return out.select(
        F.col(id_col).alias("doc_id"),
        *[count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE_RULES)],
        F.sha2(listed(F.col(spans), RULES, len(BASE_RULES)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col(spans), RULES).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[REMOVED]") -> DataFrame:
    """`docs` with every span replaced by `mark`; overlapping spans become one mark.

    Rows, other columns and texts without spans stay as they are; a null text stays null.
    """
    out, spans = with_spans(docs, rules, text_col)
    text = F.col(text_col)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["s"] >= s["at"]
        before = F.substring(text, s["at"] + 1, x["s"] - s["at"])
        return F.struct(
            F.greatest(s["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(s["out"], before, F.lit(mark))).otherwise(s["out"]).alias("out"),
        )

    cleaned = F.aggregate(F.col(spans), state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return out.withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text)).select(*docs.columns)
