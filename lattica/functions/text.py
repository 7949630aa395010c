"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words never used as keywords.
STOPWORDS = ("은", "는", "이", "가", "를", "을", "의", "에", "와", "과", "the", "a", "is", "are", "what", "how")

# Leading characters of a content that decide whether two hits are the same.
CONTENT_KEY_CHARS = 100
# Characters of a source quoted in a citation.
CITATION_CHARS = 200

# File extension -> type, and type -> MIME type.
FILE_TYPES = {
    "pdf": "pdf",
    "docx": "docx",
    "xlsx": "xlsx",
    "xls": "xls",
    "pptx": "pptx",
    "md": "markdown",
    "markdown": "markdown",
    "txt": "text",
    "html": "html",
    "htm": "html",
}
MIME_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "markdown": "text/markdown",
    "text": "text/plain",
    "html": "text/html",
    "unknown": "application/octet-stream",
}


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL for an unknown key."""
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def words(text: Column) -> Column:
    """White-space separated words, empty strings removed."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def keywords(question: Column) -> Column:
    """Words of more than one byte that are not stop words, in order, case kept."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(
        F.split(question, r"(?U)\s+"),
        lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stop, F.lower(w)),
    )


def content_key(content: Column, chars: int | None = CONTENT_KEY_CHARS) -> Column:
    """Hits with the same leading characters, or the same whole content, are the same hit."""
    return content if chars is None else F.substring(content, 1, chars)


def file_type(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(lookup(FILE_TYPES, extension), F.lit("unknown"))


def mime_type(kind: Column) -> Column:
    return F.coalesce(lookup(MIME_TYPES, kind), F.lit(MIME_TYPES["unknown"]))


def is_header(line: Column) -> Column:
    """Whether a line of extracted text looks like a heading."""
    trimmed = strip(line)
    numbered = trimmed.rlike(r"^(\p{N}|제|Chapter|Section)")
    all_caps = trimmed.rlike(r"\p{Lu}") & ~trimmed.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")
    article = trimmed.contains("조") & (F.octet_length(trimmed) < 50)
    return (trimmed != "") & (F.octet_length(trimmed) <= 100) & (numbered | all_caps | article)


def heading_level(line: Column) -> Column:
    """1 for chapters, 2 for sections, otherwise the depth of the dotted number."""
    trimmed = strip(line)
    prefix = F.regexp_extract(trimmed, r"^([\p{N}.]*)", 1)
    dots = F.length(prefix) - F.length(F.replace(prefix, F.lit("."), F.lit("")))
    return (
        F.when(trimmed.rlike(r"^(Chapter|제|CHAPTER)"), F.lit(1))
        .when(trimmed.rlike(r"^(Section|절)"), F.lit(2))
        .when(dots > 0, F.least(dots + 1, F.lit(6)))
        .otherwise(F.lit(1))
        .cast("bigint")
    )


def _markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""), F.lit("\n"))


def table_markdown(headers: Column, rows: Column) -> Column:
    """A table as Markdown: header row and rule only when there are headers."""
    rule = _markdown_row(F.transform(headers, lambda _: F.lit("---")))
    head = F.when(F.size(headers) > 0, F.concat(_markdown_row(headers), rule)).otherwise("")
    body = F.array_join(F.transform(rows, _markdown_row), "")
    return F.concat(head, body)


def normalize_endpoint(path: Column) -> Column:
    """Replace path segments that are UUIDs or all digits by ``:id``."""
    identifier = r"^([0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
    return F.array_join(
        F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(identifier), F.lit(":id")).otherwise(s)), "/"
    )


def client_ip(forwarded_for: Column, real_ip: Column) -> Column:
    """First address of X-Forwarded-For, else X-Real-IP."""
    return F.coalesce(F.trim(F.get(F.split(forwarded_for, ","), F.lit(0))), real_ip)


# Messages of the password rules, in the order they are checked.
PASSWORD_MESSAGES = (
    "Password must be at least 8 characters long",
    "Password must contain at least one uppercase letter",
    "Password must contain at least one lowercase letter",
    "Password must contain at least one digit",
    "Password must contain at least one special character",
)


def password_problem(password: Column) -> Column:
    """The first rule a password breaks, NULL when it breaks none."""
    broken = (
        F.octet_length(password) < 8,
        ~password.rlike(r"\p{Lu}"),
        ~password.rlike(r"\p{Ll}"),
        ~password.rlike(r"[0-9]"),
        ~password.rlike(r"[^\p{L}\p{N}]"),
    )
    return F.coalesce(*[F.when(test, F.lit(m)) for test, m in zip(broken, PASSWORD_MESSAGES)])


def looks_like_email(text: Column) -> Column:
    return text.contains("@")


def is_uuid(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def uuid_or_nil(text: Column) -> Column:
    return F.when(is_uuid(text), F.lower(text)).otherwise("00000000-0000-0000-0000-000000000000")


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id that is the same on every run and on every retry of a task."""
    digest = F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
