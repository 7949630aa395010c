"""Reading document files: text, Markdown, DOCX, XLSX and, through a provider, PDF and images.

Every reader gives the columns of PARSED.  Files are listed and distributed by
Spark; a binary format is decoded file by file inside Arrow batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import FILE_TYPES, file_type, mime_type, word_count
from lattica.operators.sections import page_count, parsed_title

SECTION = "struct<title:string,level:int,content:string,start_page:int>"
TABLE = "struct<caption:string,headers:array<string>,rows:array<array<string>>,page:int>"
PARSED = (
    f"file_path string, file_type string, content string, sections array<{SECTION}>, tables array<{TABLE}>, "
    "title string, page_count bigint, word_count bigint, custom map<string,string>, error string"
)
_DECODED = f"struct<content:string,sections:array<{SECTION}>,tables:array<{TABLE}>,title:string,custom:map<string,string>,error:string>"

# File types a built-in reader exists for.
TEXT_TYPES = ("text", "markdown")
OFFICE_TYPES = ("docx", "xlsx")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain text and Markdown, one row per file; Markdown is not divided into sections."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    return raw.select(
        "file_path",
        file_type(F.col("file_path")).alias("file_type"),
        "content",
        F.array().cast(f"array<{SECTION}>").alias("sections"),
        F.array().cast(f"array<{TABLE}>").alias("tables"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("bigint").alias("page_count"),
        word_count(F.col("content")).alias("word_count"),
        F.create_map().cast("map<string,string>").alias("custom"),
        F.lit(None).cast("string").alias("error"),
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_path, file_type, mime_type, length, content): file contents as bytes."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    kind = file_type(F.col("path"))
    return raw.select(F.col("path").alias("file_path"), kind.alias("file_type"), mime_type(kind).alias("mime_type"), "length", "content")


def markdown(headers: list[str], rows: list[list[str]]) -> str:
    lines = [headers, ["---"] * len(headers), *rows] if headers else rows
    return "".join("|" + "".join(f" {cell} |" for cell in line) + "\n" for line in lines)


# --- DOCX -----------------------------------------------------------------------


def _paragraph(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for run in node.findall(f"{_W}r") for t in run.findall(f"{_W}t"))


def _heading(node: ElementTree.Element) -> int | None:
    """Level of a heading paragraph: the last digit of its style, 1 without a digit."""
    style = node.find(f"{_W}pPr/{_W}pStyle")
    name = style.get(f"{_W}val", "") if style is not None else ""
    if not name.startswith(("Heading", "heading")):
        return None
    return int(name[-1]) if name[-1].isdigit() else 1


def decode_docx(data: bytes) -> dict:
    """Content, sections by heading style, and tables of one DOCX file."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    content, tables, sections = [], [], [{"title": None, "level": 1, "lines": []}]
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            text, level = _paragraph(node), _heading(node)
            content.append(text + "\n")
            if level is None:
                sections[-1]["lines"].append(text)
            elif text.strip():
                sections.append({"title": text.strip(), "level": level, "lines": []})
        elif node.tag == f"{_W}tbl":
            rows = [
                [" ".join(_paragraph(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")]
                for row in node.findall(f"{_W}tr")
            ]
            headers, rows = (rows[0], rows[1:]) if rows else ([], [])
            tables.append({"caption": None, "headers": headers, "rows": rows, "page": None})
            content.append(markdown(headers, rows) + "\n")
    kept = []
    for section in sections:
        text = "\n".join(section["lines"]).strip()
        if text or section["title"] is not None:
            kept.append({"title": section["title"], "level": section["level"], "content": text, "start_page": None})
    return {
        "content": "".join(content),
        "sections": kept,
        "tables": tables,
        "title": kept[0]["title"] if kept else None,
        "custom": {},
    }


# --- XLSX -----------------------------------------------------------------------


def cell_text(kind: str | None, value: str | None) -> str:
    """Cell value as text: whole numbers without decimals, booleans in capitals."""
    if value is None:
        return ""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind == "e":
        return f"#ERROR: {value}"
    if kind in ("s", "str", "inlineStr", "d"):
        return value
    number = float(value)
    return str(int(number)) if number.is_integer() else repr(number)


def cell_column(kind: Column, value: Column) -> Column:
    """The same coercion for cells held in columns."""
    number = value.try_cast("double")
    return (
        F.when(value.isNull(), "")
        .when(kind == "b", F.when(value == "1", "TRUE").otherwise("FALSE"))
        .when(kind == "e", F.concat(F.lit("#ERROR: "), value))
        .when(kind.isin("s", "str", "inlineStr", "d"), value)
        .when(number == F.floor(number), number.cast("bigint").cast("string"))
        .otherwise(number.cast("string"))
    )


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def decode_xlsx(data: bytes, sheet_filter: list[str] | None = None, first_row_header: bool = True) -> dict:
    """One table per sheet; its first row gives the headers, empty rows are dropped."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in root.findall(f"{_S}si")]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_S}sheets/{_S}sheet")
    content, tables = [], []
    for sheet in sheets:
        name = sheet.get("name")
        if sheet_filter and name not in sheet_filter:
            continue
        part = targets[sheet.get(f"{_R}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(part if part.startswith("xl/") else f"xl/{part}"))
        grid = []
        for row in root.iter(f"{_S}row"):
            cells: dict[int, str] = {}
            column = -1
            for cell in row.findall(f"{_S}c"):
                kind, value = cell.get("t"), cell.find(f"{_S}v")
                text = value.text if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                # A cell without a reference follows the one before.
                column = _column_index(cell.get("r")) if cell.get("r") else column + 1
                cells[column] = cell_text(kind, text)
            grid.append(cells)
        width = max((max(c) + 1 for c in grid if c), default=0)
        rows = [[c.get(i, "") for i in range(width)] for c in grid]
        headers, rows = (rows[0], rows[1:]) if rows and first_row_header else ([], rows)
        rows = [r for r in rows if any(r)]
        tables.append({"caption": name, "headers": headers, "rows": rows, "page": None})
        content.append(f"## {name}\n\n{markdown(headers, rows)}\n\n")
    return {
        "content": "".join(content),
        "sections": [],
        "tables": tables,
        "title": sheets[0].get("name") if sheets else None,
        "custom": {"sheet_count": str(len(sheets))},
    }


# --- dispatch -------------------------------------------------------------------

Decoder = Callable[[bytes], dict]
DECODERS: dict[str, Decoder] = {"docx": decode_docx, "xlsx": decode_xlsx}
TYPE_OF_SUFFIX = FILE_TYPES
_EMPTY = {"content": None, "sections": [], "tables": [], "title": None, "custom": {}, "error": None}


def _decoded(kind: str, data: bytes, decoders: dict[str, Decoder]) -> dict:
    """What a decoder makes of a file, or why it cannot."""
    if kind not in decoders:
        return {**_EMPTY, "error": f"Unsupported format: {kind}"}
    try:
        return {**_EMPTY, **decoders[kind](bytes(data))}
    except Exception as problem:
        return {**_EMPTY, "error": f"{type(problem).__name__}: {problem}"}


def _decode_text(data: bytes) -> dict:
    try:
        return {"content": data.decode()}
    except UnicodeDecodeError:
        raise ValueError("Content is not valid UTF-8") from None


def decoded_row(path: str, kind: str, data: bytes | None, decoders: dict[str, Decoder], error: str | None = None) -> tuple:
    """One file as a row of PARSED, outside the JVM."""
    found = {**_EMPTY, "error": error} if data is None else _decoded(kind, data, {**dict.fromkeys(TEXT_TYPES, _decode_text), **decoders})
    content, title = found["content"], found["title"]
    pages = None
    if kind == "pdf" and content is not None:
        pages = content.count("\f") + 1 if "\f" in content else None
        line = content.split("\n")[0].strip()
        title = title if title is not None else line if line and len(line.encode()) < 200 else None
    words = None if content is None else len(content.split())
    sections = [tuple(x[k] for k in ("title", "level", "content", "start_page")) for x in found["sections"]]
    grids = [tuple(x[k] for k in ("caption", "headers", "rows", "page")) for x in found["tables"]]
    return path, kind, content, sections, grids, title, pages, words, found["custom"], found["error"]


def _decode(kind: Column, content: Column, decoders: dict[str, Decoder]) -> Column:
    @F.pandas_udf(_DECODED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, contents in batches:
            out = [_EMPTY if data is None else _decoded(name, data, decoders) for name, data in zip(kinds, contents)]
            yield pd.DataFrame(out, columns=list(_EMPTY))

    return run(kind, content)


def parsed_rows(files: DataFrame, extra_decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Every file of a `list_files` table as a row of PARSED; one that cannot be read tells why in `error`.

    Text, Markdown, DOCX and XLSX are built in.  `extra_decoders` adds formats
    that need a library, such as PDF; a PDF decoder returns its text with form
    feeds between pages.  One pass decodes each file once; texts stay on the JVM.
    """
    decoders = {**DECODERS, **(extra_decoders or {})}
    kind, text = F.col("file_type"), F.col("file_type").isin(*TEXT_TYPES)
    whole = F.col("content").cast("string")
    utf8 = F.is_valid_utf8(whole)
    rows = files.select("file_path", "file_type", "content", _decode(kind, F.when(~text, F.col("content")), decoders).alias("_d")).select(
        "file_path", "file_type",
        F.when(text & utf8, whole).otherwise(F.col("_d.content")).alias("content"),
        "_d.sections", "_d.tables", "_d.title", "_d.custom",
        F.when(text & ~utf8, "ValueError: Content is not valid UTF-8").otherwise(F.col("_d.error")).alias("error"),
    )
    pdf = F.col("file_type") == "pdf"
    return rows.select(
        "file_path", "file_type", "content", "sections", "tables",
        F.when(pdf, parsed_title(F.col("title"), F.col("content"))).otherwise(F.col("title")).alias("title"),
        F.when(pdf, page_count(F.col("content"))).alias("page_count"),
        word_count(F.col("content")).alias("word_count"), "custom", "error",
    )


def parse(files: DataFrame, extra_decoders: dict[str, Decoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """(parsed documents, rejected files) of a `list_files` table.

    Both are filters of `parsed_rows`; store that first if both are wanted, so
    that files are decoded once.
    """
    rows = parsed_rows(files, extra_decoders)
    return rows.filter(F.col("error").isNull()), rows.filter(F.col("error").isNotNull()).select("file_path", "file_type", "error")


class OcrEngine:
    """Interface of a text recogniser; one image in, (text, confidence) out."""

    # Fixed value: confidence reported for recognised text.
    CONFIDENCE = 0.9

    def recognize(self, image: bytes, language: str) -> str:
        raise NotImplementedError


def ocr(images: DataFrame, engine: OcrEngine, language: str = "eng") -> DataFrame:
    """(file_path, page, text, confidence, language, error) of images in path order."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            texts, errors = [], []
            for data in contents:
                try:
                    texts.append(engine.recognize(bytes(data), language))
                    errors.append(None)
                except Exception as problem:
                    texts.append(None)
                    errors.append(str(problem))
            yield pd.DataFrame({"text": texts, "error": errors})

    return images.select("file_path", F.col("page"), run("content").alias("_o")).select(
        "file_path", "page", "_o.text", F.lit(OcrEngine.CONFIDENCE).alias("confidence"), F.lit(language).alias("language"), "_o.error"
    )
