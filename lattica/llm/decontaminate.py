"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark texts are cut into windows of `WINDOW` words (a shorter, non-empty
text is one window).  Documents are normalised to words joined by one space, so
that an occurrence of a window is an occurrence of its bytes between spaces.

The search keeps, for patterns of about one length, a table of shifts indexed by
the hash of a block of bytes: how far the search may jump when the block ends at
the current position.  Only where the shift is zero does the hash of that block
(the suffix of the first `m` bytes of a pattern) name a bucket of test strings,
and each of them is compared directly.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import append_columns, free_name, texts_of

WINDOW = 13
# Bytes of benchmark text that are compiled and broadcast together.  A byte makes
# at most one place of a shift table for each group of lengths, 64 bytes wide at
# most, so tables stay below some 100 MB.  A larger benchmark makes further
# passes over the same partitions.
BYTES_PER_BLOCK = 1 << 20
PART = 1000  # windows of an item that are compiled together
# A document is contaminated if at least one word in SHARE is inside a window.
SHARE = 20

# Byte -> byte: A-Z to a-z, characters that are no part of a word to a space.
_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of a UTF-8 text; a null has none."""
    return (text or b"").translate(_NORMAL).split()


class Group:
    """Patterns whose lengths lie within a factor of two, ready to search."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        self.m = min(map(len, patterns))
        self.block = max(1, min(8, self.m // 2))
        m, b = self.m, self.block
        ends = {}  # block -> smallest distance from its end to the end of the first m bytes
        for p in patterns:
            for i in range(b, m + 1):
                piece = p[i - b : i]
                if m - i < ends.get(piece, m):
                    ends[piece] = m - i
        self.mask = (1 << max(12, (16 * len(ends)).bit_length())) - 1
        self.shift = array("H", [min(m - b + 1, 65535)]) * (self.mask + 1)
        for piece, distance in ends.items():
            h = crc32(piece) & self.mask
            self.shift[h] = min(self.shift[h], distance)
        self.buckets: dict[int, list[tuple[bytes, list[str]]]] = {}
        for p, items in patterns.items():
            self.buckets.setdefault(crc32(p[m - b : m]) & self.mask, []).append((p, items))

    def search(self, text: bytes) -> Iterable[tuple[int, bytes, list[str]]]:
        """Start, pattern and items of every occurrence."""
        m, b, mask, shift, buckets = self.m, self.block, self.mask, self.shift, self.buckets
        i, end = m, len(text)
        while i <= end:
            h = crc32(text[i - b : i]) & mask
            jump = shift[h]
            if jump:
                i += jump
                continue
            for pattern, items in buckets.get(h, ()):
                if text.startswith(pattern, i - m):
                    yield i - m, pattern, items
            i += 1


def compile_windows(rows: Iterable[tuple[bytes, str]]) -> list[Group]:
    """Search tables of (window, item) pairs, grouped by the windows' lengths."""
    by_length: dict[int, dict[bytes, list[str]]] = {}
    for window, item in rows:
        pattern = b" " + bytes(window) + b" "
        by_length.setdefault(len(pattern).bit_length(), {}).setdefault(pattern, []).append(item)
    return [Group(patterns) for _, patterns in sorted(by_length.items())]


def windows(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct (`window`, `item`) of the benchmark, the item's `part` and the bytes that the window adds to it.

    A null id is the item `null`.  A window overlaps the one before but for a word.
    """
    source = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")
    )

    def cut(batches):
        for batch in batches:
            found, items, parts, added = [], [], [], []
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch.column("text"))):
                words = words_of(text)
                if words:
                    cuts = [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]
                    found += cuts
                    items += [item] * len(cuts)
                    parts += [i // PART for i in range(len(cuts))]
                    added += [len(c) + 2 if i % PART == 0 else len(words[i + window - 1]) + 1 for i, c in enumerate(cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(items, pa.string()), pa.array(parts, pa.int64()), pa.array(added, pa.int64())], names=["window", "item", "part", "added"]
            )

    pairs = source.mapInArrow(cut, "window binary, item string, part long, added long")
    return pairs.groupBy("window", "item").agg(F.min(F.struct("part", "added")).alias("p")).select("window", "item", "p.part", "p.added")


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    per_block: int = BYTES_PER_BLOCK,
) -> tuple[DataFrame, dict[str, str]]:
    """Documents and what the benchmark covers of each, row by row.

    Returns the frame and the names of its new columns: `n_words`, `spans` (first
    word and number of words of each occurrence), `items` (sorted).  Every row
    keeps its place, so repeated rows are judged alike and nothing is shuffled.
    A null or empty text has no words; an empty benchmark hits nothing.
    """
    pairs = windows(benchmark, item_col, item_text_col, window)
    blocks = max(1, ceil((pairs.agg(F.sum("added")).first()[0] or 0) / per_block))
    cols = {k: free_name(docs, f"_{k}") for k in ("n_words", "spans", "items")}
    span = T.ArrayType(T.ArrayType(T.IntegerType()))
    out = docs
    for block in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == block).collect()
        tables = docs.sparkSession.sparkContext.broadcast(compile_windows((r.window, r.item) for r in rows))
        last = {k: free_name(out, f"{v}_{block}") for k, v in cols.items()}
        fields = [T.StructField(last["n_words"], T.LongType()), T.StructField(last["spans"], span), T.StructField(last["items"], T.ArrayType(T.StringType()))]

        def start(tables=tables):
            groups = tables.value

            def step(batch):
                counts, spans, items = [], [], []
                for text in texts_of(batch.column(text_col)):
                    words = words_of(text)
                    counts.append(len(words))
                    hits, found = [], set()
                    if words and groups:
                        line = b" " + b" ".join(words) + b" "
                        at = None
                        for group in groups:
                            for pos, pattern, ids in group.search(line):
                                if at is None:
                                    at = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                                hits.append([int(np.searchsorted(at, pos)), pattern.count(b" ") - 1])
                                found.update(ids)
                    spans.append(hits)
                    items.append(sorted(found))
                return [
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array(items, pa.list_(pa.string())),
                ]

            return step

        out = append_columns(out, fields, start)
        if block:
            out = out.withColumns({
                last["spans"]: F.concat(F.col(before["spans"]), F.col(last["spans"])),
                last["items"]: F.array_sort(F.array_union(before["items"], last["items"])),
            }).drop(*before.values())
        before = last
    return out.withColumnsRenamed({before[k]: cols[k] for k in cols}), cols


def verdicts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = SHARE, **options) -> tuple[DataFrame, dict[str, str]]:
    """Documents with `n_words`, `n_hit`, `n_items`, `items_sha256` and `contaminated`.

    A word inside any occurrence is hit.  A document is contaminated if it has a
    hit and `share * n_hit >= n_words`.
    """
    found, cols = with_hits(docs, benchmark, text_col, **options)
    names = {k: free_name(found, f"_{k}") for k in ("n_hit", "n_items", "items_sha256", "contaminated")}
    # Spans lie in no order; the union of their lengths is counted from the sorted starts.
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit"))
    union = F.aggregate(
        F.array_sort(F.col(cols["spans"])),
        state,
        lambda s, x: F.struct(
            F.greatest(s["end"], x[0] + x[1]).alias("end"),
            (s["hit"] + F.greatest(F.lit(0), x[0] + x[1] - F.greatest(s["end"], x[0]))).alias("hit"),
        ),
        lambda s: s["hit"],
    )
    out = found.withColumns({
        names["n_hit"]: union,
        names["n_items"]: F.size(cols["items"]).cast("bigint"),
        names["items_sha256"]: F.sha2(F.array_join(cols["items"], ",").cast("binary"), 256),
    }).withColumn(names["contaminated"], (F.col(names["n_hit"]) > 0) & (share * F.col(names["n_hit"]) >= F.col(cols["n_words"])))
    return out, cols | names


def digest(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document row: id, counts, digest of the items and the decision."""
    out, c = verdicts(docs.select(id_col, text_col), benchmark, text_col, **options)
    return out.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(c[k]).alias(k) for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")],
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their own columns."""
    out, c = verdicts(docs, benchmark, text_col, **options)
    return out.where(~F.col(c["contaminated"])).select(*docs.columns)
