"""Best-fit packing of tokenised documents by a plan over lengths.

One pass tokenises and writes pieces with their lengths.  The number of pieces
of each length, at most `CAPACITY` numbers, is all that planning needs: best fit
over counts fills a pattern of lengths and uses it as often as the counts allow.
Pieces then take the planned slots by their rank within their length.  Ranks are
numbered inside each input partition first and shifted by what earlier
partitions hold, so a length that very many pieces share is no hot group.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import cut_lineage

CAPACITY = 1024
END = 2  # id behind every document
LONG_RUN = 10_000  # characters of white space that are tokenised apart
# The characters with the property White_Space.
_RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}+")


def encoder(ranks_path: str, pattern: str, special: dict[str, int] | None = None):
    """Function from a text to its ids as little-endian 32-bit numbers.

    The ranks file holds the vocabulary of the tokenizer; its encoder gives the
    same ids several times faster.  Strings of `special` become their ids
    wherever a text holds them; without it they are plain text.

    The pattern looks ahead behind white space, for which its engine runs out of
    stack in runs of about a million.  Long runs are taken out before: the
    pattern makes one piece of a run, without its last character if more follows.
    """
    import tiktoken

    special = special or {}
    with open(ranks_path, "rb") as handle:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, handle)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    one_piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    marks = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def with_long_runs(text: str) -> list[int]:
        ids, at = [], 0
        for run in _RUNS.finditer(text):
            if run.end() - run.start() >= LONG_RUN:
                end = run.end() - (run.end() < len(text))
                ids += encoding.encode_ordinary(text[at : run.start()]) + one_piece.encode_ordinary(text[run.start() : end])
                at = end
        return ids + encoding.encode_ordinary(text[at:])

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and any(r.end() - r.start() >= LONG_RUN for r in _RUNS.finditer(text)):
            parts = marks.split(text) if marks else [text]  # every second part is a mark
            ids = [x for i, part in enumerate(parts) for x in ([special[part]] if i % 2 else with_long_runs(part))]
        else:
            ids = encoding.encode(text, allowed_special="all")
        return np.array([*ids, END], "<u4")

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of each document row, with the number of each among those of its length and input partition.

    A null text is an empty one: the end id alone.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])

    def tokenise(batches):
        encode, part, seen = encoder(ranks_path, pattern, special), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text)
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    out.append((k, start, length, crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names
            )

    return source.mapInArrow(tokenise, schema)


@dataclass(frozen=True)
class Slots:
    """Slots of one length: from rank `low[i]` on, piece after piece goes to sequences from `sequence[i]` on, at `offset[i]`."""

    low: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, Slots], int]:
    """Slots of every length, and the number of sequences.

    The longest length left opens a sequence; again and again the longest that
    fits fills it.  The pattern found serves as many sequences as the counts
    allow, so the work depends on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    open_lengths = sum(1 << n for n in left)  # a bit for each length that is left
    used: Counter = Counter()
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0
    while open_lengths:
        room, usable, pattern = capacity, open_lengths, []
        need: Counter = Counter()
        while True:
            n = (usable & ((1 << (room + 1)) - 1)).bit_length() - 1
            if n <= 0:
                break
            pattern.append((n, capacity - room))
            need[n] += 1
            room -= n
            if need[n] == left[n]:
                usable &= ~(1 << n)
        times = min(left[n] // k for n, k in need.items())
        for n, offset in pattern:
            found.setdefault(n, []).append((used[n], sequences, offset))
            used[n] += times
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                open_lengths &= ~(1 << n)
        sequences += times
    return {n: Slots(*(np.array(c, np.int64) for c in zip(*rows))) for n, rows in found.items()}, sequences


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: its document, place in the document, digest, and place in a sequence.

    Only documents of more than `capacity` tokens are cut.  Repeated rows are
    packed once each; an empty table gives no rows.
    """
    table = cut_lineage(pieces(docs, ranks_path, pattern, id_col, text_col, capacity, special))
    by_part = table.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = table.join(shifts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("shift")).alias("rank")
    )
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        slots = shared.value
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                rows, s = lengths == n, slots[int(n)]
                at = np.searchsorted(s.low, ranks[rows], "right") - 1
                sequence[rows] = s.sequence[at] + ranks[rows] - s.low[at]
                offset[rows] = s.offset[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(place, schema)
