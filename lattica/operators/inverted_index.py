"""Keyword search from postings.

A posting says how often an item holds a term.  Items are numbered as they are
read, and `PER_BLOCK` neighbours form a block.  A written index has one row per
term and block: the largest frequency and the postings themselves, in folders by
a hash of the term, so a search reads the folders of the asked terms only.

A request's score of an item is the mean of n / (n + SATURATION) over its
keywords.  The largest frequencies bound every score in a block.  A search first
scores the most promising blocks of each request; their k-th best score is a bar
that most other blocks cannot reach, and only the rest is read.

Without a written index the postings of the asked terms alone are counted in one
pass over the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.scoring import RANK_DIGITS, REQUEST_BYTES, request_blocks
from lattica.operators.topk import top_k_per_group
from lattica.session import new_folder, text_slices

# Fixed value: frequency at which a keyword counts half.
SATURATION = 1.2
PER_BLOCK = 64
FOLDERS = 256
SCANS = 32  # tasks of the scan whose lists share a file of each folder
SEEDS = 4  # blocks of each request that are scored to find the bar
PAIRS = 1 << 18  # pairs of a request and an item that a task adds up at most
MOST_TASKS = 10_000
NEAR = 1 << 18  # pairs of a request and a block that are sent to every task at most

# White space as `terms_of` knows it, and what else str.split takes for it.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def terms_of(text: Column) -> Column:
    """Lower-case words, separated by any white space; empty strings are no asked terms."""
    return F.split(F.lower(text), r"(?U)\s+")


def saturated(n: Column) -> Column:
    return n / (n + F.lit(SATURATION))


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _words(text: str) -> list[str]:
    """The words of `terms_of`; Python alone takes four separators of files and records for white space."""
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


def _lists(counts: dict, kind: pa.DataType, block: int, names: list[str]) -> pa.RecordBatch:
    """One row per term of a block from the words' counts of each item."""
    ids = sorted(counts, key=lambda i: (i is not None, i))
    codes: dict[str, int] = {}
    term = np.fromiter((codes.setdefault(t, len(codes)) for i in ids for t in counts[i]), np.int64)
    n = np.fromiter((n for i in ids for n in counts[i].values()), np.int64, len(term))
    place = np.repeat(np.arange(len(ids)), [len(counts[i]) for i in ids])
    order = np.argsort(term, kind="stable")  # by term, then by id
    starts = np.searchsorted(term[order], np.arange(len(codes) + 1)).astype(np.int32)
    n, holders = n[order], pa.array(ids, kind).take(pa.array(place[order]))
    most = np.maximum.reduceat(n, starts[:-1])
    lists = [pa.ListArray.from_arrays(pa.array(starts), values) for values in (holders, pa.array(n))]
    return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), pa.array(np.full(len(codes), block, np.int64)), pa.array(most), *lists], names=names)


def postings(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(`term`, `block`, `most`, `item_id`, `n`) of every word, the last two as lists: a block lies in one task, so its lists are made where it is read."""
    block = F.shiftright(F.monotonically_increasing_id(), PER_BLOCK.bit_length() - 1)
    numbered = items.select(F.col(id_column).alias("item_id"), block.alias("block"), F.lower(text).alias("text"))
    kind = items.schema[id_column].dataType.simpleString()
    names = ["term", "block", "most", "item_id", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, kind = None, {}, None
        for batch in (part for whole in batches for part in text_slices(whole, 2)):
            kind = batch.schema.field(0).type
            for i, number, value in zip(*(c.to_pylist() for c in batch.columns)):
                if number != at:
                    if counts:
                        yield _lists(counts, kind, at, names)
                    at, counts = number, {}
                if words := _words(value or ""):
                    counts.setdefault(i, Counter()).update(words)
        if counts:
            yield _lists(counts, kind, at, names)

    return numbered.mapInArrow(run, f"term string, block long, most long, item_id array<{kind}>, n array<long>")


def write(items: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the index of `items` with one shuffle; the lists of SCANS tasks of a folder form a file, so a term of very many items spans several."""
    part = F.shiftright("block", 33 - (PER_BLOCK.bit_length() - 1) + SCANS.bit_length() - 1)
    lists = postings(items, id_column, text).withColumn("folder", folder_of(F.col("term")))
    dealt = lists.repartition("folder", part).sortWithinPartitions("folder", "term", "block")
    dealt.select("term", "block", "most", F.arrays_zip("item_id", "n").alias("entries"), "folder").write.partitionBy("folder").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


@dataclass(frozen=True)
class Asked:
    """A block of requests, small enough to travel to every task; terms go by number."""

    terms: DataFrame  # term, number
    pairs: DataFrame  # request_id, number, asked: how many keywords the request has

    @staticmethod
    def of(spark: SparkSession, kind: str, ids: list, payloads: list) -> Asked:
        numbers = {t: i for i, t in enumerate(dict.fromkeys(t for terms in payloads for t in terms or ()))}
        pairs = [(i, numbers[t], len(terms)) for i, terms in zip(ids, payloads) for t in terms or ()]
        return Asked(
            F.broadcast(spark.createDataFrame(list(numbers.items()), "term string, number int")),
            F.broadcast(spark.createDataFrame(pairs, f"request_id {kind}, number int, asked int")),
        )

    def folders(self) -> list[int]:
        return sorted(r.folder for r in self.terms.select(folder_of(F.col("term")).alias("folder")).distinct().collect())  # FOLDERS at most

    def numbered(self, lists: DataFrame) -> DataFrame:
        """Rows of a table with a column `term` that any request asks for."""
        return lists.join(self.terms, "term").drop("term")

    def hits(self, lists: DataFrame) -> DataFrame:
        """Rows of a table with a column `term`, for each request that asks for it."""
        return self.numbered(lists).join(self.pairs, "number")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(scores, ["request_id"], [F.col("score").desc(), F.col("item_id")], k)


def _scores(hits: DataFrame) -> DataFrame:
    """Scores of the items in rows of (`request_id`, `asked`, `item_id`, `n`), one for each keyword."""
    total = F.sum(saturated(F.col("n"))) / F.max("asked")
    return hits.groupBy("request_id", "item_id").agg(F.round(total, RANK_DIGITS).alias("score")).where("score > 0")


def tasks_for(items: int, requests: int) -> int:
    """Tasks in which `items` meet `requests`, about PAIRS pairs in each."""
    return min(items * requests // PAIRS + 1, MOST_TASKS)


def from_texts(items: DataFrame, asked: Asked, id_column: str, text: str, tasks: int = 1) -> DataFrame:
    """Scores from one pass over the texts: words that nobody asks for end in the scan.

    What is left of an item is counted, scored and added up in one of `tasks`
    tasks, so it is shuffled once, as numbers.  Few numbers become many pairs
    with requests, so tasks are dealt by these and not by the bytes shuffled.
    """
    words = items.select(F.col(id_column).alias("item_id"), F.explode(terms_of(F.col(text))).alias("term"))
    numbers = words.join(asked.terms, "term").select("item_id", "number").repartition(tasks, "item_id")
    counted = numbers.groupBy("item_id", "number").agg(F.count("*").alias("n"))
    return _scores(counted.join(asked.pairs, "number"))


def candidate_blocks(index: DataFrame, asked: Asked, k: int) -> tuple[DataFrame, DataFrame]:
    """(`request_id`, `block`, `bound`) of all blocks that hold an asked term, and of those that may hold one of the k best items."""
    hits = asked.hits(index)
    bound = F.sum(saturated(F.col("most"))) / F.max("asked")
    bounds = hits.groupBy("request_id", "block").agg(bound.alias("bound"))
    seeds = top_k_per_group(bounds, ["request_id"], [F.col("bound").desc(), F.col("block")], SEEDS).select("request_id", "block")
    # SEEDS rows for each request of a block of requests: small enough to travel to the lists.
    seen = _ranked(_scores(_opened(hits, F.broadcast(seeds))), k).groupBy("request_id").agg(F.min("score").alias("bar"), F.count("*").alias("found"))
    bars = seen.where(F.col("found") == k).select("request_id", "bar")
    # The slack covers rounding; a block that could tie is still read.
    near = bounds.join(bars, "request_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 1e-9))
    return bounds, near.select("request_id", "block", "bound")


def _opened(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    chosen = hits.join(blocks.select("request_id", "block"), ["request_id", "block"], "left_semi")
    return chosen.select("request_id", "asked", F.explode("entries").alias("e")).select("request_id", "asked", "e.item_id", "e.n")


def from_index(index: DataFrame, asked: Asked, k: int, requests: int) -> DataFrame:
    """Scores of the items in the blocks that may hold one of the k best of a request.

    Lists of these blocks are opened once, whatever the number of requests, and
    dealt by the pairs they become, like the numbers of `from_texts`.  Up to
    NEAR pairs of a request and a block travel to the entries, so that a request
    skips blocks that only others need; more would cost more than they save.
    """
    spark, folder = index.sparkSession, new_folder(index.sparkSession)
    near = candidate_blocks(index, asked, k)[1].select("request_id", "block")
    near.write.parquet(folder)
    near = spark.read.schema(near.schema).parquet(folder)
    blocks = near.select("block").distinct()
    opened = asked.numbered(index.select("term", "block", "entries")).join(blocks, "block", "left_semi")
    entries = opened.select("number", "block", F.explode("entries").alias("e")).select("e.item_id", "number", "block", "e.n")
    dealt = entries.repartition(tasks_for(blocks.count() * PER_BLOCK, requests), "item_id")
    hits = dealt.join(asked.pairs.where("request_id IS NOT NULL"), "number")
    if near.count() <= NEAR:
        hits = hits.join(F.broadcast(near), ["request_id", "block"], "left_semi")
    return _scores(hits)


def search(
    items: DataFrame,
    requests: DataFrame,
    k: int,
    min_score: float | None = None,
    id_column: str = "doc_id",
    text: str = "text",
    carry: str | None = None,
    index: DataFrame | None = None,
    block_bytes: int = REQUEST_BYTES,
) -> DataFrame:
    """The k best items of each request: `request_id`, `item_id`, `score`, `rank`, and the column `carry` of the items.

    `requests` has (request_id, payload), the payload being distinct lower-case
    keywords.  Items without any keyword are no hits; ties go to the smaller id.
    `index` is a written index of exactly these items.
    """
    spark, kind = items.sparkSession, requests.schema["request_id"].dataType.simpleString()
    found, n_items = [], items.count() if index is None else 0
    for ids, payloads in request_blocks(requests, block_bytes):
        asked = Asked.of(spark, kind, ids, payloads)
        if index is None:
            scores = from_texts(items, asked, id_column, text, tasks_for(n_items, len(ids)))
        else:
            scores = from_index(index.where(F.col("folder").isin(asked.folders())), asked, k, len(ids))
        best = _ranked(scores, k)
        if min_score is not None:
            best = best.where(F.col("score") >= min_score)
        if carry:
            # k rows for each request of a block: small enough to travel to the items.
            texts = items.select(F.col(id_column).alias("item_id"), carry)
            best = texts.join(F.broadcast(best), "item_id").select("request_id", "item_id", "score", "rank", carry)
        found.append(best)
    return reduce(DataFrame.unionByName, found)
