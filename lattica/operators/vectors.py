"""Embedding, vector table maintenance and vector search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.access import DEFAULT_ACL, Principal, visible_to
from lattica.operators.scoring import cosine_kernel, top_matches
from lattica.session import SLICE_BYTES

# Vector length of the embedding models people configure by name.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-ada-002": 1536,
    "nomic-embed-text": 768,
    "mxbai-embed-large": 1024,
    "all-minilm": 384,
}


class Embedder(Protocol):
    """Turns texts into vectors; instances travel to the executors."""

    dimension: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic local embedder: signed word counts hashed to a fixed width.

    The first 32 bits of the word's MD5 choose the position (value modulo the
    width) and the sign (next bit), so SQL can recompute every vector.
    """

    _MEMO_LIMIT = 500_000

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self._memo: dict[str, int] = {}

    def _code(self, word: str) -> int:
        """Position and sign of a word as one number."""
        value = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        if len(self._memo) >= self._MEMO_LIMIT:
            self._memo.clear()
        code = self._memo[word] = value % (2 * self.dimension)
        return code

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        each = [(text or "").lower().split() for text in texts]
        words = [w for words in each for w in words]
        known = self._memo.get
        codes = np.fromiter((self._code(w) if (code := known(w)) is None else code for w in words), np.int64, len(words))
        rows = np.repeat(np.arange(len(each)), [len(words) for words in each])
        sign = 1.0 - 2.0 * (codes // self.dimension)
        sums = np.bincount(rows * self.dimension + codes % self.dimension, sign, len(each) * self.dimension)
        return sums.reshape(len(each), self.dimension).astype(np.float32)


def _parts(texts: list[str | None], size: int = SLICE_BYTES) -> Iterator[list[str | None]]:
    """Runs of texts that add up to about `size` characters; one text may be longer."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if i > first and held + length > size:
            yield texts[first:i]
            first, held = i, 0
        held += length
    if texts:
        yield texts[first:]


def embed(text: Column, embedder: Embedder) -> Column:
    """Vector of a text; one call of the embedder per Arrow batch, or several where the texts are long."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v for part in _parts(texts.tolist()) for v in embedder.embed_batch(part)])

    return run(text)


def embed_distinct(df: DataFrame, text: str, embedder: Embedder, vector: str = "vector") -> DataFrame:
    """Embed every distinct text once and join the vectors back.

    Copies collapse on the map side before the expensive call; any copy stands
    for the others, so texts need no ordering.
    """
    keyed = df.withColumn("_digest", F.sha2(F.col(text), 256))
    distinct = keyed.groupBy("_digest").agg(F.any_value(text).alias("_text"))
    vectors = distinct.select("_digest", embed(F.col("_text"), embedder).alias(vector))
    return keyed.join(vectors, "_digest").drop("_digest")


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two vector columns inside one row."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
        )

    return F.coalesce(F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))), F.lit(0.0))


def check_dimension(vectors: DataFrame, dimension: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(rows of the right length, rejected rows)."""
    fits = F.coalesce(F.size(vector) == dimension, F.lit(False))
    return vectors.filter(fits), vectors.filter(~fits)


def upsert(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Table after overwriting by key; unknown keys are added.

    Of several changes of one key the one with the largest values stays.
    """
    rest = [c for c in changes.columns if c != key]
    changes = changes.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*") if rest else changes.distinct()
    kept = current.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def delete_by_document(current: DataFrame, documents: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, number of rows removed per document)."""
    gone = documents.select(key).distinct()
    remaining = current.join(gone, key, "left_anti")
    removed = current.join(gone, key, "left_semi").groupBy(key).agg(F.count("*").alias("removed"))
    return remaining, removed


def search(
    vectors: DataFrame,
    requests: DataFrame,
    k: int = 20,
    principal: Principal | None = None,
    document_filter: DataFrame | None = None,
    min_score: float | None = None,
    id_column: str = "vec_id",
    vector: str = "embedding",
    document_id: str = "document_id",
    carry: str | None = None,
) -> DataFrame:
    """Exact cosine top-k per request vector.

    `requests` has (request_id, vector).  Access control and the document
    filter run below the top-k, so a user always gets the k best rows they may
    read rather than the readable part of somebody else's k best.
    """
    if document_filter is not None:
        vectors = vectors.join(document_filter.select(document_id).distinct(), document_id, "left_semi")
    if principal is not None:
        vectors = visible_to(vectors, principal, DEFAULT_ACL)
    return top_matches(
        vectors.select(F.col(id_column).alias("item_id"), F.col(vector).alias("payload"), *[c for c in [carry] if c]),
        requests.select("request_id", F.col("vector").alias("payload")),
        cosine_kernel(),
        k,
        min_score=min_score,
        carry=carry,
    )


def centroids(vectors: DataFrame, label: str, vector: str, dimension: int) -> DataFrame:
    """Mean vector per label: one aggregate per position, combined on the map side."""
    means = [F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(dimension)]
    grouped = vectors.groupBy(label).agg(*means)
    return grouped.select(label, F.array(*[F.col(f"_{i}") for i in range(dimension)]).alias("vector"))
