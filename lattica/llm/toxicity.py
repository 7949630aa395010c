"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

All words of a bounded sample of labelled examples span the vector space; their
document frequencies come from all documents.  A word's weight is its IDF times
a smooth measure of how it goes with the label, so no word is left out and no
word of the label drowns in a long text.

Examples lie in an inverted index in blocks of `BLOCK`.  Rare words have plain
postings.  Frequent words have postings for every block, with the largest weight
of each word in each block; a query's weights times these maxima bound every
cosine in a block.  Blocks are opened by their bounds until those left lie below
the k-th best cosine, so the neighbours are exact.  Votes weighted by distance
are calibrated by isotonic regression on leave-one-out votes of the examples.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import append_columns, free_name, texts_of
from lattica.llm.decontaminate import words_of
from lattica.llm.labelled import Isotonic, training_rows

TRAIN_ROWS = 4_000  # labelled rows the classifier is fitted on; each may be an example of the index
TRAIN_BYTES = 32 << 20  # and the most bytes that their texts have together
PLAIN, ASSOCIATED = 0.05, 20.0  # weight of a word without association, and chi-squared of half the full weight
NEIGHBOURS = 16
BLOCK = 64  # examples per block of the index
FREQUENT, MOST_FREQUENT = 0.02, 1024  # share of examples that makes a word frequent, and how many may be
TOGETHER = 256  # texts that are looked up at once
EVIDENCE = 3  # neighbours that are reported


def label_weights(ones: np.ndarray, zeros: np.ndarray, n_ones: float, n_zeros: float) -> np.ndarray:
    """Weight of each word by its chi-squared with the label; `ones` and `zeros` count examples that have it."""
    total = n_ones + n_zeros
    gap = ones * (n_zeros - zeros) - zeros * (n_ones - ones)
    spread = (ones + zeros) * (total - ones - zeros) * n_ones * n_zeros
    chi = total * gap * gap / np.maximum(spread, 1.0)
    return PLAIN + (chi / (chi + ASSOCIATED)) ** 2


Vector = tuple[np.ndarray, np.ndarray]  # terms, ascending, and weights


def vector_of(words: list[bytes], place: dict[bytes, int], weight: np.ndarray) -> Vector:
    """Terms and weights of unit length of a text; empty without a term."""
    counts = Counter(i for i in map(place.get, words) if i is not None)
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    terms = np.array(sorted(counts), np.int64)
    weights = (1 + np.log([counts[t] for t in terms.tolist()])) * weight[terms]
    return terms, weights / np.linalg.norm(weights)


class BlockMaxIndex:
    """Postings of unit vectors: plain ones of rare terms, blocks with maxima of frequent ones."""

    def __init__(self, vectors: list[Vector], terms: int, block: int = BLOCK):
        self.size, self.block = len(vectors), block
        self.blocks = -(-len(vectors) // block)
        owner = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        found = np.bincount(term, minlength=terms)
        frequent = np.argsort(-found, kind="stable")[:MOST_FREQUENT]
        frequent = np.sort(frequent[found[frequent] >= max(2, FREQUENT * len(vectors))])
        self.column = np.full(terms, -1, np.int64)
        self.column[frequent] = np.arange(len(frequent))
        dense = self.column[term] >= 0
        # Vectors of a block are rows that lie together.
        self.dense = np.zeros((self.blocks * block, len(frequent)))
        self.dense[owner[dense], self.column[term[dense]]] = weight[dense]
        self.most = self.dense.reshape(self.blocks, block, len(frequent)).max(1) if self.blocks else np.zeros((0, len(frequent)))
        order = np.argsort(term[~dense], kind="stable")
        self.owners, self.weights = owner[~dense][order], weight[~dense][order]
        self.starts = np.searchsorted(term[~dense][order], np.arange(terms + 1))
        self.opened = self.asked = 0  # blocks, to tell what is spared

    def _rare(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """What rare terms add to the cosine of each query with each example."""
        lengths = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        width = self.blocks * self.block
        flat = np.repeat(row, lengths) * width + self.owners[at]
        return np.bincount(flat, np.repeat(weight, lengths) * self.weights[at], rows * width).reshape(rows, width)

    def nearest(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k examples of largest positive cosine, ties to the smaller number, as (cosine, number)."""
        rows = len(queries)
        if not rows or not self.size:
            return [[] for _ in queries]
        row = np.repeat(np.arange(rows), [len(t) for t, _ in queries])
        term, weight = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        column = self.column[term]
        head = np.zeros((rows, self.dense.shape[1]))
        head[row[column >= 0], column[column >= 0]] = weight[column >= 0]
        rare = self._rare(row[column < 0], term[column < 0], weight[column < 0], rows)
        bounds = head @ self.most.T + rare.reshape(rows, self.blocks, self.block).max(2)
        scores = np.full((rows, self.blocks * self.block), -1.0)
        todo = np.zeros_like(bounds, bool)
        first = np.argsort(-bounds, axis=1, kind="stable")[:, : 1 + -(-k // self.block)]
        np.put_along_axis(todo, first, True, axis=1)
        done = bounds <= 0
        kth = min(k, scores.shape[1])
        for further in (4, self.blocks):  # a few blocks more lift the bar before the rest is judged
            self._open(todo & ~done, head, rare, scores, without)
            done |= todo
            bar = np.maximum(-np.partition(-scores, kth - 1, axis=1)[:, kth - 1], 0.0)
            # The slack covers rounding; a block that could tie is still opened.
            wanted = ~done & (bounds >= bar[:, None] - 1e-9)
            ranked = np.argsort(np.where(wanted, -bounds, 1.0), axis=1, kind="stable")[:, :further]
            todo = np.zeros_like(todo)
            np.put_along_axis(todo, ranked, True, axis=1)
            todo &= wanted
        self._open(todo & ~done, head, rare, scores, without)
        self.asked += bounds.size
        # Rounded, so that equal vectors tie whatever the order of their sums.
        scores = np.round(scores, 12)
        bar = -np.partition(-scores, kth - 1, axis=1)[:, kth - 1]
        out = []
        for line, least in zip(scores, bar):
            at = np.flatnonzero((line >= least) & (line > 0))
            at = at[np.lexsort((at, -line[at]))][:k]
            out.append(list(zip(line[at].tolist(), at.tolist())))
        return out

    def _open(self, todo: np.ndarray, head: np.ndarray, rare: np.ndarray, scores: np.ndarray, without: list[int] | None) -> None:
        self.opened += int(todo.sum())
        for b in np.flatnonzero(todo.any(0)).tolist():
            rows, part = np.flatnonzero(todo[:, b]), slice(b * self.block, (b + 1) * self.block)
            scores[rows, part] = head[rows] @ self.dense[part].T + rare[rows, part]
        if without is not None:
            scores[np.arange(len(without)), without] = -1.0


@dataclass
class Model:
    place: dict[bytes, int]
    weight: np.ndarray
    index: BlockMaxIndex
    ids: list
    labels: np.ndarray
    calibration: Isotonic
    k: int = NEIGHBOURS

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, by closeness; -1 without neighbours."""
        if not near:
            return -1.0
        weights = np.array([1 / (1.05 - min(s, 1.0)) for s, _ in near])
        return float(weights @ self.labels[[i for _, i in near]] / weights.sum())

    def neighbours(self, texts: list[bytes | None]) -> list[list[tuple[float, int]]]:
        vectors = [vector_of(words_of(t), self.place, self.weight) for t in texts]
        return [near for at in range(0, len(vectors), TOGETHER) for near in self.index.nearest(vectors[at : at + TOGETHER], self.k)]


def _frequencies(docs: DataFrame, text_col: str, place: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and the number of documents."""
    size, shared = len(place), docs.sparkSession.sparkContext.broadcast(place)

    def count(batches):
        place, sums = shared.value, np.zeros(size + 1, np.int64)
        for batch in batches:
            sums[size] += batch.num_rows
            at = [place[w] for text in texts_of(batch.column("text")) for w in place.keys() & set(words_of(text))]
            sums[:size] += np.bincount(np.array(at, np.int64), minlength=size)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["term", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 1, np.int64)
    counts[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return counts[:size], int(counts[size])


def examples_of(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, most_bytes: int, id_col: str, text_col: str) -> list:
    """The labelled rows to learn from, at most about `bound` rows and `most_bytes` of text.

    Copies of a text with one label are one example, so that a large group of
    copies has one vote.
    """
    sample = training_rows(docs, labels, label, keep, bound, id_col, text_col)
    # The copy of smallest id stands for all, and its text is fetched once.
    key = F.sha2(F.col("_text").cast("binary"), 256).alias("_hash")
    distinct = sample.groupBy(key, "_y").agg(F.min("_id").alias("_id"), F.min("_text").alias("_text"))
    size = distinct.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    if size > most_bytes:
        distinct = distinct.where(F.pmod(F.xxhash64("_hash"), F.lit(1 << 30)) < int((1 << 30) * most_bytes / size))
    return sorted(distinct.select("_id", "_text", "_y").collect(), key=lambda r: (r._id, r._y, r._text))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        bound: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, k: int = NEIGHBOURS) -> Model:
    """An index of labelled examples from the rows where `keep` holds.

    Without a labelled row every score is 0.5; texts that share no word with any
    example get the rate of the examples with the lowest votes.
    """
    rows = examples_of(docs, labels, label, keep, bound, most_bytes, id_col, text_col)
    words = [words_of(r._text.encode()) for r in rows]
    place = {t: i for i, t in enumerate(sorted({w for ws in words for w in ws}))}
    df, n = _frequencies(docs, text_col, place)
    y = np.array([r._y for r in rows], float)
    has = [np.array([place[w] for w in set(ws)], np.int64) for ws in words]
    counts = [np.bincount(np.concatenate([h for h, v in zip(has, y) if v == wanted] or [np.zeros(0, np.int64)]), minlength=len(place)) for wanted in (1, 0)]
    idf = np.log((1 + n) / (1 + np.minimum(df, n))) + 1e-3  # a word of all documents still counts
    weight = idf * label_weights(counts[0].astype(float), counts[1].astype(float), y.sum(), len(y) - y.sum())
    vectors = [vector_of(ws, place, weight) for ws in words]
    # Like examples share blocks, so that bounds are tight: by their terms in most documents.
    common = np.argsort(-df, kind="stable").argsort()
    order = sorted(range(len(rows)), key=lambda i: (np.sort(common[vectors[i][0]])[:8].tolist(), i))
    vectors, y = [vectors[i] for i in order], y[order]
    model = Model(place, weight, BlockMaxIndex(vectors, len(place)), [rows[i]._id for i in order], y, Isotonic(np.zeros(0), np.zeros(0)), k)
    votes = []
    for at in range(0, len(vectors), TOGETHER):
        some = vectors[at : at + TOGETHER]
        votes += [model.vote(near) for near in model.index.nearest(some, k, list(range(at, at + len(some))))]
    model.calibration = Isotonic(np.array(votes), y)
    return model


def with_score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Documents and the names of new columns: score (0 to 1), and the ids and cosines of the closest examples.

    Ids of examples have the type of `id_col`.
    """
    cols = {k: free_name(docs, f"_{k}") for k in ("score", "evidence", "cosines")}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(docs.schema[id_col].dataType)

    def start():
        model = shared.value

        def step(batch):
            found = model.neighbours(texts_of(batch.column(text_col)))
            scores = model.calibration(np.array([model.vote(near) for near in found], float))
            return [
                pa.array(scores, pa.float64()),
                pa.array([[model.ids[i] for _, i in near[:EVIDENCE]] for near in found], pa.list_(batch.schema.field(id_col).type)),
                pa.array([[s for s, _ in near[:EVIDENCE]] for near in found], pa.list_(pa.float64())),
            ]

        return step

    fields = [T.StructField(cols["score"], T.DoubleType()), T.StructField(cols["evidence"], kind), T.StructField(cols["cosines"], T.ArrayType(T.DoubleType()))]
    return append_columns(docs, fields, start), cols


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Id, whether the row was held out, score, prediction and evidence of each document row.

    A null text is an empty text; it shares no word with any example.  Repeated
    rows are scored alike, each a row of its own; examples of one cosine are
    listed by their place in the index.  An empty table has no rows.
    """
    model = fit(docs, labels, ~held_out, id_col=id_col, text_col=text_col, **options)
    out, c = with_score(docs.select(id_col, text_col), model, id_col, text_col)
    return out.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(c["score"]).alias("score"),
                      (F.col(c["score"]) >= 0.5).cast("int").alias("predicted"), F.col(c["evidence"]).alias("evidence"), F.col(c["cosines"]).alias("cosines"))
