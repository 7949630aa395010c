"""Exact top-k matching of a batch of requests against a large item table.

Requests are few (a batch of questions), items are many.  The items are scanned
once where they lie: each task scores an Arrow batch of items against the whole
request batch as one matrix and keeps only the k best items per request, so at
most ``requests * k`` rows per task reach the shuffle.  No item is sent
anywhere and no pair is materialised.

Requests are taken in blocks of at most REQUEST_BYTES, so that what travels to
the tasks and what a task holds is bounded; every block is one more pass over
the items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.topk import top_k_per_group

# Size of the requests that are scored together.
REQUEST_BYTES = 4 << 20
# Digits of a score that decide a rank; further ones depend on the order of adding.
RANK_DIGITS = 12

NO_MATCH = -np.inf

# kernel(list of request payloads) -> scorer(list of item payloads) -> matrix items x requests
Scorer = Callable[[object], np.ndarray]
Kernel = Callable[[list], Scorer]


class _Best:
    """Running k best (score desc, id asc) per request."""

    def __init__(self, k: int, requests: int):
        self.k = k
        self.floor = np.full(requests, NO_MATCH)
        self.request = np.empty(0, dtype=np.int64)
        self.item = None
        self.score = np.empty(0, dtype=np.float64)
        self.row = np.empty(0, dtype=np.int64)  # number of the item among all that were added
        self.added = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        first, self.added = self.added, self.added + len(ids)
        floor = self.floor
        if len(ids) > self.k:
            kth = np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
            floor = np.maximum(floor, kth)
        rows, cols = np.nonzero((scores >= floor) & (scores > NO_MATCH))
        self.request = np.concatenate([self.request, cols])
        self.item = ids[rows] if self.item is None else np.concatenate([self.item, ids[rows]])
        self.score = np.concatenate([self.score, scores[rows, cols]])
        self.row = np.concatenate([self.row, rows + first])
        self._trim()

    def _trim(self) -> None:
        order = np.lexsort((self.item, -self.score, self.request))
        request = self.request[order]
        starts = np.searchsorted(request, request, side="left")
        rank = np.arange(len(request)) - starts
        kept = rank < self.k
        order = order[kept]
        self.request, self.item, self.score, self.row = self.request[order], self.item[order], self.score[order], self.row[order]
        last = rank[kept] == self.k - 1
        self.floor[self.request[last]] = self.score[last]


def _ids(values) -> np.ndarray:
    array = np.asarray(values)
    return array.astype(str) if array.dtype == object else array


def top_matches(
    items: DataFrame,
    requests: DataFrame,
    kernel: Kernel,
    k: int,
    min_score: float | None = None,
    carry: str | None = None,
    block_bytes: int = REQUEST_BYTES,
) -> DataFrame:
    """k best items per request.

    `items` has the columns (item_id, payload), `requests` (request_id,
    payload).  The result is (request_id, item_id, score, rank), ordered by
    score descending and item id ascending within a request, and the column
    `carry` of the items, which only winners take along.
    """
    fields = [requests.schema["request_id"], items.schema["item_id"], T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + [items.schema[c] for c in [carry] if c])
    found = None
    for ids, payloads in request_blocks(requests, block_bytes):
        part = _scan(items, ids, payloads, kernel, k, schema)
        found = part if found is None else found.unionByName(part)
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    return top_k_per_group(found, ["request_id"], [F.col("score").desc(), F.col("item_id")], k)


def request_blocks(requests: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, payloads) of requests that add up to about `block_bytes`; one empty block without requests."""
    ids, payloads, size, any_yet = [], [], 0, False
    for r in requests.select("request_id", "payload").toLocalIterator():
        ids.append(r.request_id)
        payloads.append(r.payload)
        size += 64 + sum(8 if isinstance(x, float) else len(str(x)) for x in (r.payload or ()))
        if size >= block_bytes:
            yield ids, payloads
            ids, payloads, size, any_yet = [], [], 0, True
    if ids or not any_yet:
        yield ids, payloads


def _scan(items: DataFrame, request_ids: list, payloads: list, kernel: Kernel, k: int, schema: T.StructType) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast(payloads)
    carried = schema.names[3:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not request_ids:
            return
        scorer = kernel(shared.value)
        best, kept, kinds = _Best(k, len(request_ids)), {}, []
        for batch in batches:
            if batch.num_rows:
                kinds = [batch.schema.field(c).type for c in carried]
                first = best.added
                best.add(_ids(batch.column("item_id").to_numpy(zero_copy_only=False)), scorer(batch.column("payload")))
                if carried:
                    column = batch.column(carried[0])
                    kept = {i: kept[i] if i < first else column[i - first].as_py() for i in np.unique(best.row).tolist()}
        if len(best.score):
            columns = [pa.array([request_ids[i] for i in best.request]), pa.array(best.item), pa.array(best.score)]
            columns += [pa.array([kept[i] for i in best.row.tolist()], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return items.select("item_id", "payload", *carried).mapInArrow(score, schema)


# --- kernels -----------------------------------------------------------------


def _matrix(vectors, width: int | None = None) -> np.ndarray:
    if isinstance(vectors, (pa.Array, pa.ChunkedArray)):
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(vectors), -1).astype(np.float64)
    return np.asarray(vectors, dtype=np.float64)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def cosine_kernel(digits: int = RANK_DIGITS) -> Kernel:
    """Cosine similarity; an all-zero vector scores 0."""

    def prepare(payloads: list) -> Scorer:
        requests = _unit(_matrix(payloads)).T

        def score(payload) -> np.ndarray:
            # adding 0.0 turns -0.0 into 0.0
            return np.round(_unit(_matrix(payload)) @ requests, digits) + 0.0

        return score

    return prepare


def containment_kernel() -> Kernel:
    """How many of the request's keywords occur in the item as substrings, case kept."""

    def prepare(payloads: list) -> Scorer:
        wanted: dict[str, list[int]] = {}
        for i, terms in enumerate(payloads):
            for term in set(terms):
                wanted.setdefault(term, []).append(i)
        columns = {term: np.asarray(found) for term, found in wanted.items()}
        occurring = _term_finder(list(columns))

        def score(payload) -> np.ndarray:
            result = np.zeros((len(payload), len(payloads)))
            for row, text in enumerate(payload.to_pylist()):
                for term in occurring(text or ""):
                    result[row, columns[term]] += 1
            result[result <= 0] = NO_MATCH
            return result

        return score

    return prepare


def _term_finder(terms: list[str]) -> Callable[[str], set[str]]:
    """Function giving the terms that occur in a text, all looked for in one pass over it."""
    from ahocorasick import Automaton

    automaton = Automaton()
    for term in filter(None, terms):
        automaton.add_word(term, term)
    if not len(automaton):
        return lambda text: set()
    automaton.make_automaton()
    return lambda text: {term for _, term in automaton.iter(text)}
