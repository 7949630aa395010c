"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import append_columns, free_name

TRAIN_ROWS = 5_000  # texts a language is learned from, chosen by hash
ORDERS = (1, 2, 3)  # lengths of the n-grams
BUCKETS = 1 << 15  # hashed n-grams
SMOOTHING = 0.5
MODEL_BYTES = 256 << 20  # largest log-probability matrix that is broadcast
SLICE = 1 << 20  # characters that are hashed at a time
UNDETERMINED = "und"

_GRID = 1 << 30
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def _hashes(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; `buckets` where it leaves its text (code 0)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, (order * 0x9E3779B9) & 0xFFFFFFFF, np.uint32)
    whole = np.ones(n, bool)
    for k in range(order):
        piece = codes[k : k + n]
        h = (h ^ piece) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        whole &= piece != 0
    return np.where(whole, h % np.uint32(buckets), np.uint32(buckets)).astype(np.int64)


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a 0 behind, and where each text starts."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\0".join([*lowered, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])


def has_letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log
    weights: np.ndarray  # log-probabilities, one row per language, and a last column of zeros
    orders: tuple[int, ...] = ORDERS

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text."""
        codes, starts = _codes(texts)
        sums = np.zeros((len(self.languages), len(texts)))
        buckets, reach = self.weights.shape[1] - 1, max(self.orders) - 1
        for at in range(0, len(codes), SLICE):
            end = min(at + SLICE, len(codes))
            first = int(np.searchsorted(starts, at, "right")) - 1
            last = int(np.searchsorted(starts, end, "left"))
            cuts = np.maximum(starts[first:last], at) - at
            for order in self.orders:
                h = _hashes(codes[at : end + order - 1], order, buckets)
                inside = cuts[cuts < len(h)]
                if not len(inside):
                    continue
                for row, weight in zip(sums, self.weights):
                    row[first : first + len(inside)] += np.add.reduceat(weight[h], inside, dtype=np.float64)
        names, scores = [], []
        if self.languages:
            log = sums + self.prior[:, None]
            best = log.argmax(0)
            posterior = 1 / np.exp(log - log.max(0)).sum(0)
        for i, text in enumerate(texts):
            known = bool(self.languages) and has_letters(text)
            names.append(self.languages[best[i]] if known else UNDETERMINED)
            scores.append(float(posterior[i]) if known else 0.0)
        return names, scores


def fit(docs: DataFrame, keep: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        bound: int = TRAIN_ROWS, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """A model of the languages of the rows where `keep` holds and the language is known.

    A language with more than about `bound` rows is learned from that many,
    chosen by a hash of id and language; its prior is the square root of its
    share of all rows, so that rare languages are not talked down.
    """
    known = docs.where(keep & F.col(lang_col).isNotNull())
    totals = {r.lang: r.n for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MODEL_BYTES // (4 * buckets) + 1).collect()}
    languages = sorted(totals)
    if len(languages) * buckets * 4 > MODEL_BYTES:
        raise ValueError(f"more than {MODEL_BYTES // (4 * buckets)} languages: use fewer buckets")
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, buckets + 1)), orders)
    limits = {k: ceil(_GRID * min(1.0, bound / n)) for k, n in totals.items()}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(lang_col)]
    sample = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), lang_col), F.lit(_GRID)) < limit)
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        sums = np.zeros((len(languages), buckets + 1), np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs = batch.column("lang").to_pylist()
            for name in set(langs):
                codes, _ = _codes([t for t, x in zip(texts, langs) if x == name])
                for at in range(0, len(codes), SLICE):
                    for order in orders:
                        h = _hashes(codes[at : min(at + SLICE, len(codes)) + order - 1], order, buckets)
                        sums[number[name]] += np.bincount(h, minlength=buckets + 1)
        row, bucket = np.nonzero(sums[:, :buckets])
        for at in range(0, len(row), 4096):
            r, b = row[at : at + 4096], bucket[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(sums[r, b])], names=["lang", "bucket", "n"])

    cells = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "lang int, bucket int, n long")
    # At most languages x buckets rows, within MODEL_BYTES.
    counts = np.zeros((len(languages), buckets))
    table = cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[table["lang"].to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy(float)
    smooth = counts + SMOOTHING
    weights = np.log(smooth / smooth.sum(1, keepdims=True))
    share = np.array([totals[k] for k in languages], float)
    return Model(languages, 0.5 * np.log(share / share.sum()), np.hstack([weights, np.zeros((len(languages), 1))]).astype(np.float32), orders)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Documents and the names of two new columns: language and its posterior.

    A text that is null or has no letter is `und` with score 0, and so is every
    text if nothing was learned.  Ties go to the first language in order.
    """
    cols = {k: free_name(docs, f"_{k}") for k in ("lang_pred", "score")}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def step(batch):
            names, scores = model.predict(batch.column(text_col).cast(pa.string()).to_pylist())
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return step

    return append_columns(docs, [T.StructField(cols["lang_pred"], T.StringType()), T.StructField(cols["score"], T.DoubleType())], start), cols


def identified(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Id, whether the row was held out, predicted language and score of each document row."""
    model = fit(docs, ~held_out, lang_col, text_col, id_col, **options)
    out, c = with_language(docs.select(id_col, text_col), model, text_col)
    return out.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(c["lang_pred"]).alias("lang_pred"), F.col(c["score"]).alias("score"))
