"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Statistics of a text (lengths, shares of kinds of characters, repetition) are
standardised and mapped by random cosines whose inner products approximate a
Gaussian kernel.  Tasks sum the normal equations of their rows per fold, the
driver adds these small matrices and solves for the weights.  Predictions for
each fold by the weights of the other folds are calibrated by isotonic
regression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import append_columns, free_name, texts_of
from lattica.llm.labelled import Isotonic, training_rows
from lattica.session import cut_lineage

TRAIN_ROWS = 20_000  # labelled rows the classifier is fitted on
FEATURES = 256  # random cosines
WIDTH = 1.0  # of the kernel, in units of the root of the number of statistics
RIDGE = 1e-3  # per training row
FOLDS = 4
SUMS = 8  # partial sums of the normal equations that reach the driver

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_HIGH = _BYTES >= 128
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, [44, 46, 59, 58])
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE | _STOP)
_KINDS = np.stack([_UPPER, _LOWER, _DIGIT, _HIGH, _SPACE, _STOP, _SYMBOL]).astype(float).T

STATISTICS = (
    "log_bytes log_words upper lower digit high space stop symbol entropy word_mean word_std word_max short_words "
    "distinct_words top_length distinct_triples log_lines distinct_lines words_per_line plain_words upper_words"
).split()


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a UTF-8 text; a null is an empty text."""
    text = text or b""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = (counts @ _KINDS) / n
    p = counts[counts > 0] / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    unique = set(words)
    # Share of the commonest word length: high where one word dominates.
    top = np.bincount(np.minimum(lengths, 64)).max() / m
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    plain = sum(map(bytes.isalnum, words)) / m
    upper = sum(map(bytes.isupper, words)) / m
    return [
        np.log1p(n), np.log1p(len(words)), *kinds.tolist(), float(-(p * np.log2(p)).sum()),
        float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), float((lengths <= 3).mean()),
        len(unique) / m, float(top), triples, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / max(1, len(lines))), plain, upper,
    ]


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    calibration: Isotonic

    def cosines(self, x: np.ndarray) -> np.ndarray:
        return _cosines(x, self.mean, self.scale, self.frequencies, self.phases)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return self.calibration(self.cosines(_matrix(texts)) @ self.weights)


def _cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ frequencies + phases) * np.sqrt(2 / len(phases))
    return np.hstack([z, np.ones((len(x), 1))])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        bound: int = TRAIN_ROWS, features: int = FEATURES, seed: int = 8) -> Model:
    """A model of label 1 from the labelled rows where `keep` holds.

    Without any such row every score is 0.5.
    """
    sample = training_rows(docs, labels, label, keep, bound, id_col, text_col)

    def describe(batches):
        for batch in batches:
            x = _matrix(texts_of(batch.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("_y"), batch.column("_fold")], names=["x", "y", "fold"]
            )

    folded = sample.withColumn("_fold", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int"))  # copies share a fold
    table = cut_lineage(folded.mapInArrow(describe, "x array<double>, y int, fold int"))
    moments = table.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("scale")).collect()
    d = len(STATISTICS)
    mean, scale = np.zeros(d), np.ones(d)
    for r in moments:
        mean[r.pos], scale[r.pos] = r.mean, max(r.scale or 0.0, 1e-6)
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, features))
    phases = rng.uniform(0, 2 * np.pi, features)

    def add_up(batches):
        sums = np.zeros((FOLDS, features + 2, features + 2))
        for batch in batches:
            z = _cosines(np.array(batch.column("x").to_pylist(), float).reshape(-1, d), mean, scale, frequencies, phases)
            z = np.hstack([z, batch.column("y").to_numpy()[:, None].astype(float)])
            fold = batch.column("fold").to_numpy()
            for k in range(FOLDS):
                rows = z[fold == k]
                sums[k] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    # At most SUMS rows of FOLDS * (features + 2)^2 doubles reach the driver.
    parts = table.coalesce(SUMS).mapInArrow(add_up, "sums binary").collect()
    sums = np.zeros((FOLDS, features + 2, features + 2))
    for part in parts:
        sums += np.frombuffer(part.sums).reshape(sums.shape)

    def solve(total: np.ndarray) -> np.ndarray:
        a, b = total[:-1, :-1], total[:-1, -1]
        return np.linalg.solve(a + np.eye(len(a)) * (RIDGE * max(a[-1, -1], 1.0)), b)

    by_fold = [solve(sums.sum(0) - sums[k]) for k in range(FOLDS)]

    def predict(batches):
        for batch in batches:
            z = _cosines(np.array(batch.column("x").to_pylist(), float).reshape(-1, d), mean, scale, frequencies, phases)
            fold = batch.column("fold").to_numpy()
            raw = (z * np.stack(by_fold)[fold]).sum(1) if len(fold) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], names=["raw", "y"])

    held = table.mapInArrow(predict, "raw double, y int").collect()  # about `bound` rows
    calibration = Isotonic(np.array([r.raw for r in held], float), np.array([r.y for r in held], float))
    return Model(mean, scale, frequencies, phases, solve(sums.sum(0)), calibration)


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """Documents and the name of a new column: the calibrated score of each text, 0 to 1.

    A null text is an empty text; an empty text has a score like any other.
    """
    name = free_name(docs, "_quality")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        return lambda batch: [pa.array(model.scores(texts_of(batch.column(text_col))), pa.float64())]

    return append_columns(docs, [T.StructField(name, T.DoubleType())], start), name


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Id, whether the row was held out, score and prediction of each document row."""
    model = fit(docs, labels, ~held_out, id_col=id_col, text_col=text_col, **options)
    out, score = with_score(docs.select(id_col, text_col), model, text_col)
    return out.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(score).alias("score"),
                      (F.col(score) >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that the classifier accepts (score of 0.5 or more)."""
    model = fit(docs, labels, ~held_out, text_col=text_col, **options)
    out, score = with_score(docs, model, text_col)
    return out.where(F.col(score) >= 0.5).select(*docs.columns)
