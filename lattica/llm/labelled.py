"""Bounded samples of labelled rows and isotonic calibration, shared by the classifiers."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRID = 1 << 30


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """About `bound` labelled rows as (`_id`, `_text`, `_y`), chosen by a hash of id and label.

    Only rows of `labels` where `keep` holds and the label is 0 or 1 are used.
    The chosen labels are at most about `bound` rows, so they are broadcast and
    no text is shuffled.  A document labelled twice counts twice.
    """
    usable = labels.where(keep & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
    total = usable.count()
    if total > bound:
        usable = usable.where(F.pmod(F.xxhash64("_id", "_y"), F.lit(_GRID)) < ceil(_GRID * bound / total))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(usable), "_id")


class Isotonic:
    """Monotone map from raw scores to rates, by pooling adjacent violators."""

    def __init__(self, raw: np.ndarray, y: np.ndarray):
        if not len(raw):
            self.x, self.p = np.array([0.0]), np.array([0.5])
            return
        order = np.argsort(raw, kind="stable")
        xs, starts = np.unique(raw[order], return_index=True)
        counts = np.diff(np.append(starts, len(order))).astype(float)
        rates = np.add.reduceat(y[order].astype(float), starts) / counts
        blocks: list[list[float]] = []  # weight, rate, first and last raw score
        for x, n, r in zip(xs, counts, rates):
            blocks.append([n, r, x, x])
            while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
                n2, r2, _, last = blocks.pop()
                n1, r1, first, _ = blocks.pop()
                blocks.append([n1 + n2, (n1 * r1 + n2 * r2) / (n1 + n2), first, last])
        # A rate of a small block is drawn towards the overall rate.
        mean = float(y.mean())
        rate = [(n * r + mean) / (n + 1) for n, r, _, _ in blocks]
        rate = np.maximum.accumulate(rate)
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.p = np.repeat(rate, 2)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """Rates between blocks are interpolated; the raw score parts ties by under 1e-4."""
        low, high = self.x[0], max(self.x[-1], self.x[0] + 1e-9)
        place = np.clip((raw - low) / (high - low), 0, 1)
        return np.clip(np.interp(raw, self.x, self.p) * (1 - 1e-4) + 1e-4 * place, 0.0, 1.0)
