"""Quality rules: fixed text statistics, then a hashed n-gram logistic regression.

The regression sees hashed word n-grams (one and two words) and character trigrams, each family
as its mean weight, so a text of any length gets one pass. It is trained on a bounded
sample of labelled rows, calibrated on rows that it was not trained on, and scored in
Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import bound_arrow_batches
from firegrid.llm.hashing import mix, shingle_hashes, word_hashes
from firegrid.llm.sampling import labelled_sample

BUCKET_BITS = 17
FAMILIES = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text stays if the calibrated probability of good quality is at least this.
KEEP_THRESHOLD = 0.5
#: Labelled rows of each class that the regression is fitted on at most.
SAMPLE_PER_CLASS = 1500
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[0x20, *range(0x09, 0x0E)]] = True


def feature_cells(raw: bytes, words: np.ndarray) -> list[np.ndarray]:
    """The bucket of every word, word pair and character trigram (code points) of a text."""
    shift = np.uint64(64 - BUCKET_BITS)
    pairs = words[:0]
    if len(words) > 1:
        pairs = mix(words[1:] * np.uint64(3) + words[:-1])
        pairs[words[1:] == words[:-1]] = 0
    c = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    grams = c[:0]
    if len(c) > 2:
        mixed = ((c[:-2] * np.uint32(0x01000193)) ^ c[1:-1]) * np.uint32(0x01000193) ^ c[2:]
        grams = (mixed * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return [(words >> shift).astype(np.int64), (pairs >> shift).astype(np.int64), grams.astype(np.int64)]


@dataclass
class QualityModel:
    weights: np.ndarray  # FAMILIES x buckets
    bias: float
    slope: float  # of the calibration
    offset: float

    def margin(self, raw: bytes, words: np.ndarray) -> float:
        return self.bias + sum(float(self.weights[k][cells].mean()) for k, cells in enumerate(feature_cells(raw, words)) if len(cells))

    def probability(self, raw: bytes, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(raw, words) + self.offset, -40, 40))))


def statistics(raw: bytes, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b = np.frombuffer(raw, np.uint8)
    chars = int(np.count_nonzero(~_OUTSIDE[b] & ((b & 0xC0) != 0x80)))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeated = 0
    if len(words) > 3:
        windows = shingle_hashes(words, 3)
        _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
        found = count[inverse] > 1
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[j : j + len(found)] |= found
        repeated = int(np.count_nonzero(covered))
    return len(words), chars, int(np.count_nonzero(_SYMBOLS[b])), len(lines) - len(set(lines)), repeated


def _sparse(batches):
    """Each text's buckets with their shares, one row a text."""
    for batch in batches:
        cells, shares = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            raw = text or b""
            own, weight = [], []
            for k, found in enumerate(feature_cells(raw, word_hashes(raw))):
                if len(found):
                    at, n = np.unique(found, return_counts=True)
                    own.append((at + (k << BUCKET_BITS)).astype(np.int32))
                    weight.append((n / len(found)).astype(np.float32))
            cells.append(np.concatenate(own).tobytes() if own else b"")
            shares.append(np.concatenate(weight).tobytes() if own else b"")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(cells, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "label", "cells", "shares"]
        )


def _fit_logistic(rows, cells, shares, y, weight, rounds=150, rate=2.0, decay=1e-4):
    """Weighted logistic regression on a sparse matrix by Adagrad over the whole sample."""
    size, n = FAMILIES << BUCKET_BITS, len(y)
    w, bias = np.zeros(size), 0.0
    sums, bias_sum = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cells] * shares, n) + bias, -40, 40)))
        slip = (p - y) * weight
        g = np.bincount(cells, slip[rows] * shares, size) + decay * w / n
        sums += g * g
        w -= rate * g / np.sqrt(sums)
        bias_sum += slip.sum() ** 2
        bias -= 0.3 * slip.sum() / np.sqrt(bias_sum)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel | None:
    """Train on at most `per_class` labelled rows of each class; None unless both classes occur.

    A quarter of the sample is kept for calibration, weighted so that the classes have
    their shares among all labels.
    """
    bound_arrow_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, "quality", per_class)
    got = sample.mapInArrow(_sparse, "doc_id long, label int, cells binary, shares binary").toPandas().sort_values(["doc_id", "cells"], ignore_index=True)
    y = got["label"].to_numpy(float)
    held = np.arange(len(y)) % 4 == 3
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        return None
    cells = [np.frombuffer(x, np.int32) for x in got["cells"]]
    shares = [np.frombuffer(x, np.float32) for x in got["shares"]]

    def matrix(which):
        at = np.flatnonzero(which)
        return np.repeat(np.arange(len(at)), [len(cells[i]) for i in at]), np.concatenate([cells[i] for i in at]), np.concatenate([shares[i] for i in at])

    rows, c, s = matrix(~held)
    own = y[~held]
    balanced = np.where(own == 1, 0.5 / max(1, own.sum()), 0.5 / max(1, (1 - own).sum()))
    w, bias = _fit_logistic(rows, c, s, own, balanced)
    rows, c, s = matrix(held)
    margins, own = np.bincount(rows, w[c] * s, held.sum()) + bias, y[held]
    prior = {k: counts[k] / sum(counts.values()) for k in (0, 1)}
    weight = np.where(own == 1, prior[1] / own.sum(), prior[0] / (1 - own).sum())
    slope, offset = 1.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -40, 40)))
        slip = (p - own) * weight
        slope, offset = slope - 0.5 * ((slip * margins).sum() + 1e-3 * (slope - 1)), offset - 0.5 * slip.sum()
    return QualityModel(w.reshape(FAMILIES, -1).astype(np.float32), float(bias), float(max(slope, 1e-3)), float(offset))


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_THRESHOLD, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, the text statistics, base_failed, probability and kept for every row of `docs`.

    Null texts count as empty and fail the base rules. Every row gets a row, repeated rows
    and null ids included; other columns are ignored. Without both classes among the labels
    there is no model: probability is null and the base rules decide alone.
    """
    model = fit(docs, labels, per_class)

    def score(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                raw = text or b""
                words = word_hashes(raw)
                rows.append((*statistics(raw, words), model.probability(raw, words) if model else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns[:5]), pa.array(columns[5], pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"],
            )

    scored = docs.select("doc_id", "text").mapInArrow(
        score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("probability") >= threshold, F.lit(True)))
