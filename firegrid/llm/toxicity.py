"""Toxicity: a convolutional text classifier in numpy.

Words (runs of letters and digits, A-Z lower-cased) get the sum of two hashed embeddings;
filters of several widths slide over the whole text and each keeps its largest value; a
logistic layer makes the score. Gradients only reach the words at the largest values, so a
step costs little more than the forward pass. Scores are calibrated, and a threshold for
each language, as recognised from the text's own words, is mapped to 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import bound_arrow_batches
from firegrid.llm.hashing import NON_ALNUM, word_hashes
from firegrid.llm.sampling import labelled_sample

TABLE_BITS = 18
WIDTH = 8
FILTER_WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows of each class that the classifier is fitted on at most.
SAMPLE_PER_CLASS = 2000
EPOCHS = 8
#: Common words that tell the languages apart (fixed values).
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with"),
    "de": ("der", "die", "und", "das", "den", "sich", "mit", "ist", "nicht", "ein", "eine"),
    "fr": ("le", "la", "les", "et", "des", "une", "est", "dans", "pour", "que", "du"),
    "es": ("el", "los", "las", "que", "con", "del", "por", "una", "se", "su", "para"),
}
LANGUAGES = (*COMMON_WORDS, "other")


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(word_hashes(w.encode())[0]), 1 << k) for k, words in enumerate(COMMON_WORDS.values()) for w in words)
    merged: dict[int, int] = {}
    for h, bit in pairs:
        merged[h] = merged.get(h, 0) | bit
    return np.array([*merged], np.uint64), np.array([*merged.values()])


_KEYS, _BITS = _lookup()


def language_of(words: np.ndarray) -> int:
    """The number in LANGUAGES of the language whose common words are most frequent."""
    if not len(words):
        return len(LANGUAGES) - 1
    at = np.minimum(np.searchsorted(_KEYS, words), len(_KEYS) - 1)
    bits = _BITS[at[_KEYS[at] == words]]
    votes = [int(np.count_nonzero(bits & (1 << k))) for k in range(len(COMMON_WORDS))]
    return int(np.argmax(votes)) if max(votes) else len(LANGUAGES) - 1


def word_cells(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two table rows for every word."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    return (words & mask).astype(np.int64), ((words >> np.uint64(32)) & mask).astype(np.int64)


@dataclass
class ToxicityModel:
    tables: np.ndarray  # 2 x rows x WIDTH
    kernels: list  # for each filter width: width x WIDTH x FILTERS
    biases: list
    out: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    cuts: np.ndarray | None = None  # by language: the margin that is mapped to a score of 0.5

    def pooled(self, cells: tuple[np.ndarray, np.ndarray]):
        """Largest values by filter, their positions, and the embedded words."""
        e = self.tables[0][cells[0]] + self.tables[1][cells[1]]
        pad = max(FILTER_WIDTHS) - len(e)
        if pad > 0:
            e = np.concatenate([e, np.zeros((pad, WIDTH), np.float32)])
        values, places = [], []
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            n = len(e) - len(kernel) + 1
            c = e[:n] @ kernel[0]
            for j in range(1, len(kernel)):
                c += e[j : j + n] @ kernel[j]
            at = c.argmax(axis=0)
            values.append(np.maximum(c[at, np.arange(FILTERS)] + bias, 0))
            places.append(at)
        return np.concatenate(values), places, e

    def margin(self, words: np.ndarray) -> float:
        return float(self.pooled(word_cells(words))[0] @ self.out + self.bias)

    def score(self, words: np.ndarray) -> float:
        x = self.slope * self.margin(words) + self.offset
        if self.cuts is not None:
            x -= self.cuts[language_of(words)]
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _new_model(rng) -> ToxicityModel:
    make = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    return ToxicityModel(
        0.02 * make(2, 1 << TABLE_BITS, WIDTH), [make(w, WIDTH, FILTERS) / np.sqrt(w * WIDTH) for w in FILTER_WIDTHS], [np.zeros(FILTERS, np.float32) for _ in FILTER_WIDTHS],
        0.3 * make(FILTERS * len(FILTER_WIDTHS)), 0.0,
    )


def _train(model: ToxicityModel, texts: list[np.ndarray], y: np.ndarray, rng, epochs: int, rate: float = 0.1) -> None:
    """Adagrad, one text a step; only the words at the largest values move."""
    cells = [word_cells(w) for w in texts]
    floor = 1e-2
    table_sum = np.full((2, 1 << TABLE_BITS), floor, np.float32)
    kernel_sum, bias_sum = [np.full_like(k, floor) for k in model.kernels], [np.full_like(b, floor) for b in model.biases]
    out_sum, last_sum = np.full_like(model.out, floor), floor
    share = y.mean()
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            values, places, e = model.pooled(cells[i])
            p = 1 / (1 + np.exp(-np.clip(values @ model.out + model.bias, -30, 30)))
            slip = (p - y[i]) * (0.5 / share if y[i] else 0.5 / (1 - share))
            back = np.where(values > 0, slip * model.out, 0).astype(np.float32).reshape(len(FILTER_WIDTHS), FILTERS)
            g = slip * values
            out_sum += g * g
            model.out -= rate * g / np.sqrt(out_sum)
            last_sum += slip * slip
            model.bias -= rate * slip / np.sqrt(last_sum)
            n = len(cells[i][0])
            for k, (kernel, at) in enumerate(zip(model.kernels, places, strict=True)):
                d = back[k]
                if not d.any():
                    continue
                bias_sum[k] += d * d
                model.biases[k] -= rate * d / np.sqrt(bias_sum[k])
                for j in range(len(kernel)):
                    where = at + j
                    to_word = (kernel[j] * d).T  # FILTERS x WIDTH
                    gk = e[where].T * d
                    kernel_sum[k][j] += gk * gk
                    kernel[j] -= rate * gk / np.sqrt(kernel_sum[k][j])
                    inside = (where < n) & (d != 0)
                    for t in (0, 1):
                        rows = cells[i][t][where[inside]]
                        gw = to_word[inside]
                        np.add.at(table_sum[t], rows, (gw * gw).mean(axis=1))
                        np.subtract.at(model.tables[t], rows, rate * gw / np.sqrt(table_sum[t][rows])[:, None])


def _calibrate(model: ToxicityModel, texts: list[np.ndarray], y: np.ndarray, prior: float) -> None:
    """Fit slope and offset, then for each language the cut with the fewest weighted errors."""
    margins = np.array([model.margin(w) for w in texts])
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum())
    slope, offset = 1.0, 0.0
    for _ in range(400):
        slip = (1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30))) - y) * weight
        slope, offset = slope - 0.5 * ((slip * margins).sum() + 1e-3 * (slope - 1)), offset - 0.5 * slip.sum()
    model.slope, model.offset = float(max(slope, 1e-3)), float(offset)
    x, lang = model.slope * margins + model.offset, np.array([language_of(w) for w in texts])
    model.cuts = np.zeros(len(LANGUAGES))

    def best(which) -> float:
        order = np.sort(np.unique(x[which]))
        cuts = np.array([0.0, *((order[1:] + order[:-1]) / 2)])
        errors = [((x[which] >= c) != (y[which] == 1)) @ weight[which] for c in cuts]
        low = np.flatnonzero(np.isclose(errors, min(errors)))
        return float(cuts[low[np.argmin(np.abs(cuts[low]))]])

    overall = best(np.ones(len(y), bool))
    for k in range(len(LANGUAGES)):
        which = lang == k
        model.cuts[k] = best(which) if min((y[which] == 1).sum(), (y[which] == 0).sum()) >= 20 else overall


def _hashed(batches):
    for batch in batches:
        words = [word_hashes((x or b"").lower(), NON_ALNUM).tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(words, pa.binary())], ["doc_id", "label", "words"])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = SAMPLE_PER_CLASS, epochs: int = EPOCHS) -> ToxicityModel | None:
    """Train on at most `per_class` labelled rows of each class; None unless both classes occur.

    `allowed` restricts the labels by doc_id. A fifth of the sample only calibrates.
    """
    bound_arrow_batches(docs.sparkSession)
    sample, counts = labelled_sample(docs, labels, "toxic", per_class, allowed)
    got = sample.mapInArrow(_hashed, "doc_id long, label int, words binary").toPandas().sort_values(["doc_id", "words"], ignore_index=True)
    texts = [np.frombuffer(x, np.uint64) for x in got["words"]]
    y, held = got["label"].to_numpy(float), np.arange(len(got)) % 5 == 4
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        return None
    rng = np.random.default_rng(7)
    model = _new_model(rng)
    _train(model, [texts[i] for i in np.flatnonzero(~held)], y[~held], rng, epochs)
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], y[held], counts[1] / (counts[0] + counts[1]))
    return model


def scored(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score of every row: null and empty texts are scored as texts without words.

    Without a model every score is 0. Other columns are ignored; repeated rows and null
    ids keep a row each.
    """

    def score(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            values = [model.score(word_hashes((x or b"").lower(), NON_ALNUM)) if model else 0.0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted: labels of held-out rows (crc32 fold 0) are never read."""
    model = fit(docs, labels, fold() != 0, per_class)
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all their columns, in one pass."""
    model = fit(docs, labels, fold() != 0, per_class)

    def clean(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([not model or model.score(word_hashes((x or b"").lower(), NON_ALNUM)) < 0.5 for x in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
