"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Statistics of a text's bytes (shares of character kinds, repeats of bytes and words, lengths, entropy) are transformed to be closer to normal:
arc sine of the root for shares, logarithm for lengths. Each class has a mean and a covariance shrunk towards the pooled covariance and towards its
diagonal, by the weights under which held-out rows of the sample are likeliest; no variance falls below a share of the variance over all rows, as a class may
never have shown what it can do. The Cholesky factors are kept, so a score costs one triangular product a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.sampling import least_by_hash
from spindrel.llm.shingles import buffers, slices, word_hashes

#: Labelled texts that the classifier is fitted on at most.
SAMPLE = 20_000
#: Weights of the pooled covariance and of the diagonal that are tried, parts of the sample that are held out in turn, and the least variance of a class against that of all rows.
POOLED, DIAGONAL, FOLDS, FLOOR = (0.1, 0.3, 0.6, 1.0), (0.05, 0.3, 1.0), 5, 0.3
#: Least scale of a statistic, about the noise of a share among a hundred words, and scales from the middle beyond which a value counts no further.
NOISE, FAR = 0.05, 4.0
#: Bytes of usual text that each text's counts start from.
PRIOR = 150
#: Counts of a text: 256 bytes, like neighbours, ends of words, words, repeated words.
COUNTS = 260


def _kinds() -> np.ndarray:
    """(byte, kind): A-Z, a-z and others above ASCII, digits, blanks, line ends, sentence marks, bars and brackets, other marks."""
    k = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        kind = 1 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c in "\r\n" else 3 if c.isspace() else 5 if c in ".,;:'\"-" else 6 if c in "|[]{}<>=/\\" else 7
        k[b, kind] = 1
    return k


_KINDS = _kinds()


def counts(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """(text, 260): how often each byte stands in each text, is like the byte before it, and ends a word; words, and words like the word before them."""
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros((len(offsets) - 1, COUNTS))
    h, of = word_hashes(raw, offsets)
    out[:, 258] = np.bincount(of, minlength=len(out))
    out[:, 259] = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=len(out))
    for i, row in enumerate(out):
        d = data[offsets[i] : offsets[i + 1]]
        for a in range(0, len(d), 1 << 20):
            part = d[a : a + (1 << 20) + 1]
            row[:256] += np.bincount(part[: 1 << 20], minlength=256)
            row[256] += np.count_nonzero(part[1:] == part[:-1])
            row[257] += np.count_nonzero((part[1:] <= 32) & (part[:-1] > 32))
    return out


def statistics(found: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """(text, statistic) of counts, each text with PRIOR bytes of usual text added, so that short texts are near the usual."""
    found = found + PRIOR * usual
    whole = found[:, :256].sum(1, keepdims=True)
    kinds = found[:, :256] @ _KINDS
    share = np.concatenate((kinds, found[:, 256:257]), 1) / whole
    p = found[:, :256] / whole
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    twice = np.arcsin(np.sqrt(np.clip(found[:, 259] / (found[:, 258] + 1e-9), 0, 1)))
    return np.column_stack((np.arcsin(np.sqrt(np.clip(share, 0, 1))), np.log1p(kinds[:, :2].sum(1) / (found[:, 257] + 1e-9)), entropy, twice))


def _shrunk(x: np.ndarray, y: np.ndarray, pooled_weight: float, diagonal_weight: float) -> list[tuple]:
    """(mean, inverse Cholesky factor, half the log determinant, log prior) of each class."""
    means = [x[y == k].mean(0) for k in (0, 1)]
    within = x - np.where((y == 1)[:, None], means[1], means[0])
    pooled = within.T @ within / len(x)
    out = []
    for k in (0, 1):
        own = within[y == k]
        cov = (1 - pooled_weight) * (own.T @ own / len(own)) + pooled_weight * pooled
        cov = (1 - diagonal_weight) * cov + diagonal_weight * np.diag(np.diag(cov))
        cov += np.diag(np.maximum(0, FLOOR - np.diag(cov)))
        factor = np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov)))
        out.append((means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log((len(own) + 1) / (len(x) + 2))))
    return out


def _densities(x: np.ndarray, parts: list[tuple]) -> np.ndarray:
    """(row, class) log density, up to a constant that the classes share, from Mahalanobis distances."""
    return np.column_stack([prior - half_log_det - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, half_log_det, prior in parts])


class Discriminant:
    """Two Gaussians with shrunk covariances; score is the probability of class 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, usual: np.ndarray) -> None:
        self.usual = usual
        self.middle, self.scale = x.mean(0), np.maximum(x.std(0), NOISE)
        x = self._scaled(x)
        fold = np.arange(len(x)) % FOLDS  # rows come sorted by class, so each fold has its share of both
        self.weights = max(((p, d) for p in POOLED for d in DIAGONAL), key=lambda w: (self._held_out(x, y, fold, *w), w))
        self.parts = _shrunk(x, y, *self.weights)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -FAR, FAR)

    @staticmethod
    def _held_out(x: np.ndarray, y: np.ndarray, fold: np.ndarray, pooled: float, diagonal: float) -> float:
        """Mean log density of each row in its own class, by the rows of the other folds; nothing where a class has too few rows to hold any out."""
        if min(np.bincount(y, minlength=2)) < 2 * FOLDS:
            return 0.0
        total = 0.0
        for k in range(FOLDS):
            some = fold == k
            total += _densities(x[some], _shrunk(x[~some], y[~some], pooled, diagonal))[np.arange(some.sum()), y[some]].sum()
        return total / len(x)

    def score(self, x: np.ndarray) -> np.ndarray:
        density = _densities(self._scaled(x), self.parts)
        return 1 / (1 + np.exp(np.clip(density[:, 0] - density[:, 1], -700, 700)))


class Constant:
    """Stands in where the labels have one class only, or none."""

    def __init__(self, p: float) -> None:
        self.p, self.usual = p, np.full(COUNTS, 1 / 256)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def _usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: the sum of the texts' shares, and how many texts."""
    total, n = np.zeros(COUNTS), 0
    for whole in batches:
        for batch in slices(whole, "text"):
            c = counts(*buffers(batch.column(0)))
            c = c[c[:, :256].any(1)]
            total += (c / c[:, :256].sum(1, keepdims=True)).sum(0)
            n += len(c)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "shares"])


def _measure(batches: Iterator[pa.RecordBatch], usual: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            x = statistics(counts(*buffers(batch.column(1))), usual)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def fit(labelled: DataFrame) -> Discriminant | Constant:
    """From (label 0 or 1, text) rows, which the caller has bounded; only sums and statistics reach the driver."""
    labelled = labelled.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), "text")
    good = labelled.where("label = 1").select("text").mapInArrow(_usual, "n long, shares array<double>").collect()
    texts = sum(r["n"] for r in good)
    usual = np.sum([np.round(r["shares"], 9) for r in good], 0) / texts if texts else np.r_[np.full(256, 1 / 256), 0, 0.2, 0.2, 0]
    rows = labelled.mapInArrow(lambda it: _measure(it, usual), "label int, x array<double>").collect()
    y = np.array([r["label"] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = np.array([r["x"] for r in rows])
    order = np.lexsort((*x.T, y))  # sums don't depend on how the rows arrive
    return Discriminant(x[order], y[order], usual)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Discriminant | Constant:
    """Fits on at most ``sample`` labelled documents, the ones with the least hash of their id."""
    some = least_by_hash(labels.where(f"`{label}` in (0, 1) and doc_id is not null").select("doc_id", F.col(f"`{label}`").alias("label")), ["doc_id", "label"], sample)
    # sample rows of two numbers at most: a size that doesn't grow with the tables
    return fit(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", "text"))


def _score(batches: Iterator[pa.RecordBatch], model, at: int, kept: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, whole.schema.names[at]):
            s = model.score(statistics(counts(*buffers(batch.column(at))), model.usual))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(s, pa.float64())], [*batch.schema.names[:kept], "score"])


def score(docs: DataFrame, model: Discriminant | Constant, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with score: the probability of label 1, from statistics of the whole text.

    Null texts count as empty, and empty texts have a score like others; an empty docs gives no rows.
    """
    at, extra = (keep.index(text_col), 0) if text_col in keep else (len(keep), 1)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{text_col}`").cast("string").alias("__text")] * extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]) + ", score double"
    return rows.mapInArrow(lambda it: _score(it, model, at, len(keep)), schema)
