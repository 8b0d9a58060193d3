"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, shrunk towards its diagonal; a document's
score is the logistic of the difference of its Mahalanobis log-densities under the two classes
(with the classes' shares), by triangular solves with cached Cholesky factors. Statistics are fitted
over all labelled rows of the training fold, from per-task sums.

Defined cases: null and empty texts have the statistics of an empty text; without labelled rows of
both classes every score is the one class's share (0.5 without any); rows that repeat a doc_id are
each scored, and each labelled row counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, pieces, words
from .labelled import fold
from .shared import lean, mix, small_batches

SHRINK = 0.1
CUT = 0.3
NAMES = ("words", "word_length", "upper", "digit", "symbol", "stop", "non_ascii", "odd_words", "distinct", "top_word", "repeated_pairs", "line_words", "repeated_lines")

_KIND = {name: np.zeros(256, np.int8) for name in ("upper", "letter", "digit", "symbol", "stop", "high", "line")}
_KIND["upper"][65:91] = 1
_KIND["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND["digit"][48:58] = 1
_KIND["symbol"][[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_KIND["stop"][[ord(c) for c in "!?;:"]] = 1
_KIND["high"][128:] = 1
_KIND["line"][10] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per document."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def total(name: str) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(_KIND[name][data], dtype=np.int64)])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    h, doc = words(data, offsets)
    count = np.bincount(doc, minlength=n).astype(float)
    many = np.maximum(count, 1)
    letters = total("letter")
    first = np.searchsorted(doc, np.arange(n + 1))
    distinct, top, pairs, lines, twice = (np.zeros(n) for _ in range(5))
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h[:0]
    line_at = np.flatnonzero(data == 10)
    for d in range(n):
        a, b = first[d], first[d + 1]
        if b <= a:
            continue
        x = np.sort(h[a:b])
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        distinct[d] = len(new)
        top[d] = np.diff(np.append(new, len(x))).max()
        if b - a > 1:
            y = np.sort(pair[a : b - 1])
            pairs[d] = 1 - (1 + np.count_nonzero(y[1:] != y[:-1])) / len(y)
        i, j = np.searchsorted(line_at, (offsets[d], offsets[d + 1]))
        lines[d] = j - i + 1
        if j > i:
            raw = data[offsets[d] : offsets[d + 1]].tobytes().split(b"\n")
            twice[d] = 1 - len(set(raw)) / len(raw)
    odd = np.zeros(n)
    if len(h):
        end = np.flatnonzero(~_space(data) & np.concatenate([_space(data)[1:], [True]]))
        tail = (_KIND["symbol"] | _KIND["stop"])[data[end]].astype(float)
        odd = np.bincount(np.searchsorted(offsets, end, "right") - 1, tail, minlength=n)[:n]
    # Shares of a short text are drawn towards usual values by a few imagined characters, words and lines.
    return np.column_stack(
        [
            np.log1p(count),
            np.log1p((size + 120) / (many + 20)),
            np.sqrt((total("upper") + 3) / (letters + 100)),
            np.sqrt(total("digit") / (size + 100)),
            np.sqrt(total("symbol") / (size + 100)),
            np.sqrt(total("stop") / (size + 100)),
            np.sqrt(total("high") / (size + 100)),
            np.sqrt(odd / (many + 5)),
            np.log1p(distinct + 20) / np.log1p(many + 20),
            np.sqrt((top + 1) / (many + 20)),
            np.sqrt(pairs * many / (many + 20)),
            np.log1p((count + 20) / (lines + 1)),
            np.sqrt(twice * lines / (lines + 3)),
        ]
    )


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _batch_statistics(batch: pa.RecordBatch) -> np.ndarray:
    data, offsets = buffers(batch.column("text"))
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _rows(batches):
    for batch in batches:
        x = _batch_statistics(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def _sums(batches):
    """Per task and class: count, sums and products, flattened."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        for c in np.unique(y).tolist():
            z = np.column_stack([np.ones((y == c).sum()), x[y == c]])
            total[c] = total.get(c, 0) + z.T @ z
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["y", "m"])


class Model:
    """Class shares, means and inverse Cholesky factors; `score` is the density difference as a probability."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float = SHRINK):
        n = {c: m[0, 0] for c, m in sums.items()}
        self.share = n.get(1, 0.0) / sum(n.values()) if n else 0.5
        self.classes = None
        if n.get(0, 0) >= 2 and n.get(1, 0) >= 2:
            self.classes = []
            whole = sum(sums.values())
            spread = np.diag(whole)[1:] / whole[0, 0] - (whole[0, 1:] / whole[0, 0]) ** 2
            for c in (0, 1):
                mean = sums[c][0, 1:] / n[c]
                cov = sums[c][1:, 1:] / n[c] - np.outer(mean, mean)
                cov = (1 - shrink) * cov + shrink * np.diag(np.maximum(np.diag(cov), 0)) + np.diag(0.02 * np.maximum(spread, 0) + 1e-6)
                factor = np.linalg.inv(np.linalg.cholesky(cov))
                self.classes.append((mean, factor, np.log(np.diag(factor)).sum() + np.log(n[c] / (n[0] + n[1]))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        (m0, f0, c0), (m1, f1, c1) = self.classes
        log = lambda m, f, c: c - 0.5 * (((x - m) @ f.T) ** 2).sum(1)
        return 1 / (1 + np.exp(np.clip(log(m0, f0, c0) - log(m1, f1, c1), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From docs(doc_id, text) and labels(doc_id, y), y 0 or 1: sums of squares and products per class come to the driver."""
    x = small_batches(docs).select("doc_id", "text").mapInArrow(lean(_rows), "doc_id long, x array<double>")
    y = labels.where("y in (0, 1)").select("doc_id", F.col("y").cast("long").alias("y"))
    parts = x.join(y, "doc_id").select("x", "y").mapInArrow(_sums, "y long, m array<double>")
    width = len(NAMES) + 1
    sums = parts.select("y", F.posexplode("m")).groupBy("y", "pos").agg(F.sum("col").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r["y"], np.zeros(width * width))[r["pos"]] = r["v"]
    return Model({c: m.reshape(width, width) for c, m in out.items()})


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            s = model.score(_batch_statistics(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches `cut`; scored in place, without a join."""

    def run(batches):
        for batch in batches:
            good = model.score(_batch_statistics(batch)) >= cut
            yield batch.filter(pa.array(good))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    return labels.where(F.col(column).isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", F.col(column).alias("y"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(fold("doc_id", 5) != 0), training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
