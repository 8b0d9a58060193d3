"""Language ID by multilingual mixture inference.

Every language is a distribution over hashed byte trigrams of letters, learned from all training
texts. A document's trigrams are taken as drawn from a mixture of languages; expectation-
maximisation estimates the proportions, and languages are dropped, least first, while the
likelihood less PENALTY * ln(trigrams) per language doesn't fall. The prediction is the largest
remaining proportion, the score its share in the full mixture.

Defined cases: null texts and texts without a letter are `und` with score 0; without any training
text every prediction is `und`; ties go to the language first in order; rows that repeat a doc_id
are each predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, pieces
from .labelled import fold
from .shared import lean, pack, small_batches

GRAMS = 1 << 14
PENALTY = 1.5
ROUNDS = 12
#: Neighbouring trigrams overlap; their joint evidence is that of a third as many.
EVIDENCE = 1 / 3
Key = tuple[pa.Scalar, ...]

# Letters: ASCII letters, lower-cased, and every byte of a multi-byte character; the rest parts words.
_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each trigram with a letter in its middle; the middle of trigram i is byte i. Others are -1."""
    x = _LETTER[data]
    a = np.concatenate([np.zeros(1, np.uint32), x[:-1]])
    b = np.concatenate([x[1:], np.zeros(1, np.uint32)])
    h = ((a << np.uint32(16) | x << np.uint32(8) | b) * np.uint32(0x9E3779B1)) >> np.uint32(18)
    return np.where(x > 0, h.astype(np.int32), -1)


def _separate(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a blank after each."""
    n = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))
    out = np.full(len(data) + n, 32, np.uint8)
    out[at] = data
    return out, offsets + np.arange(n + 1)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        lang = np.array(batch.column("lang").to_pylist(), object)
        for a, b in pieces(offsets):
            d, o = _separate(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            g = grams(d)
            names, which = np.unique(lang[a:b].astype(str), return_inverse=True)
            key = np.repeat(which, np.diff(o)) * GRAMS + g
            n = np.bincount(key[g >= 0], minlength=len(names) * GRAMS).reshape(-1, GRAMS)
            for name, x in zip(names.tolist(), n):
                total[name] = total.get(name, 0) + x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([pack(x.astype(np.int64)) for x in total.values()], pa.binary())], names=["lang", "n"])


def _sum(key: Key, table: pa.Table) -> pa.Table:
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "n": pa.array([pack(sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("n")))], pa.binary())})


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(x for x in counts if counts[x].sum())
        n = np.array([counts[x] for x in self.langs], float).reshape(-1, GRAMS)
        p = (n + 0.1) / (n.sum(1, keepdims=True) + 0.1 * GRAMS) if len(n) else n
        self.p = np.ascontiguousarray(p.T)

    def _mix(self, p: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(ROUNDS):
            share = p @ w
            new = w * ((n / share) @ p) / n.sum()
            moved = np.abs(new - w).max()
            w = new
            if moved < 1e-3:
                break
        return w, float(n @ np.log(p @ w))

    def infer(self, g: np.ndarray) -> tuple[str, float]:
        """(language, proportion) from a document's trigram buckets."""
        if not len(g) or not self.langs:
            return "und", 0.0
        n = np.bincount(g, minlength=GRAMS)
        i = np.flatnonzero(n)
        p, n = self.p[i], n[i].astype(float)
        w, like = self._mix(p, n, np.full(len(self.langs), 1 / len(self.langs)))
        full, held = w, np.arange(len(w))
        price = PENALTY * np.log(n.sum() + 1)
        best = int(np.argmax(w))
        alone = float(n @ np.log(p[:, best]))
        if (like - alone) * EVIDENCE <= price:  # one language explains it as well as any set
            return self.langs[best], float(full[best])
        while len(held) > 1:
            left = np.delete(np.arange(len(held)), np.argmin(w))
            v = w[left] / w[left].sum() if w[left].sum() > 0 else np.full(len(left), 1 / len(left))
            w2, like2 = self._mix(p[:, held[left]], n, v)
            if (like - like2) * EVIDENCE > price:
                break
            w, like, held = w2, like2, held[left]
        best = int(held[np.argmax(w)])
        return self.langs[best], float(full[best])


def fit(docs: DataFrame) -> Model:
    """From docs(text, lang), rows with both; one row of counts per language comes to the driver."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    got = small_batches(rows).mapInArrow(_count, "lang string, n binary").groupBy("lang").applyInArrow(_sum, "lang string, n binary").collect()
    return Model({r["lang"]: np.frombuffer(r["n"], np.int64) for r in got})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out: list[tuple[str, float]] = []
            for a, b in pieces(offsets):
                d, o = _separate(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                g = grams(d)
                for s, e in zip(o[:-1], o[1:]):
                    x = g[s:e]
                    x = x[x >= 0]
                    if len(x) and not ((_ASCII_LETTER[d[s:e]]).any() or any(map(str.isalpha, d[s:e].tobytes().decode("utf-8", "ignore")))):
                        x = x[:0]
                    out.append(sent.value.infer(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x[0] for x in out], pa.string()), pa.array([min(1.0, max(0.0, x[1])) for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
