"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, composes characters, strips loose marks and hidden characters, maps look-alike letters of other scripts and the usual
digit and sign substitutions to Latin letters, and joins words by single spaces. The lexicon is
learned: starts of words that are far likelier in labelled toxic texts than in clean ones, weighted
by their log-odds. A hit within an exception phrase doesn't count. The score is a logistic
function of the weight found and of that weight by text length.

The lexicon and the two weights are fitted on at most FIT_ROWS labelled rows of the training fold
(those of least id hash; a documented bound); the scoring covers whole texts.

Defined cases: null and empty texts have no hits and the score of a clean text; without labels of
both classes the score is 0; rows that repeat a doc_id are each scored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold as fold_of
from .labelled import logistic
from .shared import lean, materialize, small_batches

FIT_ROWS = 20_000
CUT = 0.5
#: A term is a start of a word of these lengths, seen in at least SUPPORT toxic texts at odds of at least ODDS.
LENGTHS, SUPPORT, ODDS = (4, 5, 6, 7, 8), 5, 20.0

# Look-alikes of Latin letters, digit and sign substitutions, and harmless phrases.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("clown fish", "clownfish", "trash can", "trash bin", "trash collection", "idiot proof", "idiot light", "pond scum", "sore loser", "loser bracket", "worthless bond")

_MAP = str.maketrans(HOMOGLYPHS | SUBSTITUTES)
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[\u0300-\u036f\u200b-\u200f\u00ad]+")


def fold(text: str | None) -> str:
    """Folded words, each after one space, and a last space. A closing exclamation mark is punctuation, one within a word a letter."""
    if not text:
        return " "
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "!" in text or "$" in text:
        text = re.sub(r"[!$]+(?=\W|$)", " ", text)
    return " " + " ".join(_WORD.findall(text.translate(_MAP))) + " "


def _terms(batches):
    """Per task: in how many toxic and clean texts each word start is found."""
    toxic, clean, rows = Counter(), Counter(), [0, 0]
    for batch in batches:
        for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            seen = {w[:n] for w in set(fold(t).split()) for n in LENGTHS if len(w) >= n}
            (toxic if y else clean).update(seen)
            rows[1 - y] += 1
    terms = list(toxic | clean)
    yield pa.RecordBatch.from_arrays([pa.array(["", *terms]), pa.array([rows[0], *(toxic[w] for w in terms)], pa.int64()), pa.array([rows[1], *(clean[w] for w in terms)], pa.int64())], names=["term", "toxic", "clean"])


class Lexicon:
    """Term weights with the automaton, rebuilt where it is used."""

    def __init__(self, weights: dict[str, float], logit: np.ndarray | None = None):
        self.weights, self.logit, self._automaton = weights, logit, None

    def __getstate__(self):
        return {"weights": self.weights, "logit": self.logit, "_automaton": None}

    def found(self, folded: str) -> tuple[float, int]:
        """(sum of the weights of the hits outside exceptions, number of words)."""
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w, x in self.weights.items():
                a.add_word(" " + w, (x, len(w) + 1))
            for e in EXCEPTIONS:
                a.add_word(f" {e} ", (None, len(e) + 2))
            a.make_automaton()
            self._automaton = a
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (x, n) in self._automaton.iter(folded):
            at = end + 1 - n
            if x is None:
                spared.append((at, end))
            else:
                hits[at] = max(x, hits.get(at, 0.0))
        # the furthest end of all phrases that begin up to a place tells whether one covers it
        spared.sort()
        starts, furthest = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        covered = lambda at: (i := bisect_right(starts, at)) > 0 and furthest[i - 1] > at
        return sum(x for at, x in hits.items() if not covered(at)), folded.count(" ") - 1

    def features(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.found(fold(t)) for t in texts], float).reshape(-1, 2)
        return np.column_stack([np.log1p(x[:, 0]), np.log1p(100 * x[:, 0] / np.maximum(x[:, 1], 20))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.logit is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.logit[:-1] + self.logit[-1], -50, 50)))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """From docs(doc_id, text) and labels(doc_id, y), y 0 or 1."""
    small_batches(docs)
    some = labels.where("y in (0, 1)").select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(FIT_ROWS)
    rows = materialize(docs.join(F.broadcast(some), "doc_id").select("text", "y"), "labelled")  # read several times
    count = rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = count.where("term = ''").first()
    if not n or not n["toxic"] or not n["clean"]:
        return Lexicon({})
    odds = ((F.col("toxic") + 0.5) / (n["toxic"] + 1)) / ((F.col("clean") + 0.5) / (n["clean"] + 1))
    terms = count.where((F.col("term") != "") & (F.col("toxic") >= SUPPORT) & (odds >= ODDS)).select("term", F.log(odds).alias("w")).collect()
    weights: dict[str, float] = {}
    for r in sorted(terms, key=lambda r: (len(r["term"]), r["term"])):
        if not any(r["w"] <= weights.get(r["term"][:k], -1.0) + 0.5 for k in LENGTHS if k < len(r["term"])):
            weights[r["term"]] = r["w"]
    lexicon = Lexicon(weights)

    def features(batches):
        for batch in batches:
            x = lexicon.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("y")], names=["a", "b", "y"])

    t = rows.mapInArrow(features, "a double, b double, y int").toArrow()
    x = np.column_stack([t.column("a").to_numpy(), t.column("b").to_numpy()])
    return Lexicon(weights, logistic(x, t.column("y").to_numpy().astype(float), ridge=1e-3))


def score(docs: DataFrame, lexicon: Lexicon, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of docs(doc_id, text)."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            s = np.concatenate([sent.value.score(batch.column("text")[a : a + 500].to_pylist()) for a in range(0, batch.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic").isNotNull() & (fold_of("doc_id", 5) != 0)).select("doc_id", F.col("toxic").alias("y"))
    lexicon = fit(docs, labels)
    return score(docs, lexicon).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
