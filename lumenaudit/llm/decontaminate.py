"""Benchmark decontamination by pigeonhole edit matching.

Text is compared as lower-case words joined by single spaces. An item of n characters may differ by
a budget of edits (RATE of n, with pieces of at least PIECE characters); it is split into budget + 1
pieces, one of which any such copy holds exactly. Aho-Corasick finds all piece hits of all items in
one pass over a text; each hit is verified around its place with Myers' bit-parallel distance.

Items are shipped to the tasks in blocks of at most BLOCK bytes, one after another, so what is
broadcast is bounded however large the benchmark is.

Defined cases: null or wordless texts match nothing; items without words are left out; the best
match of a document with an item is given, the leftmost of equals; rows that repeat a doc_id or an
item_id are each compared; empty tables give no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, small_batches, text_bytes

RATE, PIECE = 0.06, 14
BLOCK = 8 << 20
_WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


def budget(n: int) -> int:
    return max(0, min(int(RATE * n), n // PIECE - 1))


def split_pieces(item: str) -> list[tuple[int, str]]:
    """(place, piece): budget + 1 pieces of about equal length."""
    k = budget(len(item)) + 1
    cuts = [i * len(item) // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of the text, end of the first such substring)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def _matcher(items: list[tuple[object, str]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    held: dict[str, list[tuple[int, int]]] = {}
    for n, (_, item) in enumerate(items):
        for at, piece in split_pieces(item):
            held.setdefault(piece, []).append((n, at))
    for piece, where in held.items():
        a.add_word(piece, (len(piece), where))
    a.make_automaton()

    def match(text: str) -> dict[int, tuple[int, int]]:
        """item -> (distance, start about) for every item within its budget."""
        near: dict[tuple[int, int], list[int]] = {}
        for end, (length, where) in a.iter(text):
            for n, at in where:
                k = budget(len(items[n][1]))
                start = end + 1 - length - at
                near.setdefault((n, start // (k + 1)), []).append(start)
        found: dict[int, tuple[int, int]] = {}
        for (n, _), starts in near.items():
            item = items[n][1]
            k = budget(len(item))
            for start in sorted(set(starts)):
                if n in found and found[n][0] == 0:
                    break
                if start >= 0 and text.startswith(item, start):
                    d, at = 0, start
                else:
                    a0 = max(0, start - k)
                    d, end = myers(item, text[a0 : start + len(item) + k])
                    at = max(0, a0 + end - len(item))
                if d <= k and (n not in found or (d, at) < found[n]):
                    found[n] = (d, at)
        return found

    return match


_WORKER: list = [None, None]


def _matcher_of(items: list[tuple[object, str]]):
    """The automaton of a broadcast list, built once in a worker."""
    if _WORKER[0] is not items:
        _WORKER[:] = items, _matcher(items)
    return _WORKER[1]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start): items that a text holds within their error budget."""
    spark = small_batches(docs).sparkSession
    _, size = text_bytes(benchmark)
    blocks = -(-size // BLOCK) or 1
    kind = dict(benchmark.dtypes)["item_id"]
    out = None
    for b in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text")
        items = sorted({(r["item_id"], t) for r in part.toLocalIterator() if (t := normal(r["text"]))}, key=str)
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            match = _matcher_of(sent.value) if sent.value else None
            for batch in batches:
                rows = []
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    if match and t.is_valid and (text := normal(t.as_py())):
                        rows += [(d, items[n][0], *x) for n, x in sorted(match(text).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], batch_kind), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], names=["doc_id", "item_id", "distance", "start"])

        from pyspark.sql.pandas.types import to_arrow_type

        batch_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
        got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, item_id {kind}, distance int, start long")
        out = got if out is None else out.unionByName(got)
    return out


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
