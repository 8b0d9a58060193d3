"""LM scoring by cross-entropy difference of matched bigram models.

The background model is learned from all documents, the target model from those of a given set
(here: labelled good). Both are bigram models of words (lower-case, parted by ASCII white space)
over one vocabulary, interpolated with their unigrams:

    p(w | v) = MIX * c(v w) / c(v .) + (1 - MIX) * (c(w) + ADD) / (N + ADD * V)

Every word and every bigram counts, at every size, and no model has to fit a task or a broadcast.
Documents are dealt into chunks of text. A chunk sends each distinct word and bigram once, with its
counts there, to the bucket of that key's range; a bucket adds up the counts of its keys and sends
the sums back to the chunks that asked, in the order of the keys. There the chunk's texts, read a
second time, find the sums of their words and bigrams.

Words and bigrams are 64-bit hashes. A frequent one is a single entry a chunk, so no bucket grows
with the number of its occurrences.

A document's score is its mean per-token loss under the background model less that under the
target model: higher is more like the target.

Defined cases: null, empty and blank texts have n_tokens 0 and losses and score 0; an empty target
set leaves a uniform target model; rows that repeat a doc_id are each counted and scored; a null
doc_id is never in the target set by its id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, pieces, words
from .shared import materialize, mix, small_batches, text_bytes

MIX, ADD = 0.7, 0.5
#: Text in a chunk (bytes), and entries (key of a chunk) in a bucket, about.
CHUNK, BUCKET = 8 << 20, 1 << 21
#: Distinct words a task holds before it passes them on.
FLUSH = 1 << 20
Key = tuple[pa.Scalar, ...]
#: Counts of a word: in all texts, in target texts, and of those the ones that another word follows. Of a bigram: the first two.
_WORD, _PAIR = 4, 2
_ASKED = "bucket long, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"
_SUMS = "bucket long, chunk long, word_counts binary, pair_counts binary"
_LOSSES = "doc_id long, n_tokens long, loss_background double, loss_target double, score double"


def _squeeze(a: np.ndarray) -> bytes:
    """An array for the way through a shuffle: bytes of the same weight side by side, then zstd."""
    a = np.ascontiguousarray(a).reshape(-1)
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _open(value: pa.Scalar, kind: type) -> np.ndarray:
    raw = memoryview(value.as_buffer())
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return np.zeros(0, kind)
    a = np.frombuffer(pa.decompress(raw[8:], decompressed_size=size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(a.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as the steps between them."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _tokens(text) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts, in order, and the row of each."""
    data, offsets = buffers(text)
    got = [(h, doc + a) for a, b in pieces(offsets) for h, doc in [words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in got]), np.concatenate([d for _, d in got])


def _follows(doc: np.ndarray) -> np.ndarray:
    """Whether a token has one before it in its document."""
    return np.concatenate([[False], doc[1:] == doc[:-1]])[: len(doc)]


def _bigrams(h: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hash of each token that follows another, together with that one."""
    at = np.flatnonzero(after)
    return mix(h[at - 1] * np.uint64(0x9E3779B97F4A7C15) + h[at])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, so sorted keys are in the order of their buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _distinct_words(buckets: int):
    """Per document its number of tokens; per task its distinct words, packed by bucket."""
    names = ["doc_id", "target", "n", "bucket", "words"]

    def packed(held):
        key = np.unique(np.concatenate(held))
        name, first = np.unique(_bucket(key, buckets), return_index=True)
        none = lambda kind: pa.nulls(len(name), kind)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.bool_()), none(pa.int64()), pa.array(name), pa.array([_steps(x) for x in np.split(key, first[1:])], pa.binary())], names=names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            h, doc = _tokens(batch.column("text"))
            n = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(n), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names=names)
            held.append(np.unique(h))
            size += len(held[-1])
            if size > FLUSH:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size > FLUSH // 2:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    return run


def _count_distinct(key: Key, table: pa.Table) -> pa.Table:
    found = np.unique(np.concatenate([np.cumsum(_open(x, np.uint64), dtype=np.uint64) for x in table.column("words")]))
    return pa.table({"n": pa.array([len(found)], pa.int64())})


def _flagged(docs: DataFrame) -> DataFrame:
    target = F.coalesce("target", F.lit(False)) if "target" in docs.columns else F.lit(False)
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", target.alias("target"))


def train(docs: DataFrame, good: DataFrame | None = None) -> dict[str, int]:
    """What both models share, of docs(doc_id, text[, target]) and good(doc_id): tokens of all and of target documents, distinct words.

    A document is in the target set if `target` says so or `good` has its doc_id. Only a number a document is joined.
    """
    docs = _flagged(docs)
    _, size = text_bytes(docs)
    rows = materialize(docs.mapInArrow(_distinct_words(max(1, math.ceil(size / 60 / BUCKET))), "doc_id long, target boolean, n long, bucket long, words binary"), "words")
    tokens = rows.where("bucket IS NULL").select("doc_id", "target", "n")
    if good is not None:
        tokens = tokens.join(good.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).distinct(), "doc_id", "left").withColumn("target", F.col("target") | F.coalesce("good", F.lit(False)))
    n = tokens.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("target"), F.col("n"))).alias("target")).first()
    distinct = rows.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_count_distinct, "n long").agg(F.sum("n")).first()[0]
    return {"all": int(n["all"] or 0), "target": int(n["target"] or 0), "words": int(distinct or 0), "bytes": size}


def _ask(buckets: int):
    """A chunk's distinct words and bigrams with their counts in it, packed by bucket."""

    def counted(key: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        return key[first], np.stack([np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]).astype(np.uint32)

    def run(key: Key, docs: pa.Table, good: pa.Table) -> pa.Table:
        # a side without rows may come without columns too
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 4, names=["bucket", "chunk", "words", "word_counts", "pairs", "pair_counts"])
        wanted = good.column("doc_id").to_numpy() if good.num_rows else np.zeros(0, np.int64)
        h, doc = _tokens(docs.column("text"))
        ids = docs.column("doc_id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False) & np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), wanted)
        flag = (docs.column("target").to_numpy() | known).astype(np.int64)[doc]
        after = _follows(doc)
        on = np.append(after[1:], [False] * bool(len(doc))).astype(np.int64)
        one = np.ones(len(h), np.int64)
        word = counted(h, [one, flag, on, flag * on])
        pair = counted(_bigrams(h, after), [one[after], flag[after]])
        cut = [np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1)) for k, _ in (word, pair)]
        used = np.flatnonzero((np.diff(cut[0]) > 0) | (np.diff(cut[1]) > 0)).tolist()
        columns = [pa.array(used, pa.int64()), pa.array([key[0].as_py()] * len(used), pa.int64())]
        for (k, counts), c in zip((word, pair), cut):
            columns += [pa.array([_steps(k[c[b] : c[b + 1]]) for b in used], pa.binary()), pa.array([_squeeze(counts[:, c[b] : c[b + 1]]) for b in used], pa.binary())]
        return pa.table(columns, names=["bucket", "chunk", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _summed(table: pa.Table, keys: str, counts: str, width: int) -> pa.Array:
    """For each chunk's keys of this bucket the sums over all chunks."""
    parts = [np.cumsum(_open(x, np.uint64), dtype=np.uint64) for x in table.column(keys)]
    ends = np.cumsum([len(x) for x in parts])[:-1]
    key = np.concatenate(parts)
    count = np.concatenate([_open(x, np.uint32).reshape(width, -1) for x in table.column(counts)], axis=1)
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    total = np.stack([np.add.reduceat(c[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for c in count])
    return pa.array([_squeeze(x) for x in np.split(total[:, group], ends, axis=1)], pa.binary())


def _answer(key: Key, table: pa.Table) -> pa.Table:
    return pa.table([table.column("bucket"), table.column("chunk"), _summed(table, "words", "word_counts", _WORD), _summed(table, "pairs", "pair_counts", _PAIR)], names=["bucket", "chunk", "word_counts", "pair_counts"])


def _losses(model: dict[str, int]):
    """One chunk with the sums of its words and bigrams: the losses of its documents."""

    def run(key: Key, docs: pa.Table, sums: pa.Table) -> pa.Table:
        h, doc = _tokens(docs.column("text"))
        n = np.bincount(doc, minlength=docs.num_rows)
        after = _follows(doc)
        sums = sums.sort_by("bucket") if sums.num_rows else sums
        get = lambda c, width: np.concatenate([np.zeros((width, 0), np.int64), *(_open(x, np.int64).reshape(width, -1) for x in (sums.column(c) if sums.num_rows else []))], axis=1)
        names, back = np.unique(h, return_inverse=True)
        word = get("word_counts", _WORD)
        pair_names, pair_back = np.unique(_bigrams(h, after), return_inverse=True)
        pair = get("pair_counts", _PAIR)
        if word.shape[1] != len(names) or pair.shape[1] != len(pair_names):
            raise ValueError(f"chunk {key[0]} has sums of {word.shape[1]} words and {pair.shape[1]} bigrams, not {len(names)} and {len(pair_names)}")
        loss = np.zeros((2, len(n)))
        for j, total in enumerate((model["all"], model["target"])):
            single = (word[j] + ADD) / (total + ADD * (model["words"] + 1))
            p = single[back]
            before = word[2 + j][back[np.flatnonzero(after) - 1]]
            # a first token, or one after a word that the model never saw followed, has the unigram's loss
            p[after] = np.where(before > 0, MIX * pair[j][pair_back] / np.maximum(before, 1) + (1 - MIX) * p[after], p[after])
            loss[j] = np.bincount(doc, -np.log(p), minlength=len(n)) / np.maximum(n, 1)
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": n, "loss_background": loss[0], "loss_target": loss[1], "score": loss[0] - loss[1]})

    return run


def score(docs: DataFrame, model: dict[str, int], good: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_tokens, loss_background, loss_target, score) of the rows, and the target set, that `train` was given."""
    docs = _flagged(docs)
    chunks, buckets = max(1, math.ceil(model["bytes"] / CHUNK)), max(1, math.ceil(model["all"] / BUCKET))
    # rows without an id are dealt by their text: they may be many, and no id asks for them
    dealt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(chunks)).alias("chunk")
    text = docs.select("*", dealt("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))).repartition("chunk")
    good = docs.select("doc_id").limit(0) if good is None else good.select(F.col("doc_id").cast("long").alias("doc_id"))
    good = good.where("doc_id IS NOT NULL").distinct().select("doc_id", dealt("doc_id", F.lit(None).cast("long")))
    asked = text.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(_ask(buckets), _ASKED)
    sums = asked.groupBy("bucket").applyInArrow(_answer, _SUMS)
    return text.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_losses(model), _LOSSES)


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return score(docs, train(docs, good), good)
