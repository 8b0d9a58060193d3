"""Near duplicates by HyperMinHash sketches, banded, estimated and then verified on whole shingle sets.

Each shingle's hash picks one of REGISTERS buckets; a bucket keeps its least remaining hash as the count of
leading zeros and MANTISSA bits after them, 16 bits together. A bucket that no shingle falls in borrows, for banding,
the register of a bucket that a fixed sequence of its own names, so that short texts have as many draws as
long ones. Bands of ROWS registers give candidates: at a similarity of 0.8 a pair shares none of the
REGISTERS / ROWS bands with probability (1 - 0.8 ** 4) ** 40, less than 1e-9. A pair goes on to the comparison of
whole sets unless the share of equal registers, less the collisions that sets of these sizes have by
chance, is DEVIATIONS standard deviations below the threshold.

Equal sets are one class from the start, so exact copies are never paired. Within a band, classes are paired
with one leader, the class that shares its bands with most others (of edited copies of a text that is the
text). What these links leave apart is compared once more, only across components and only where a band holds several.
Whole sets are compared in a grid of cells over (a, b), whose number follows pairs and bytes.

Defined cases: null or blank text has no shingles (n_shingles 0) and links with nothing; fewer than k words
are one shingle; a very long text is handled alone; repeated rows, ids or not, are one class by their text, so rows
without doc_id are no special case; a null doc_id is a component's name only if all its are null; further columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, pieces, shingle_sets
from .components import components
from .shared import lean, lean_group, lean_groups, materialize, mix, pack

REGISTERS, ROWS, MANTISSA = 160, 4, 10
DEVIATIONS = 6
#: Empty register; no register of a bucket that holds a shingle has this value.
EMPTY = 0xFFFF
#: Pairs, and bytes of text, that one cell of the comparison is dealt, about.
CELL, CELL_BYTES = 4000, 8 << 20
#: Texts handed to Spark at once (bytes).
BATCH = 4 << 20


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = buffers(column)
    for a, b in pieces(offsets):
        for d, s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
            yield a + d, s


def class_id(s: np.ndarray) -> bytes:
    """Names a set: 128 bits."""
    n = np.uint64(len(s))
    return pack(np.array([np.bitwise_xor.reduce(mix(s * np.uint64(3) + n)), np.add.reduce(mix(s ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(5) + n)], np.uint64))


def registers(s: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: leading zeros and mantissa of the least hash of each bucket, EMPTY for none."""
    h = mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    bucket = ((h >> np.uint64(40)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)
    least = np.full(REGISTERS, 1 << 40, np.int64)
    np.minimum.at(least, bucket, (h & np.uint64((1 << 40) - 1)).astype(np.int64))
    x = np.maximum(least, 1)
    zeros = 39 - np.floor(np.log2(x)).astype(np.int64)
    rest = (x << np.maximum(zeros + 1, 0)) & ((1 << 40) - 1)
    return np.where(least == 1 << 40, EMPTY, (zeros << MANTISSA) | (rest >> (40 - MANTISSA))).astype(np.uint16)


#: For each bucket the buckets that it would borrow from, in turn.
_DONORS = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS), axis=1)


def bands(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, empty buckets filled from their donors."""
    full = sketch != EMPTY
    if not full.all():
        donor = _DONORS[np.arange(REGISTERS), full[_DONORS].argmax(axis=1)]
        sketch = np.where(full, sketch, sketch[donor])
    x = np.arange(REGISTERS // ROWS, dtype=np.uint64)
    for r in sketch.reshape(-1, ROWS).astype(np.uint64).T:
        x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + r)
    return x


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How likely a bucket's registers agree by chance where sets of these sizes share nothing."""
    zeros = np.arange(40)
    high, low = 0.5**zeros, 0.5 ** (zeros + 1)
    at = lambda n: np.exp(-low * (n / REGISTERS)[:, None]) - np.exp(-high * (n / REGISTERS)[:, None])
    return (at(na.astype(float)) * at(nb.astype(float))).sum(axis=1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of each two sketches (rows), corrected for chance, and how many registers it rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    by_chance = chance(na, nb) * REGISTERS
    return (same - by_chance) / np.maximum(used - by_chance, 1), used


def _rows(k: int):
    """(doc_id, n, c, sketch) of each row; no class and no sketch for an empty set."""

    def run(batches):
        for batch in batches:
            n, c, sketch = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for d, s in _sets(batch.column("text"), k):
                n[d], c[d], sketch[d] = len(s), class_id(s), pack(registers(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(c, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "n", "c", "sketch"])

    return run


def _texts(k: int):
    """(c, text) of each text; copies within a batch once."""

    def run(batches):
        for batch in batches:
            texts, seen, rows, held = batch.column("text"), set(), [], 0
            for d, s in _sets(texts, k):
                c = class_id(s)
                if c in seen:
                    continue
                seen.add(c)
                rows.append((c, texts[d].as_py()))
                held += len(rows[-1][1])
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.string()))], names=["c", "text"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.string()))], names=["c", "text"])

    return run


def _bands(batches):
    for batch in batches:
        keys = [bands(np.frombuffer(x.as_buffer(), np.uint16)) for x in batch.column("sketch")]
        yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array([x.view(np.int64) for x in keys], pa.list_(pa.int64()))], names=["c", "n", "bands"])


def _likely(percent: int):
    """Pairs that their sketches don't rule out."""
    t = percent / 100

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(c)]) for c in ("sa", "sb"))
            est, used = estimate(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            keep = est >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(k: int, percent: int):
    """Links among a cell's pairs, by their whole sets."""

    def run(key, pairs: pa.Table, texts: pa.Table) -> pa.Table:
        named = texts.column("c").to_pylist()
        sets = {named[d]: s for d, s in _sets(texts.column("text"), k)}
        a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
        keep = []
        for x, y in zip(a, b):
            x, y = sets[x], sets[y]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of classes(c, n, sketch) those that reach the threshold, by texts(c, text, bytes)."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(percent), "a binary, b binary")
    pairs = materialize(likely, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    size = texts.select("c", "bytes").join(ends, "c", "left_semi").agg(F.sum("bytes")).first()[0] or 0
    grid = max(1, math.ceil(math.sqrt(max(pairs.count() / CELL, 2 * size / CELL_BYTES))))
    at = lambda x: F.pmod(F.xxhash64(x), F.lit(grid))
    pairs = pairs.withColumn("cell", at("a") * grid + at("b"))
    need = pairs.select("cell", F.explode(F.array("a", "b")).alias("c")).distinct()
    needed = need.join(texts.select("c", "text"), "c").select(F.col("cell").alias("cell"), "c", "text")  # a column of its own: both sides of the grouping come from pairs
    found = pairs.groupBy("cell").cogroup(needed.groupBy("cell")).applyInArrow(lean_groups(_verify(k, percent)), "a binary, b binary")
    return materialize(found, "links")


def _ordered(x: str, y: str):
    return F.when(F.col(x) < F.col(y), F.struct(F.col(x).alias("a"), F.col(y).alias("b"))).otherwise(F.struct(F.col(y).alias("a"), F.col(x).alias("b"))).alias("p")


def _across(k: int, percent: int):
    """Links between a group's lesser components (rest) and all of it: estimated first, then by whole sets through an index of the group's shingles."""
    t = percent / 100

    def links(main: bytes, rest: list[tuple], whole: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        ids, n = [x[0] for x in whole], np.array([len(x[2]) for x in whole])
        of_main = np.array([x[1] == main for x in whole])
        sketches = np.stack([registers(x[2]) for x in whole])
        shingles = np.concatenate([x[2] for x in whole])
        owner = np.repeat(np.arange(len(n)), n)[order := np.argsort(shingles, kind="stable")]
        shingles = shingles[order]
        for c, g, s in rest:
            may = (100 * np.minimum(n, len(s)) >= percent * np.maximum(n, len(s))) & np.fromiter((x[1] != g and (o or c < x[0]) for x, o in zip(whole, of_main)), bool, len(n))
            at = np.flatnonzero(may)
            est, used = estimate(registers(s)[None], sketches[at], np.full(len(at), len(s)), n[at])
            at = at[est >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(used, 1))]
            if not len(at):
                continue
            lo, hi = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
            many = hi - lo
            both = np.bincount(owner[np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())], minlength=len(n))[at]
            for d in at[100 * both >= percent * (len(s) + n[at] - both)]:
                yield (c, ids[d]) if c < ids[d] else (ids[d], c)

    def run(key, table: pa.Table) -> pa.Table:
        sets = dict(_sets(table.column("text"), k))
        groups: dict[tuple, tuple[list, list]] = {}
        for r, (main, i, j, c, g, rest) in enumerate(zip(*(table.column(x).to_pylist() for x in ("main", "i", "j", "c", "g", "rest")))):
            groups.setdefault((main, i, j), ([], []))[0 if rest else 1].append((c, g, sets[r]))
        found = [p for (main, _, _), (rest, whole) in groups.items() if rest and whole for p in links(main, rest, whole)]
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    return run


def _apart(shared: DataFrame, label: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of classes that share a band and whose components differ. Bands are put together by the component that has most of their
    classes; its other classes meet all of them, in cells of about CELL_BYTES of text on either side. Only links leave a cell."""
    e = shared.join(label.withColumnRenamed("node", "c"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("g"))
    e = materialize(e, "apart")
    held = e.groupBy("key", "g").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "g")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = e.join(held, "key").select(F.col("main.g").alias("main"), "c", "g").distinct().join(texts.select("c", "bytes"), "c")
    mixed = materialize(mixed, "mixed")
    cut = lambda x: F.greatest(F.lit(1), F.ceil(F.sum(x) / CELL_BYTES)).cast("int")
    sizes = mixed.groupBy("main").agg(cut(F.when(F.col("g") != F.col("main"), F.col("bytes"))).alias("ni"), cut(F.col("bytes")).alias("nj"))
    e = mixed.join(sizes, "main")
    all_of = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    one_of = lambda x: F.pmod(F.xxhash64("c"), F.col(x)).cast("int")
    rest = e.where("g <> main").select("main", "c", "g", F.lit(True).alias("rest"), one_of("ni").alias("i"), all_of("nj").alias("j"), "bytes")
    whole = e.select("main", "c", "g", F.lit(False).alias("rest"), all_of("ni").alias("i"), one_of("nj").alias("j"), "bytes")
    cells = materialize(rest.unionByName(whole), "cells")
    tasks = max(1, math.ceil((cells.agg(F.sum("bytes")).first()[0] or 0) / CELL_BYTES))
    cells = cells.withColumn("cell", F.pmod(F.xxhash64("main", "i", "j"), F.lit(tasks))).join(texts.select("c", "text"), "c")
    return materialize(cells.groupBy("cell").applyInArrow(lean_group(_across(k, percent)), "a binary, b binary").distinct(), "more")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text): its set size, the smallest doc_id that links lead to, and whether that is its own."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(docs.mapInArrow(lean(_rows(k)), "doc_id long, n long, c binary, sketch binary"), "rows")
    classes = materialize(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    keys = classes.select("c", "n", "sketch").mapInArrow(_bands, "c binary, n long, bands array<long>")
    keys = materialize(keys.select("c", "n", F.explode("bands").alias("key")), "bands")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(keys.join(held, "key"), "shared")
    # only texts that share a band are needed from here on: they are dealt by class once, and stored
    texts = docs.select("text").mapInArrow(lean(_texts(k)), "c binary, text string").groupBy("c").agg(F.first("text").alias("text")).join(shared.select("c").distinct(), "c", "left_semi")
    texts = materialize(texts.withColumn("bytes", F.octet_length("text").cast("long")), "texts")
    weight = shared.groupBy("c").agg(F.sum("m").alias("weight"))
    lead = shared.join(weight, "c").groupBy("key").agg(F.max(F.struct("weight", "c", "n")).alias("lead"))
    stars = shared.join(lead, "key").where((F.col("c") != F.col("lead.c")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")))
    stars = materialize(stars.select("c", F.col("lead.c").alias("l")).select(_ordered("c", "l")).select("p.*").distinct(), "stars")
    links = _links(stars, classes, texts, k, percent)
    label = components(links)
    more = _apart(shared, label, texts, k, percent)
    if not more.isEmpty():
        label = components(links.union(more))
    named = materialize(classes.select("c", "first").join(label.withColumnRenamed("node", "c"), "c", "left").select("c", "first", F.coalesce("component", "c").alias("g")), "named")
    least = named.groupBy("g").agg(F.min("first").alias("component_id"))
    out = rows.drop("sketch").join(named.join(least, "g").select("c", "component_id"), "c", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2, 80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS ov FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * ov >= 80 * (a.n_shingles + b.n_shingles - ov)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x),
c AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY ALL)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
