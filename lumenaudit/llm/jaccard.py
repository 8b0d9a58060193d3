"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its distinct k-word shingles under one global order: rare shingles
first, by a fixed-size count sketch of all documents. Two documents whose sets reach the
threshold share a shingle among the first few of that order (prefix filter), which gives the
candidate pairs. The order is then cut into FRAGMENTS; each fragment counts the partial overlap of
a pair on its own, and the partial counts are summed per pair.

Skew: equal sets are one class and are never paired. A shingle held by more than SMALL classes
links them by stars (each class with a leader) already in the map task; what those links leave
apart is then paired exactly, but only across components that still differ. The place of the first
common shingle in both orders bounds the overlap, which keeps most edited copies of a text from
being paired with each other.
Partial counting deals pairs over a grid of (hash of a, hash of b), so a much-linked class is
spread over many tasks.

Defined cases: null or blank text has no shingles (n_shingles 0) and links with nothing, its
component is its own doc_id; fewer than k words make one shingle of all words; rows that repeat
a doc_id are separate sets; a null doc_id is never a component's name unless all are null. A class's
text is found by doc_id and text together, so rows without a doc_id, or many with the same, cost
what others do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, pieces, shingle_sets
from .components import components
from .shared import lean, lean_group, lean_groups, materialize, mix, pack, small_batches, text_bytes

SKETCH = 1 << 20
SLICES = 16
SMALL = 32
FRAGMENTS = 4
#: Bytes of shingles that a task passes on at once: a class goes to many cells, so they can be many times the text read.
OUT = 4 << 20
LEADERS = 24
#: Pairs that one task of the partial counting is dealt, about.
CELL = 6000
#: Numbers in the list of needed classes up to which it is broadcast (eight bytes each).
SHIPPED = 1 << 21
#: Tasks that a common shingle's entries are dealt over at first, and entries in a part of them then.
SALTS, PART = 32, 1 << 12
#: Prefix shingles in one posting bucket, about.
POSTINGS = 1 << 20


def _sets(batch: pa.RecordBatch, k: int):
    data, offsets = buffers(batch.column("text"))
    for a, b in pieces(offsets):
        for d, s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k):
            yield a + d, s


def _class(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(s * np.uint64(3) + np.uint64(len(s)))).astype(np.int64))


_SIZES = "doc_id long, n long, c long, h long, slice int, counts binary"


def _sizes(k: int):
    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            c = np.zeros(batch.num_rows, np.int64)
            held, seen = [], 0
            for d, s in _sets(batch, k):
                n[d], c[d] = len(s), _class(s)
                held.append(s & np.uint64(SKETCH - 1))
                seen += len(s)
                if seen > SKETCH:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH)
                    held, seen = [], 0
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(c, mask=n == 0), batch.column("h"), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "c", "h", "slice", "counts"])
        if total.any():
            part = [pack(np.minimum(x, 2**32 - 1).astype(np.uint32)) for x in np.split(total, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(part)], names=["doc_id", "n", "c", "h", "slice", "counts"])

    return run


def _add_slices(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in table.column("counts"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([pack(np.minimum(total, 2**32 - 1).astype(np.uint32))])})


def _prefixes(k: int, percent: int, sketch):
    def run(batches):
        count = sketch.value
        for batch in batches:
            c, n, p = [], [], []
            for _, s in _sets(batch, k):
                most = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, count[s & np.uint64(SKETCH - 1)]))
                c.append(_class(s))
                n.append(len(s))
                p.append(pack(s[order[:most]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.binary())], names=["c", "n", "prefix"])

    return run


def _alike(na, nb, percent: int):
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _may_link(na, nb, ra, rb, percent: int):
    """Whether two sets can still reach the threshold if a shingle is their first common one and ra, rb of theirs are left from it on (order filter)."""
    return _alike(na, nb, percent) & ((100 + percent) * np.minimum(ra, rb) >= percent * (na + nb))


def _stars(c: np.ndarray, n: np.ndarray, r: np.ndarray, percent: int) -> list[np.ndarray]:
    """Rows (a, na, b, nb): members of one posting list with leaders they may be linked with.

    A leader has the fewest rarer shingles before this one: of the edited copies of a text that is the text itself.
    Those that find no leader in LEADERS turns stay for the exact pairing.
    """
    order = np.lexsort((c, n, n - r))
    c, n, r, out = c[order], n[order], r[order], []
    for _ in range(LEADERS):
        if len(c) < 2:
            break
        near = _may_link(n[0], n, r[0], r, percent)
        near[0] = False
        if near.any():
            m = int(near.sum())
            out.append(np.stack([np.full(m, c[0]), np.full(m, n[0]), c[near], n[near]]))
        near[0] = True
        c, n, r = c[~near], n[~near], r[~near]
    return out


def _runs(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(t)))


def _post(percent: int, buckets: int):
    """Packs prefix entries by bucket; a shingle that is common in this batch is linked by stars here, and only its leader goes on."""
    names = ["bucket", "t", "c", "n", "r", "common", "lt", "lc", "ln", "lr", "edges"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("prefix")]
            many = np.array([len(x) for x in p])
            t = np.concatenate(p)
            c = np.repeat(batch.column("c").to_numpy(zero_copy_only=False), many)
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), many)
            r = n - (np.arange(len(t)) - np.repeat(np.cumsum(many) - many, many))
            order = np.argsort(t, kind="stable")
            t, c, n, r = t[order], c[order], n[order], r[order]
            first, size = _runs(t)
            edges, keep = [], np.ones(len(t), bool)
            common = np.zeros(len(t), bool)
            for a, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
                edges += _stars(c[a : a + m], n[a : a + m], r[a : a + m], percent)
                lead = a + int(np.lexsort((c[a : a + m], n[a : a + m], (n - r)[a : a + m]))[0])
                keep[a : a + m] = False
                keep[lead] = common[lead] = True
            lt, lc, ln, lr = t[~keep], c[~keep], n[~keep], r[~keep]
            e = np.concatenate(edges, axis=1).astype(np.int64) if edges else np.zeros((4, 0), np.int64)
            b = (mix(t) % np.uint64(buckets)).astype(np.int64)
            # these are only passed on, so they are dealt by class: a common shingle's list never meets in one bucket
            lb = (mix(lc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            eb = (mix(e[2].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for x in np.unique(np.concatenate([b, lb, eb])):
                i, j = keep & (b == x), lb == x
                rows.append([int(x), pack(t[i]), pack(c[i]), pack(n[i].astype(np.int32)), pack(r[i].astype(np.int32)), pack(common[i]), pack(lt[j]), pack(lc[j]), pack(ln[j].astype(np.int32)), pack(lr[j].astype(np.int32)), pack(e[:, eb == x].T)])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 11))], names=names)

    return run


_CANDIDATES = "kind int, a long, na long, b long, nb long"


def _candidates(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        get = lambda x, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(x)])
        t, c, n, r, common = get("t", np.uint64), get("c", np.int64), get("n", np.int32).astype(np.int64), get("r", np.int32).astype(np.int64), get("common", bool)
        edges = [get("edges", np.int64).reshape(-1, 4).T]
        large = [np.stack([get("lt", np.uint64).astype(np.int64), get("lc", np.int64), get("ln", np.int32).astype(np.int64), get("lr", np.int32).astype(np.int64)])]
        order = np.argsort(t, kind="stable")
        t, c, n, r, common = t[order], c[order], n[order], r[order], common[order]
        first, size = _runs(t)
        big = (size > SMALL) | (np.logical_or.reduceat(common, first) if len(first) else np.zeros(0, bool))
        for a, m in zip(first[big].tolist(), size[big].tolist()):
            edges += _stars(c[a : a + m], n[a : a + m], r[a : a + m], percent)
            large.append(np.stack([t[a : a + m].astype(np.int64), c[a : a + m], n[a : a + m], r[a : a + m]]))
        for m in np.unique(size[~big & (size > 1)]):
            at = first[~big & (size == m)][:, None] + np.arange(m)
            i, j = np.triu_indices(m, 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            fine = _may_link(n[a], n[b], r[a], r[b], percent) & (c[a] != c[b])
            edges.append(np.stack([c[a[fine]], n[a[fine]], c[b[fine]], n[b[fine]]]))
        e = np.concatenate(edges, axis=1).astype(np.int64)
        swap = e[0] > e[2]
        e[:, swap] = e[:, swap][[2, 3, 0, 1]]
        e = np.unique(e[:, e[0] != e[2]], axis=1)
        g = np.concatenate(large, axis=1)
        kind = np.concatenate([np.zeros(e.shape[1], np.int32), np.ones(g.shape[1], np.int32)])
        return pa.table([pa.array(kind), *(pa.array(np.concatenate([x, y])) for x, y in zip(e, (g[0], g[2], g[1], g[3])))], names=["kind", "a", "na", "b", "nb"])

    return run


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=["cell", "fragment", "c", "part"])


def _fragments(k: int, sketch, pivots: np.ndarray):
    """(cell, fragment, class, its shingles in that fragment) for every cell that a text's class is needed in."""

    def run(batches):
        count, sent = sketch.value, set()
        for batch in batches:
            want, cells = batch.column("c").to_pylist(), batch.column("cells")
            rows, held = [], 0
            for d, s in _sets(batch, k):
                if want[d] in sent or _class(s) != want[d]:
                    continue  # the same row again, or a text of the same hash
                sent.add(want[d])
                f = np.searchsorted(pivots, count[s & np.uint64(SKETCH - 1)], "left") * (FRAGMENTS // 2) + (s >> np.uint64(63)).astype(np.int64) % (FRAGMENTS // 2)
                parts = [(x, pack(s[f == x])) for x in np.unique(f).tolist()]
                for cell in cells[d].as_py():
                    rows += [(cell, x, want[d], part) for x, part in parts]
                    held += 8 * len(s)
                    if held > OUT:
                        yield _part_rows(rows)
                        rows, held = [], 0
            if rows:
                yield _part_rows(rows)

    return run


def _overlaps(key, pairs: pa.Table, parts: pa.Table) -> pa.Table:
    held = {c: np.frombuffer(x.as_buffer(), np.uint64) for c, x in zip(parts.column("c").to_pylist(), parts.column("part"))}
    a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    n = [len(np.intersect1d(held[x], held[y], assume_unique=True)) if x in held and y in held else 0 for x, y in zip(a, b)]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _links(pairs: DataFrame, docs: DataFrame, first: DataFrame, k: int, percent: int, sketch, pivots) -> DataFrame:
    """Of the pairs (a, na, b, nb) of classes, those that reach the threshold: partial overlaps by fragment, summed."""
    pairs = materialize(pairs, "pairs")
    grid = max(1, math.ceil(math.sqrt(pairs.count() / CELL)))
    cell = lambda x: F.pmod(F.xxhash64(x), F.lit(grid))
    pairs = pairs.withColumn("cell", cell("a") * grid + cell("b"))
    need = pairs.select("cell", F.col("a").alias("c")).union(pairs.select("cell", F.col("b").alias("c"))).groupBy("c").agg(F.collect_set("cell").alias("cells"))
    ids = materialize(need.join(first, "c").select(F.col("first").alias("id"), "h", "c", "cells"), "needed")
    # a class is in at most 2 * grid cells; the list is shipped whole only where it is short, else dealt with the texts
    ids = F.broadcast(ids) if (ids.agg(F.sum(F.size("cells") + 5)).first()[0] or 0) <= SHIPPED else ids
    texts = docs.withColumn("h2", F.xxhash64("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h2") == F.col("h"))).select("text", "c", "cells")
    parts = texts.mapInArrow(lean(_fragments(k, sketch, pivots)), "cell long, fragment int, c long, part binary")
    spread = pairs.select("cell", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    partial = spread.groupBy("cell", "fragment").cogroup(parts.groupBy("cell", "fragment")).applyInArrow(lean_groups(_overlaps), "a long, b long, n long")
    both = partial.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("both"))
    good = both.join(pairs, ["a", "b"]).where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent)
    return materialize(good.select("a", "b"), "links")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text): its set size and the smallest doc_id it is linked with, over any number of links."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, size = text_bytes(docs)
    rows = materialize(docs.withColumn("h", F.xxhash64("text")).mapInArrow(lean(_sizes(k)), _SIZES), "shingles")
    sketch = np.zeros(SKETCH, np.uint32)
    for r in rows.where("slice is not null").groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect():
        sketch[r["slice"] * (SKETCH // SLICES) :][: SKETCH // SLICES] = np.frombuffer(r["counts"], np.uint32)
    pivots = np.array([np.sort(sketch)[np.searchsorted(np.cumsum(np.sort(sketch), dtype=np.float64), 0.5 * float(sketch.sum(dtype=np.float64)))]]) if sketch.any() else np.zeros(1)
    sketch = spark.sparkContext.broadcast(sketch)
    rows = rows.where("slice is null").select("doc_id", "n", "c", "h")
    # one row of each class: its smallest doc_id, and the hash of a text that has it
    first = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.coalesce(F.min_by("h", "doc_id"), F.min("h")).alias("h"))
    buckets = max(1, math.ceil(size / 6 * (1 - percent / 100) / POSTINGS))
    entries = docs.select("text").mapInArrow(lean(_prefixes(k, percent, sketch)), "c long, n long, prefix binary").groupBy("c").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posted = entries.mapInArrow(lean(_post(percent, buckets)), "bucket long, t binary, c binary, n binary, r binary, common binary, lt binary, lc binary, ln binary, lr binary, edges binary")
    found = materialize(posted.groupBy("bucket").applyInArrow(lean_group(_candidates(percent)), _CANDIDATES), "candidates")
    pairs = found.where("kind = 0").select("a", "na", "b", "nb").distinct()
    links = _links(pairs, docs, first, k, percent, sketch, pivots)
    label = components(links)
    large = found.where("kind = 1").select(F.col("a").alias("t"), F.col("na").alias("n"), F.col("b").alias("c"), F.col("nb").alias("r"))
    if not large.isEmpty():
        more = materialize(_apart(large, label, percent).join(pairs, ["a", "b"], "left_anti"), "apart")
        if not more.isEmpty():
            label = components(links.union(_links(more, docs, first, k, percent, sketch, pivots)))
    label = materialize(label, "labels")
    named = first.join(label, first["c"] == label["node"], "left").select("c", "first", F.coalesce("component", "c").alias("g"))
    least = named.groupBy("g").agg(F.min("first").alias("component_id"))
    named = named.join(least, "g").select("c", "component_id")
    out = rows.drop("h").join(named, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _apart(large: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of classes that share a common shingle and whose components still differ."""
    e = large.distinct().join(label.withColumnRenamed("node", "c"), "c", "left").select("t", "c", "n", "r", F.coalesce("component", "c").alias("g"))
    e = materialize(e, "entries")
    mixed = e.groupBy("t", "g").agg(F.count(F.lit(1)).alias("m")).groupBy("t").agg(F.max_by("g", "m").alias("main"), F.count(F.lit(1)).alias("kinds"), F.ceil(F.sum("m") / PART).cast("int").alias("parts")).where("kinds > 1").drop("kinds")
    # a common shingle's entries are dealt over SALTS tasks, and then over as many parts as it has entries for; its lesser components go to all parts
    salt = F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int").alias("salt")
    e = e.select("*", salt).join(mixed.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["t", "salt"]).drop("salt")
    rest = e.where("g <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = e.select("t", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("r").alias("r2"), F.col("g").alias("g2"), "main", F.pmod(F.xxhash64("c", F.lit(1)), F.col("parts")).cast("int").alias("part"))
    met = rest.drop("main", "parts").join(right, ["t", "part"]).where((F.col("g") != F.col("g2")) & ((F.col("g2") == F.col("main")) | (F.col("c") < F.col("c2"))))
    met = met.where((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.least("r", "r2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent))
    ends = F.when(F.col("c") < F.col("c2"), F.struct(F.col("c").alias("a"), F.col("n").alias("na"), F.col("c2").alias("b"), F.col("n2").alias("nb"))).otherwise(F.struct(F.col("c2").alias("a"), F.col("n2").alias("na"), F.col("c").alias("b"), F.col("n").alias("nb")))
    return met.select(ends.alias("p")).select("p.*").distinct()


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS ov FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * ov >= 90 * (a.n_shingles + b.n_shingles - ov)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.z = e.x)
SELECT n.doc_id, n.n_shingles, (SELECT min(z) FROM r WHERE r.doc_id = n.doc_id) AS component_id FROM n
"""
