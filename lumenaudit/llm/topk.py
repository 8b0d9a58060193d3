"""Exact top-k search: tiles of queries x vectors, partial selection in a tile, lists merged in a tree.

Vectors are dealt by hash into shards of about TILE components and queries into blocks of as many;
a tile is one shard with one block, so a task holds a bounded matrix whatever the table's size. A
vector goes once to each block, as the narrowest numbers that hold all components.
Each tile keeps k + 1 candidates per query, the query's own row among them; lists are merged MERGE
at a time, and the own row goes at the end. No list is cut before it is exact.

Defined cases: vectors that are null, empty or hold null/NaN/infinite components take no part;
vectors of different lengths aren't compared; ties go to the smaller vec_id. Rows that repeat a
vec_id are rows of their own: each is a candidate, for the others too, and each gives a list under
that query_id. Rows equal in id and vector are one query, whose own row is one of them and whose
candidates are the rest. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components in a shard and in a block of queries, lists merged at a time, and scores held at once.
TILE, MERGE, SCORES = 4 << 20, 32, 1 << 22


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component, for usable vectors."""
    # A null or non-finite component is left out here, and the length then tells.
    good = F.filter("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & (F.size(good) == F.size("embedding")))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(t: pa.Table, ids: str, values: str) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column(values).combine_chunks()
    ids = t.column(ids).combine_chunks().to_numpy(zero_copy_only=False)
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _tile(k: int):
    out = pa.schema([("query_id", pa.int64()), ("qkey", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_()), ("part", pa.int64())])

    def run(key, queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return out.empty_table()
        part = key[1].as_py()
        qid, q = _matrix(queries, "query_id", "q")
        qkey = queries.column("qkey").combine_chunks().to_numpy(zero_copy_only=False)
        vid, v = _matrix(shard, "vec_id", "v")
        q, v = q.astype(np.int64), v.astype(np.int64)
        order = np.argsort(vid, kind="stable")
        vid, v = vid[order], v[order]
        bits = max(1, int(len(vid)).bit_length())
        bound = float(np.abs(q).max(initial=1)) * float(np.abs(v).max(initial=1)) * q.shape[1]
        exact = bound < 2.0 ** min(53, 62 - bits)  # float64 products and packed keys are exact
        vt = v.T.astype(np.float64) if exact else v.T
        down = np.arange(len(vid))[::-1]  # smaller vec_id: larger
        n = min(k + 1, len(vid))
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        step = max(1, SCORES // len(vid))
        for a in range(0, len(qid), step):
            ids = qid[a : a + step]
            if exact:
                s = (q[a : a + step].astype(np.float64) @ vt).astype(np.int64)
                rank = (s << bits) | down
                pick = np.argpartition(rank, len(vid) - n, axis=1)[:, len(vid) - n :].ravel()
            else:
                s = q[a : a + step] @ vt
                pick = np.concatenate([np.lexsort((vid, -x))[:n] for x in s])
            i = np.repeat(np.arange(len(ids)), n)
            own = vid[pick] == ids[i]
            own[own] = (v[pick[own]] == q[a : a + step][i[own]]).all(axis=1)
            for c, x in zip(cols, (ids[i], qkey[a : a + step][i], vid[pick], s[i, pick], own)):
                c.append(x)
        return pa.table([*(pa.array(np.concatenate(c)) for c in cols), pa.array(np.full(sum(map(len, cols[0])), part))], schema=out)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best vectors by inner product; both tables (vec_id, v array<long>). A query's own row is one with its id and its vector."""
    ends = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("most")).first()
    all_, some = ends(vectors), ends(queries)
    rows = max(256, TILE // max(1, all_["dim"] or 1))
    shards, blocks = max(1, math.ceil(all_["n"] / rows)), max(1, math.ceil(some["n"] / rows))
    far = max(abs(x or 0) for e in (all_, some) for x in (e["least"], e["most"]))
    kind = "array<smallint>" if far < 1 << 15 else "array<int>" if far < 1 << 31 else "array<bigint>"
    size = F.size("v").alias("dim")
    v = vectors.select("vec_id", F.col("v").cast(kind).alias("v"), size, F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.lit(shards)).cast("long").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))
    q = queries.dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), F.col("v").cast(kind).alias("q"), size, F.xxhash64("v").alias("qkey"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("long").alias("block"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    got = q.groupBy("dim", "shard", "block").cogroup(v.groupBy("dim", "shard", "block")).applyInArrow(_tile(k), "query_id long, qkey long, vec_id long, score long, own boolean, part long")
    of = Window.partitionBy("query_id", "qkey")
    best = lambda *more: Window.partitionBy("query_id", "qkey", *more).orderBy(F.desc("score"), "vec_id", F.desc("own"))
    while shards > MERGE:
        shards = math.ceil(shards / MERGE)
        got = got.withColumn("part", F.floor(F.col("part") / MERGE)).withColumn("rank", F.row_number().over(best("part"))).where(F.col("rank") <= k + 1).drop("rank")
    got = got.withColumn("rank", F.row_number().over(best())).withColumn("mine", F.coalesce(F.min(F.when(F.col("own"), F.col("rank"))).over(of), F.lit(k + 2)))
    got = got.where(F.col("rank") != F.col("mine")).withColumn("rank", F.col("rank") - (F.col("rank") > F.col("mine")).cast("int"))
    return got.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
v AS (SELECT *, row_number() OVER (PARTITION BY vec_id, v) AS nth FROM u),
s AS (
  SELECT q.vec_id AS query_id, q.v AS qv, v.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * v.v[i]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.nth = 1 AND len(q.v) = len(v.v) AND NOT (v.nth = 1 AND v.vec_id = q.vec_id AND v.v = q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
