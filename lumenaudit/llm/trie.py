"""Prefix trie of conversations: one node for each distinct sequence of first turns.

A turn's id is the md5 of its role and text, so only ids and word counts are shuffled, never texts. The
turns of a conversation are laid out as WIDTH columns a block, and one ``GROUP BY node, ROLLUP(t1, ..., tW)``
forms all prefixes of a block together; ``grouping_id`` tells their depth. A longer conversation goes on in
the next block under the node that its last block led to. A node is named by its smallest member
and its depth, which no other node shares. A second ROLLUP, over the nodes of a block and from the last block to the
first, sums each subtree. Where a node has one member left, what follows is a chain of its own turns: its
rows are written from the length alone, so the number of blocks follows the longest *shared* prefix.

Skew: a hot prefix is pre-aggregated in the map tasks. The member ids of a node are joined in chunks of
CHUNK ids; SHA-256 is sequential, so one task streams a node's chunks, one at a time.

Defined cases: rows without a conv_id take no part; a null role or text is empty; equal turns of a
conversation are in the order of their ids; rows that repeat are turns of their own; very long texts count
like others; an empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import materialize

#: Turn columns of a block.
WIDTH = 8
#: Range of conversation ids that are joined to one piece of a digest's text.
CHUNK = 4096
#: Conversations that share the opening of their first one, and the most turns of it that they take.
FAMILY, MOST = 20, 3

_WORD = r"[^\x20\x09-\x0D]+"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, id, words) of every turn, numbered from 1 in the order of turn, null first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    t = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id.alias("id"), F.regexp_count(text, F.lit(_WORD)).alias("words"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id"))
    return t.select("conv_id", nth.alias("nth"), "id", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with the first turns of their family's first one in place of as many of their own: turns and members as `trie` takes them."""
    turns = materialize(turns, "turns")
    heads = turns.where((F.col("nth") <= MOST) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "id", "words"))).alias("head"))
    c = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = c.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)).cast("int").alias("h"))
    c = c.join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size("head"), F.lit(0)))).withColumn("m", F.greatest("m", F.lit(0)))
    c = materialize(c.select("conv_id", "h", "m", F.slice("head", F.lit(1), F.col("m")).alias("head"), (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("length")), "members")
    opening = c.select("conv_id", "length", F.posexplode("head").alias("at", "t")).select("conv_id", "length", (F.col("at") + 1).alias("nth"), "t.id", "t.words")
    own = turns.join(c.drop("head"), "conv_id").where("nth > h").select("conv_id", "length", (F.col("m") + F.col("nth") - F.col("h")).alias("nth"), "id", "words")
    return opening.unionByName(own), c.select("conv_id", "length")


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _key(level: Column, width: int) -> Column:
    """What names a prefix of a block: its block's node and the ids of its first turns."""
    ids = [F.when(level >= i, F.col(f"t{i}.id")).otherwise(F.lit(b"")) for i in range(1, width + 1)]
    return F.unhex(F.md5(F.concat(F.encode(F.col("up").cast("string"), "utf-8"), *ids)))


def _rollup(rows: DataFrame, aggregates: str, width: int) -> DataFrame:
    """All prefixes of a block at once, from the block's node (level 0) down; a null turn is no prefix."""
    t = ", ".join(_columns(width))
    out = rows.sparkSession.sql(f"SELECT up, {t}, {width} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY up, ROLLUP({t})", rows=rows)
    return out.withColumn("last", F.get(F.array(*_columns(width)), F.col("level") - 1)).where("level = 0 OR last IS NOT NULL")


def _digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of pieces(conv_id, depth, chunk, ids): each node's pieces in order, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids"))):
                if (conv, depth) == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (conv, depth), hashlib.sha256(ids.encode())
            yield rows(out)
        if node:
            yield rows([(*node, sha.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"conv_id": pa.int64(), "depth": pa.int32(), "ends_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    return pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").select("conv_id", "depth", "ids").mapInArrow(run, "conv_id long, depth int, ends_sha256 string")


def _pieces(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunk, ids): conv_ids of rows in ascending runs of at most CHUNK."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy(*keys, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))


def trie(turns: DataFrame, members: DataFrame, width: int = WIDTH) -> DataFrame:
    """The nodes of turns(conv_id, nth from 1, id, words, length) and members(conv_id, length): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (sum over its subtree of words x (members - 1)), ends_sha256 (of the ids of members that end there)."""
    spark = turns.sparkSession
    names = _columns(width)
    block = turns.groupBy("conv_id", F.floor((F.col("nth") - 1) / width).cast("int").alias("block")).agg(F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("nth", "id", "words"))).alias("t"))
    wide = materialize(block.select("conv_id", "block", "length", *(F.struct(F.get("t", F.lit(i))["id"].alias("id"), F.get("t", F.lit(i))["words"].alias("words")).alias(c) for i, c in enumerate(names))).select("conv_id", "block", "length", *(F.when(F.col(f"{c}.id").isNotNull(), F.col(c)).alias(c) for c in names)).sortWithinPartitions("block"), "blocks")
    members = materialize(members, "members")
    whole = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    rows = wide.where("block = 0").crossJoin(F.broadcast(whole.select(F.col("conv_id").alias("up"))))  # one row
    pieces = [_pieces(members.where("length = 0"), "length").crossJoin(F.broadcast(whole.select("conv_id"))).select("conv_id", F.col("length").alias("depth"), "chunk", "ids")]
    blocks, tails, b = [], [], 0
    while True:
        rows = materialize(rows, "rows")
        found = _rollup(rows, "min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS longest", width).where("level > 0")
        found = found.select("up", *names, "level", (F.col("level") + b * width).alias("depth"), "conv_id", "n_convs", "longest", F.col("last.words").alias("words"), _key(F.col("level"), width).alias("key"), F.when(F.col("level") > 1, _key(F.col("level") - 1, width)).alias("parent"))
        blocks.append(materialize(found, "nodes"))
        nodes, done = blocks[-1].select("key", "conv_id", "depth", "level", "n_convs"), (b + 1) * width
        ends = rows.where(F.col("length") <= done).select("conv_id", _key(F.col("length") - b * width, width).alias("key"))
        pieces.append(_pieces(ends, "key").join(nodes, "key").select("conv_id", "depth", "chunk", "ids"))
        on = rows.where(F.col("length") > done).select("conv_id", _key(F.lit(width), width).alias("key"))
        on = materialize(on.join(nodes.where(F.col("level") == width).select("key", F.col("conv_id").alias("up"), "n_convs"), "key").select("conv_id", "up", "n_convs"), "on")
        later = wide.where(F.col("block") > b)
        tail = later.join(on.where("n_convs = 1").select("conv_id"), "conv_id")
        tails.append(tail.select("conv_id", "length", F.explode(F.sequence(F.col("block") * width + 1, F.least(F.col("length"), (F.col("block") + 1) * width))).alias("depth")))
        b += 1
        on = on.where("n_convs > 1").select("conv_id", "up")
        if on.isEmpty():
            break
        rows = wide.where(F.col("block") == b).join(on, "conv_id")

    out, below = [], None
    for nodes in reversed(blocks):
        chain = (F.col("level") == width) & (F.col("n_convs") == 1) & (F.col("longest") > F.col("depth"))
        n = nodes.withColumn("chain", chain.cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaves", (F.col("longest") == F.col("depth")).cast("long") + F.col("chain"))
        if below is not None:
            under = below.select(F.col("up").alias("conv_id"), F.lit(width).alias("level"), F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves"))
            n = n.join(under, ["conv_id", "level"], "left").withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        sums = materialize(_rollup(n, "sum(saved) AS saved, sum(leaves) AS leaves", width).withColumn("key", _key(F.col("level"), width)), "sums")
        below = sums.where("level = 0").select("up", "saved", "leaves")
        above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
        full = n.select("key", "up", "parent", "conv_id", "depth", "n_convs", "chain").join(above, "parent", "left").join(sums.where("level > 0").select("key", "saved", "leaves"), "key")
        out.append(full.select("conv_id", "depth", F.coalesce("above", "up").alias("parent_conv_id"), "n_convs", "chain", "leaves", "saved"))
    root = whole.join(below, whole["conv_id"] == below["up"], "left").select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("chain"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    nodes = root
    for x in out:
        nodes = nodes.unionByName(x)
    nodes = materialize(nodes, "trie")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", (F.coalesce("children", F.lit(0)) + F.col("chain")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ended = pieces[0]
    for x in pieces[1:]:
        ended = ended.unionByName(x)
    nodes = nodes.join(_digests(ended), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    for x in tails:
        last = F.col("length") == F.col("depth")
        text = F.when(last, F.col("conv_id").cast("string")).otherwise("")
        nodes = nodes.unionByName(x.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("n_convs"), F.when(last, 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), F.sha2(text, 256).alias("ends_sha256")))
    return nodes.select("conv_id", *(F.col(c).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CTE of one row: the table of crc32 by its rule.
CRC = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"


def crc_sql(utf8: str) -> str:
    """crc32 of a list of bytes, with `tab` of CRC in reach."""
    return f"xor(list_reduce(list_prepend(4294967295, {utf8}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = rf"""
WITH {CRC},
t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS nth FROM t),
c AS (SELECT conv_id, {crc_sql("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM n), crc),
r AS (SELECT c.conv_id, 0 AS part, n.nth, id, words FROM c JOIN n ON n.conv_id = c.conv_id - c.conv_id % 20 AND n.nth <= h UNION ALL SELECT c.conv_id, 1, n.nth, id, words FROM c JOIN n ON n.conv_id = c.conv_id AND n.nth > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth)),
q AS (SELECT conv_id, depth, path, words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM q GROUP BY ALL),
x AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM q GROUP BY ALL),
k AS (SELECT a.path, count(b.path) AS n_children FROM x a LEFT JOIN x b ON b.depth = a.depth + 1 AND b.path[: 32 * a.depth] = a.path GROUP BY ALL),
s AS (SELECT a.path, sum(b.saved) AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves FROM x a JOIN x b ON b.depth >= a.depth AND starts_with(b.path, a.path) JOIN k ON k.path = b.path GROUP BY ALL),
d AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM q JOIN e USING (conv_id, depth) GROUP BY ALL)
SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, k.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(d.ids, '')) AS ends_sha256
FROM x JOIN k USING (path) JOIN s USING (path) LEFT JOIN d USING (path) LEFT JOIN x y ON x.depth > 0 AND y.path = x.path[: 32 * (x.depth - 1)] AND y.depth = x.depth - 1
"""
