"""Spelling variants: words one edit apart, grouped under their far more frequent neighbour.

Near words are found by sorted-list dynamic programming. Each word scans the sorted words after it with a band
of three edit-matrix diagonals; rows up to the longest common prefix with the word scanned before
are kept, and a row that exceeds one edit skips the whole range of words that share the prefix it stands for.

To deal the list over tasks, two words one edit apart share the first or the last half of the shorter one.
A word therefore takes part in the lists of its halves, as they are and reversed, for its own length and for the
one below; a list longer than LIST is dealt again by halves of what its words don't share yet, until at
most one character is left open, which bounds it by the alphabet. Every pair is reported by one list only.

Defined cases: a null text has no word; a null doc_id counts as an empty text in the hash; repeated rows count
again; words of any length take part, batches are cut by characters; ties go to the word that is least in
code-point order; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .trie import CRC, crc_sql

#: Words of a sorted list that one scan takes; longer lists are dealt again.
LIST = 1024
#: Characters (padded) that one scan holds.
CELLS = 1 << 20
#: How much more frequent a word's form is.
FACTOR = 10
LEAST_LENGTH, LEAST_COUNT = 7, 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typos: int = 31) -> DataFrame:
    """(word, n) of runs of letters, lower-cased where ASCII, of at least so many code points and occurrences; of one run in `typos`, chosen by its document and hash, a code point is gone."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("d", F.translate("run", _UPPER, _LOWER).alias("run")).withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % typos == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


_ROW = ["cls", "side", "a", "b", "below", "w", "n"]


def _lists(words: DataFrame) -> DataFrame:
    """The lists of each word: by the first half, of it or of it reversed, for a shorter word of its own length or of one less."""
    lengths = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= 0)
    e = words.select("word", "n", F.explode(lengths).alias("cls")).select("word", "n", "cls", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    w = F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))
    return e.select("cls", "side", F.floor(F.col("cls") / 2).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(1 << 30).alias("below"), w.alias("w"), "n")


def _keyed(rows: DataFrame) -> DataFrame:
    """A list's key: the length of its shorter words, the direction, and the parts that all of them share."""
    return rows.withColumn("key", F.concat_ws("|", "cls", "side", "a", "b", "below", F.substring(F.col("w"), F.lit(1), F.col("a")), F.right(F.col("w"), F.col("b"))))


def _finer(rows: DataFrame) -> DataFrame:
    """Two lists for one: half of the open part is shared too, before or behind the edit; the second takes what the first doesn't."""
    g = F.floor((F.col("cls") - F.col("a") - F.col("b")) / 2).cast("int")
    way = F.explode(F.array(F.struct((F.col("a") + g).alias("a"), F.col("b").alias("b"), F.col("below").alias("below")), F.struct(F.col("a").alias("a"), (F.col("b") + g).alias("b"), F.least("below", F.col("a") + g).alias("below")))).alias("p")
    return rows.select("cls", "side", "w", "n", way).select("cls", "side", "p.a", "p.b", "p.below", "w", "n")


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows (padding aside: rows of a list differ)."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def near_in_lists(m: np.ndarray, length: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j < end[i], of words one edit apart; rows of m are zero-padded code points, sorted within each list, end is where the word's list ends."""
    n, width = m.shape
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = _common(m[1:], m[:-1])
    # the first word after each that doesn't share t characters with it
    jump = np.empty((width + 2, n + 1), np.int32)
    at = np.arange(n + 1, dtype=np.int32)
    for t in range(width + 2):
        stop = np.where(lcp < t, at, n).astype(np.int32)
        stop[n] = n
        jump[t, :n] = np.minimum.accumulate(stop[::-1])[::-1][1:]
    jump[:, n] = n
    chars = np.zeros((n, width + 3), m.dtype)
    chars[:, 1 : width + 1] = m
    chars, size = chars.ravel(), width + 3
    # rows of the band: distances of t characters of the scanned word to t - 1, t and t + 1 of the scanning one
    band = np.empty((n * (width + 2), 3), np.uint8)
    band[:] = (1, 0, 1)
    band[:: width + 2] = (2, 0, 1)
    q, j = np.arange(n), np.arange(1, n + 1)
    t = lcp[j]
    alive = j < end
    q, j, t = q[alive], j[alive], t[alive]
    left, right = [], []
    while len(q):
        done_t = np.zeros(len(q), np.int64)
        dead = np.zeros(len(q), bool)
        open_ = np.arange(len(q))
        while len(open_):
            qo, jo = q[open_], j[open_]
            over = t[open_] >= length[jo]  # a prefix of a word scanned before
            if over.any():
                o = open_[over]
                done_t[o] = length[j[o]]
                open_ = open_[~over]
                qo, jo = q[open_], j[open_]
                if not len(open_):
                    break
            to = t[open_] + 1
            prev = band[qo * (width + 2) + to - 1]
            c, base, lq = chars[jo * size + to], qo * size + to, length[qo]
            new = np.empty((len(to), 3), np.uint8)
            new[:, 0] = np.minimum(prev[:, 0] + (c != chars[base - 1]), prev[:, 1] + 1)
            new[:, 0][to - 1 > lq] = 2
            new[:, 1] = np.minimum(np.minimum(prev[:, 1] + (c != chars[base]), prev[:, 2] + 1), new[:, 0] + 1)
            new[:, 1][to > lq] = 2
            new[:, 2] = np.minimum(prev[:, 2] + (c != chars[base + 1]), new[:, 1] + 1)
            new[:, 2][to + 1 > lq] = 2
            np.minimum(new, 2, out=new)
            band[qo * (width + 2) + to] = new
            t[open_] = to
            gone = new.min(axis=1) > 1
            full = ~gone & (to == length[jo])
            dead[open_[gone]] = True
            done_t[open_[gone | full]] = to[gone | full]
            open_ = open_[~(gone | full)]
        ended = ~dead
        k = length[q] - done_t + 1
        fits = ended & (k >= 0) & (k <= 2)
        hit = np.flatnonzero(fits)
        hit = hit[band[q[hit] * (width + 2) + done_t[hit], k[hit]] <= 1]
        left.append(q[hit])
        right.append(j[hit])
        j = np.where(dead, jump[done_t, j], j + 1)
        keep = j < end[q]
        q, j, done_t = q[keep], j[keep], done_t[keep]
        t = np.minimum(done_t, lcp[j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


_PAIRS = "u string, v string, nu long, nv long"


def _scan(table: pa.Table) -> pa.RecordBatch:
    """Near pairs of whole lists, each pair by the one list that answers for it."""
    w, cls, n = (table.column(c) for c in ("w", "cls", "n"))
    words = np.array(w.to_pylist(), dtype=str)
    m = words.view(np.uint32).reshape(len(words), -1)
    length = pc.utf8_length(w).to_numpy().astype(np.int64)
    cls, side, below, n = cls.to_numpy(), table.column("side").to_numpy(), table.column("below").to_numpy(), n.to_numpy()
    key = table.column("key").combine_chunks()
    first = np.flatnonzero(np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]))
    end = np.repeat(np.append(first[1:], len(words)), np.diff(np.append(first, len(words))))
    i, j = near_in_lists(m, length, end)
    keep = np.minimum(length[i], length[j]) == cls[i]
    i, j = i[keep], j[keep]
    if len(i):
        keep = _common(m[i], m[j]) < below[i]
        # reversed lists leave to the others what shares its true first half, here the last one
        half, width, back = cls[i] // 2, m.shape[1], np.arange(1, m.shape[1] + 1)
        behind = lambda x: np.take_along_axis(m[x], np.maximum(length[x][:, None] - back, 0), axis=1)
        same = np.where((np.minimum(length[i], length[j])[:, None] >= back) & (back <= half[:, None]), behind(i) == behind(j), back > half[:, None]) if width else keep
        keep &= (side[i] == 0) | ~same.all(axis=1)
        i, j = i[keep], j[keep]
    flip = side[i] == 1
    out = [np.array([x[::-1] if f else x for x, f in zip(words[k].tolist(), flip.tolist())], dtype=object) for k in (i, j)]
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(n[i], pa.int64()), pa.array(n[j], pa.int64())], names=["u", "v", "nu", "nv"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list and word; a scan takes whole lists of about CELLS characters."""
    held, cells = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        while t.num_rows:
            longest = pc.max(pc.utf8_length(t.column("w"))).as_py()
            room = max(1, (CELLS - cells) // (longest + 1))
            held.append(t.slice(0, room))
            cells += held[-1].num_rows * (longest + 1)
            t = t.slice(room)
            if cells >= CELLS:
                whole = pa.concat_tables(held).combine_chunks()
                key = whole.column("key").combine_chunks()
                last = pc.index(pc.equal(key, key[-1]), True).as_py()  # the last list may go on
                if last:
                    yield _scan(whole.slice(0, last))
                held, cells = [whole.slice(last)], (whole.num_rows - last) * (longest + 1)
    if held:
        yield _scan(pa.concat_tables(held).combine_chunks())


def near_words(words: DataFrame, most: int = LIST) -> DataFrame:
    """Pairs (u, v, nu, nv) of words(word, n) that differ by one inserted, deleted or replaced code point, each once."""
    spark = words.sparkSession
    rows, found = _keyed(_lists(words)), []
    while True:
        long = materialize(rows.where("cls - a - b > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("key"), "long-lists")
        more = not long.isEmpty()
        take = rows.join(long, "key", "left_anti") if more else rows
        found.append(take.select("key", *_ROW).repartition("key").sortWithinPartitions("key", "w").select("key", "cls", "side", "below", "w", "n").mapInArrow(_pairs, _PAIRS))
        if not more:
            break
        rows = materialize(_keyed(_finer(rows.join(long, "key", "left_semi"))), "lists")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def variants(words: DataFrame, factor: int = FACTOR, most: int = LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n): the most frequent near word, if it is `factor` times as frequent, and where forms of forms end."""
    pairs = materialize(near_words(words, most), "near")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("m")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("near"), F.col("nu").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    w = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best")).alias("best"))
    w = materialize(w.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n")), "forms")
    # counts grow by `factor` from form to form, so chains are short and doubling ends soon
    root = w.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = materialize(root.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = far.select("word", "root")
        if far.where("moved").isEmpty():
            break
    return w.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(materialize(vocabulary(docs), "words"))


ORACLE = f"""
WITH RECURSIVE {CRC},
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
l AS (SELECT doc_id::VARCHAR || ':' || translate(run, '{_UPPER}', '{_LOWER}') AS s, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM t GROUP BY ALL),
x AS (SELECT s, run, n, hex(encode(s)) AS bytes FROM l),
h AS (SELECT run, n, {crc_sql("list_transform(range(0, len(bytes), 2), lambda i: ('0x' || bytes[i + 1 : i + 2])::BIGINT)")} AS h FROM x, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
d AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, first(near ORDER BY m DESC, near) AS near FROM p GROUP BY ALL),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.at FROM r JOIN f ON f.word = r.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)
"""
