"""Removal of repeated byte strings (suffix-array dedup): every 100-byte string stays only where it first starts.

A window of LENGTH bytes is owned by its anchor: the position of the least-hashed GRAM-byte string
in it (leftmost on ties). Equal windows have equal anchors at equal places, so the windows of a
text fall into runs, one per anchor, and only runs whose anchor gram occurs elsewhere need to be
compared. The suffixes at those anchors are dealt to ranges by their first GRAM bytes, at splitters
taken from a sample of suffixes, and a range to buckets by its grams where a driver couldn't hold a
splitter a bucket. A bucket sorts its suffixes, and what stands before them, by multikey quicksort
on their bytes; windows that agree on both sides of their anchors are equal, and the first of them
stays. A window holds its anchor's whole gram, so splitters part no equal windows.

A gram with more than HEAVY runs (the edge of a passage that a third of all documents share) is cut
by boundaries of its own: each of its runs goes to the parts that the hashes of its windows name.
Equal windows then meet across those boundaries, and what a part finds equal is equal by bytes, so
the parts' findings add up to those of one bucket.

The anchors lose nothing: which position of a window is least depends on its bytes alone, so every
pair of equal windows is compared, at anchors that stand at the same place in both. Grams whose hash
occurs once can't be equal to others; every equality that removes bytes is one of bytes.

Memory and skew: texts are dealt into chunks of about CHUNK bytes; a run that is equal to an
earlier one of its chunk is settled there, so a passage in a third of all documents reaches its
bucket once per chunk.

Defined cases: null text is empty; texts shorter than LENGTH keep all; rows that repeat a doc_id
with another text are ordered by a hash of the text; wholly equal rows are one document and
keep the same bytes; a null doc_id comes last.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import _BYTE, buffers, powers
from .shared import lean_group, lean_groups, mix, pack, small_batches, text_bytes

LENGTH, GRAM = 100, 32
_SPAN = LENGTH - GRAM + 1
CHUNK = 2 << 20
PIECE = 2 << 20
#: Grams in one counting bucket, and text bytes behind one suffix bucket, about.
GRAMS, SUFFIXES = 1 << 20, 8 << 20
#: Documents sampled for splitters at least, suffixes of each, ranges at most, and runs of one gram that a bucket takes, about. They steer balance only.
SPLITTER_DOCS, SPLITTER_EACH, RANGES, HEAVY = 2000, 64, 1 << 16, 1 << 17
_LAST = np.iinfo(np.int64).max
_INVERSE = pow(0x9DDFEA08EB382D69, -1, 1 << 64)
Key = tuple[pa.Scalar, ...]


def _rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of every `length`-byte string (a power of two), by doubling."""
    h, n = _BYTE[data], 1
    while n < length:
        h = mix(h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]) if len(h) > n else h[:0]
        n *= 2
    return h


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, last window, gram hash) of each run; positions are in `data`. At most 16 MB."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < LENGTH:
        return none
    gram = _rolling(data, GRAM)
    key = (gram & ~np.uint64(0xFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    n = 1
    while 2 * n <= _SPAN:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    at = (np.minimum(key[: len(data) - LENGTH + 1], key[_SPAN - n :][: len(data) - LENGTH + 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
    start = np.repeat(offsets[:-1], np.diff(offsets))[: len(at)]
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(at)]
    good = np.flatnonzero(np.arange(len(at)) + LENGTH <= end)
    if not len(good):
        return none
    a, s = at[good], start[good]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])]))
    last = np.append(new[1:], len(good)) - 1
    doc = np.searchsorted(offsets, good[new], "right") - 1
    return doc, a[new], good[new], good[last], gram[a[new]]


def _units(offsets: np.ndarray):
    """Pieces of at most about PIECE bytes: (documents from, to, first byte, last byte). A long document is cut where windows overlap."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1, at + 1))
        if to == at + 1 and offsets[to] - offsets[at] > 2 * PIECE:
            for s in range(int(offsets[at]), int(offsets[to]) - LENGTH + 1, PIECE):
                yield at, to, s, min(int(offsets[to]), s + PIECE + LENGTH - 1)
        else:
            yield at, to, int(offsets[at]), int(offsets[to])
        at = to


def _all_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    out = []
    for a, b, s, e in _units(offsets):
        doc, at, lo, hi, gram = runs(data[s:e], np.clip(offsets[a : b + 1], s, e) - s)
        out.append((doc + a, at + s, lo + s, hi + s, gram))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else runs(data[:0], offsets[:1])


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A chunk's distinct documents in order, their bytes and offsets; the same for every use of the chunk."""
    ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
    order = np.lexsort((table.column("dkey").combine_chunks().to_numpy(zero_copy_only=False), ids))
    table = table.take(pa.array(order))
    data, offsets = buffers(table.column("text"))
    return table, data, offsets


def _twins(table: pa.Table) -> np.ndarray:
    """True where a row repeats the row before it (doc_id and text)."""
    ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
    key = table.column("dkey").combine_chunks().to_numpy(zero_copy_only=False)
    return np.concatenate([[False], (ids[1:] == ids[:-1]) & (key[1:] == key[:-1])])


def _chunk_runs(table: pa.Table):
    table, data, offsets = _ordered(table)
    doc, at, lo, hi, gram = _all_runs(data, offsets)
    twin = _twins(table)
    if twin.any():
        keep = ~twin[doc]
        doc, at, lo, hi, gram = doc[keep], at[keep], lo[keep], hi[keep], gram[keep]
    return table, data, offsets, doc, at, lo, hi, gram


def _content(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A hash of each run: its bytes and where its anchor is."""
    step = np.zeros(len(data) + 1, np.uint64)
    for s in range(0, len(data), PIECE):
        x = data[s : s + PIECE]
        scale = pow(0x9DDFEA08EB382D69, s, 1 << 64)
        step[s + 1 : s + 1 + len(x)] = _BYTE[x] * (powers(PIECE)[: len(x)] * np.uint64(scale))
    total = np.cumsum(step, dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE, np.uint64)]), dtype=np.uint64)
    same = (total[hi + LENGTH] - total[lo]) * back[lo]
    return mix(mix(same ^ gram) + ((hi - lo).astype(np.uint64) << np.uint64(32)) + (at - lo).astype(np.uint64))


def _same_bytes(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes, and the place of the anchor, of another run (false for itself)."""
    same = (other != np.arange(len(lo))) & (hi - lo == (hi - lo)[other]) & (at - lo == (at - lo)[other])
    i = np.flatnonzero(same)
    size = hi[i] - lo[i] + LENGTH
    total = np.concatenate([[0], np.cumsum(size)])
    for a in range(0, len(i), 20_000):
        b = min(len(i), a + 20_000)
        step = np.arange(total[b] - total[a]) - np.repeat(total[a:b] - total[a], size[a:b])
        equal = data[np.repeat(lo[i[a:b]], size[a:b]) + step] == data[np.repeat(lo[other[i[a:b]]], size[a:b]) + step]
        same[i[a:b]] = np.logical_and.reduceat(equal, total[a:b] - total[a])
    return same


def _grams(buckets: int):
    def run(key: Key, table: pa.Table) -> pa.Table:
        gram, n = np.unique(_chunk_runs(table)[-1], return_counts=True)
        b = (mix(gram) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        gram, n, b = gram[order], np.minimum(n[order], 65_535).astype(np.uint16), b[order]
        name, first = np.unique(b, return_index=True)
        cut = lambda x: pa.array([pack(y) for y in np.split(x, first[1:])] if len(name) else [], pa.binary())
        return pa.table({"bucket": pa.array(name, pa.int64()), "chunk": pa.array(np.full(len(name), key[0].as_py()), pa.int64()), "grams": cut(gram), "counts": cut(n)})

    return run


def _repeated(most: int):
    def run(key: Key, table: pa.Table) -> pa.Table:
        """Of each chunk's grams in this bucket, those that another chunk has too; and of these the heavy ones, with the parts that each is cut into."""
        part = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("grams")]
        gram, back, chunks = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        runs_of = np.bincount(back, np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("counts")]), len(gram))
        parts = np.where(chunks > 1, np.ceil(runs_of / most), 0).astype(np.uint64)
        rows: dict[str, list[bytes]] = {"grams": [], "heavy": [], "parts": []}
        for x, i in zip(part, np.split(back, np.cumsum([len(x) for x in part])[:-1])):
            p = parts[i]
            for f, y in zip(rows, (x[p > 0], x[p > 1], p[p > 1])):
                rows[f].append(pack(y))
        return pa.table({"chunk": table.column("chunk"), **{f: pa.array(x, pa.binary()) for f, x in rows.items()}})

    return run


_PACKED = "bucket long, chunk long, ids binary, keys binary, doc binary, at binary, lo binary, size binary, bytes binary, cut_doc binary, cut_lo binary, cut_hi binary"
_FIELDS = [x.split(" ")[0] for x in _PACKED.split(", ")]


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first GRAM bytes of each suffix, as strings in byte order."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(GRAM)]).view(f"S{GRAM}").ravel()


def _gather(data: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all strings, one after another."""
    return data[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())] if len(lo) else data[:0]


def _parts(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray, parts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, bucket) of the parts that heavy runs' windows name, each once: the gram and the hash of a window decide."""
    size, n = hi - lo + LENGTH, hi - lo + 1
    half = _rolling(_gather(data, lo, size), 64)
    run = np.repeat(np.arange(len(lo)), n)
    begin = (np.cumsum(size) - size)[run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]
    part = mix(half[begin] * np.uint64(0x9E3779B97F4A7C15) + half[begin + LENGTH - 64]) % parts[run]
    return tuple(np.unique(np.stack([run, (mix(gram[run] + part) % np.uint64(buckets)).astype(np.int64)]), axis=1))


def _joined(known: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in known.column(column)]) if known.num_rows else np.zeros(0, np.uint64)


def _suffixes(splitters: np.ndarray, buckets: int):
    each = max(1, math.ceil(buckets / (len(splitters) + 1)))  # buckets of a range
    buckets = each * (len(splitters) + 1)

    def run(key: Key, docs: pa.Table, known: pa.Table) -> pa.Table:
        empty = pa.table({f: pa.array([], pa.int64() if f in ("bucket", "chunk") else pa.binary()) for f in _FIELDS})
        if not docs.num_rows:
            return empty
        chunk = key[0].as_py()
        table, data, offsets, doc, at, lo, hi, gram = _chunk_runs(docs)
        if not len(doc):
            return empty
        outside = np.sort(_joined(known, "grams"))
        order = np.argsort(gram, kind="stable")
        twice = np.zeros(len(gram), bool)
        same = gram[order][1:] == gram[order][:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if len(outside):
            twice |= outside[np.minimum(np.searchsorted(outside, gram), len(outside) - 1)] == gram
        doc, at, lo, hi, gram = (x[twice] for x in (doc, at, lo, hi, gram))
        _, first, back = np.unique(_content(data, at, lo, hi, gram), return_index=True, return_inverse=True)
        settled = _same_bytes(data, at, lo, hi, first[back])
        cut = [x[settled] for x in (doc, lo, hi)]
        cut[1:] = [x - offsets[cut[0]] for x in cut[1:]]
        doc, at, lo, hi, gram = (x[~settled] for x in (doc, at, lo, hi, gram))
        ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        keys = table.column("dkey").combine_chunks().to_numpy(zero_copy_only=False)
        bucket = np.searchsorted(splitters, _lead(data, at), "right") * each + (mix(gram) % np.uint64(each)).astype(np.int64)
        heavy, order = _joined(known, "heavy"), np.argsort(_joined(known, "heavy"))
        if len(heavy):
            heavy, parts = heavy[order], _joined(known, "parts")[order]
            nth = np.minimum(np.searchsorted(heavy, gram), len(heavy) - 1)
            light, hot = np.flatnonzero(heavy[nth] != gram), np.flatnonzero(heavy[nth] == gram)
            run, named = _parts(data, lo[hot], hi[hot], gram[hot], parts[nth[hot]], buckets)
            bucket = np.concatenate([bucket[light], named])
            doc, at, lo, hi = (x[np.concatenate([light, hot[run]])] for x in (doc, at, lo, hi))
        own = chunk % buckets
        rows = {f: [] for f in _FIELDS}
        for b in np.union1d(np.unique(bucket), [own] if len(cut[0]) else []).astype(int).tolist():
            i = np.flatnonzero(bucket == b)
            size = hi[i] - lo[i] + LENGTH
            text = _gather(data, lo[i], size)
            c = cut if b == own else [x[:0] for x in cut]
            for f, x in zip(_FIELDS, (b, chunk, pack(ids[doc[i]]), pack(keys[doc[i]]), pack(doc[i].astype(np.int32)), pack((at[i] - lo[i]).astype(np.int32)), pack((lo[i] - offsets[doc[i]]).astype(np.int64)), pack(size.astype(np.int32)), pack(text), pack(c[0].astype(np.int32)), pack(c[1].astype(np.int64)), pack(c[2].astype(np.int64)))):
                rows[f].append(x)
        return pa.table({f: pa.array(x, pa.int64() if f in ("bucket", "chunk") else pa.binary()) for f, x in rows.items()})

    return run


def _words_at(data: np.ndarray, start: np.ndarray, size: np.ndarray, step: int, words: int) -> np.ndarray:
    """8-byte numbers, in byte order, of the strings of `size` bytes that begin at `start` and go on by `step`; zeros follow."""
    out = np.zeros((words, len(start)), np.uint64)
    top = len(data) - 1
    for j in range(8 * words):
        x = data[np.clip(start + step * j, 0, top)].astype(np.uint64)
        out[j // 8] = out[j // 8] << np.uint64(8) | np.where(j < size, x, np.uint64(0))
    return out


def sort_strings(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings given as rows of 8-byte numbers (number x string), and how many leading bytes each shares with the one before it.

    Multikey quicksort with 8-byte characters: all strings are parted by their first number, and groups that tie are parted by the next.
    """
    n = words.shape[1]
    order, common = np.arange(n), np.full(n, 8 * len(words), np.int64)
    common[:1] = 0
    tied = np.arange(n) if n > 1 else np.zeros(0, np.int64)  # places in `order` of groups of two or more
    group = np.zeros(len(tied), np.int64)
    for d, key in enumerate(words):
        if not len(tied):
            break
        inside = np.lexsort((key[order[tied]], group)) if d else np.argsort(key[order[tied]], kind="stable")
        order[tied] = order[tied[inside]]
        k = key[order[tied]]
        part = np.concatenate([[False], (k[1:] != k[:-1]) & (group[1:] == group[:-1])])
        x = k[part] ^ k[np.flatnonzero(part) - 1]
        common[tied[part]] = 8 * d + sum((x < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(1, 8))
        first = part | np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(first)
        stay = np.bincount(group)[group] > 1
        tied, group = tied[stay], group[stay]
    return order, common


def _seen_before(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For every suffix (at `anchor`, in order of place; `left` bytes stand before it and `right` from it on) and each number of bytes a before
    it: whether the window of LENGTH bytes from a bytes before it also occurs at an earlier suffix. Windows with other anchors aren't equal.

    Two windows are equal if a bytes before their anchors and LENGTH - a from them on agree. Suffixes, and what stands before them read
    backwards, are sorted once; strings that share their first bytes are neighbours, so both agreements are numbers read off the shared lengths.
    """
    seen = np.zeros((len(anchor), _SPAN), bool)
    after, shared = sort_strings(_words_at(data, anchor, right, 1, -(-LENGTH // 8)))
    before, shared_back = sort_strings(_words_at(data, anchor - 1, left, -1, -(-(_SPAN - 1) // 8)))
    x, y = np.empty(len(anchor), np.int64), np.empty(len(anchor), np.int64)
    for a in range(_SPAN):
        i = np.flatnonzero((left >= a) & (right >= LENGTH - a))
        if len(i) < 2:
            continue
        x[after] = np.cumsum(shared < LENGTH - a)
        y[before] = np.cumsum(shared_back < a)
        key = x[i] << 32 | y[i]
        seq = np.argsort(key, kind="stable")
        seen[i[seq[1:]], a] = key[seq[1:]] == key[seq[:-1]]
    return seen


def _first_kept(key: Key, table: pa.Table) -> pa.Table:
    """Sorts a bucket's suffixes and gives, by chunk, the ranges of windows that start earlier elsewhere."""
    chunks = table.column("chunk").to_numpy()
    get = lambda f, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(f)]
    parts = {f: get(f, k) for f, k in (("ids", np.int64), ("keys", np.int64), ("doc", np.int32), ("at", np.int32), ("lo", np.int64), ("size", np.int32), ("bytes", np.uint8))}
    chunk = np.repeat(chunks, [len(x) for x in parts["doc"]])
    ids, keys, doc, at, lo, size = (np.concatenate(parts[f]).astype(np.int64) for f in ("ids", "keys", "doc", "at", "lo", "size"))
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    # wholly equal rows in different order of chunks can't meet: they share a doc_id and so a chunk
    order = np.lexsort((lo, keys, ids))
    chunk, doc, at, lo, size, begin = (x[order] for x in (chunk, doc, at, lo, size, begin))
    cuts = {int(c): [[d], [a], [b]] for c, d, a, b in zip(chunks, get("cut_doc", np.int32), get("cut_lo", np.int64), get("cut_hi", np.int64))}
    if len(doc):
        gone = _seen_before(np.concatenate(parts["bytes"]), begin + at, at, size - at)[:, ::-1]  # now by place
        edge = np.zeros((len(doc), 1), bool)
        r, a = np.nonzero(gone & ~np.concatenate([edge, gone[:, :-1]], axis=1))
        _, b = np.nonzero(gone & ~np.concatenate([gone[:, 1:], edge], axis=1))
        a, b = (lo[r] + at[r] - (_SPAN - 1 - x) for x in (a, b))
        for c in np.unique(chunk[r]).tolist():
            i = chunk[r] == c
            x = cuts.setdefault(int(c), [[], [], []])
            for y, z in zip(x, (doc[r][i].astype(np.int32), a[i], b[i])):
                y.append(z)
    names = [c for c, x in cuts.items() if sum(map(len, x[0]))]
    return pa.table({"chunk": pa.array(names, pa.int64()), **{f: pa.array([pack(np.concatenate(cuts[c][i])) for c in names], pa.binary()) for i, f in enumerate(("cut_doc", "cut_lo", "cut_hi"))}})


def _apply(keep: list[str], with_text: bool):
    def run(key: Key, docs: pa.Table, cuts: pa.Table) -> pa.Table:
        table, data, offsets = _ordered(docs)
        get = lambda f, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in cuts.column(f)]) if cuts.num_rows else np.zeros(0, kind)
        doc, a, b = get("cut_doc", np.int32).astype(np.int64), get("cut_lo", np.int64), get("cut_hi", np.int64) + LENGTH
        depth = np.zeros(len(data) + 1, np.int64)
        np.add.at(depth, offsets[doc] + a, 1)
        np.add.at(depth, offsets[doc] + b, -1)
        gone = np.cumsum(depth[:-1]) > 0
        twin = _twins(table)
        rows: dict[str, list] = {x: [] for x in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for d in range(table.num_rows):
            s, e = int(offsets[d]), int(offsets[d + 1])
            if twin[d]:
                for x in rows.values():
                    if x:
                        x.append(x[-1])
                continue
            g = gone[s:e]
            left = data[s:e][~g].tobytes() if g.any() else data[s:e].tobytes()
            rows["n_bytes"].append(e - s)
            rows["n_removed"].append(e - s - len(left))
            rows["n_spans"].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if len(g) else 0)
            rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            if with_text:
                rows["kept"].append(left.decode("utf-8", "ignore"))
        if not with_text:
            rows.pop("kept")
        kinds = {"kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({"doc_id": table.column("doc_id"), **{k: table.column(k) for k in keep}, **{k: pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()}})

    return run


def _splitters(docs: DataFrame, rows: int, ranges: int) -> np.ndarray:
    """Range boundaries: quantiles of the first bytes of a bounded sample of suffixes, in proportion to the ranges."""
    if ranges < 2:
        return np.zeros(0, f"S{GRAM}")

    def leads(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            doc, at, *_ = _all_runs(data, offsets)
            pick = [x[:: max(1, len(x) // SPLITTER_EACH)][:SPLITTER_EACH] for x in np.split(at, np.flatnonzero(np.diff(doc)) + 1) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([pack(_lead(data, x)) for x in pick], pa.binary())], names=["leads"])

    wanted = max(SPLITTER_DOCS, ranges // 4)
    some = docs.select("text").sample(fraction=min(1.0, wanted / max(1, rows)), seed=7).mapInArrow(leads, "leads binary").limit(2 * wanted).collect()
    x = np.sort(np.concatenate([np.zeros(0, f"S{GRAM}"), *(np.frombuffer(r["leads"], f"S{GRAM}") for r in some)]))
    return np.unique(x[np.linspace(0, len(x) - 1, ranges + 1).astype(int)[1:-1]]) if len(x) else x


def cut_repeats(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, *keep, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of docs(doc_id, text, *keep).

    `kept` is the remaining text; a character that lost some of its bytes goes with them.
    """
    keep = keep or []
    rows, size = text_bytes(small_batches(docs))
    chunks = max(1, math.ceil(size / CHUNK))
    buckets = max(1, math.ceil(size / SUFFIXES))
    splitters = _splitters(docs, rows, min(RANGES, buckets))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST)))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep, F.xxhash64("text").alias("dkey"), F.pmod(F.xxhash64(ident), F.lit(chunks)).alias("chunk")).repartition("chunk")
    view = lambda *cols: dealt.select(F.col("chunk").alias("in_chunk"), *(F.col(c).alias(c) for c in ("doc_id", "text", "dkey", *cols)))
    grams = view().groupBy("in_chunk").applyInArrow(lean_group(_grams(max(1, math.ceil(size * 0.03 / GRAMS)))), "bucket long, chunk long, grams binary, counts binary")
    known = grams.groupBy("bucket").applyInArrow(lean_group(_repeated(HEAVY)), "chunk long, grams binary, heavy binary, parts binary")
    packed = view().groupBy("in_chunk").cogroup(known.groupBy("chunk")).applyInArrow(lean_groups(_suffixes(splitters, buckets)), _PACKED)
    cuts = packed.groupBy("bucket").applyInArrow(lean_group(_first_kept), "chunk long, cut_doc binary, cut_lo binary, cut_hi binary")
    kinds = dict(dealt.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + ["kept string"] * with_text)
    return view(*keep).groupBy("in_chunk").cogroup(cuts.groupBy("chunk")).applyInArrow(lean_groups(_apply(keep, with_text)), schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d)),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
i AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g),
j AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR before < p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
m AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM j GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM m GROUP BY doc_id),
f AS (SELECT d.doc_id, x, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
  list_concat([0], coalesce(lb, [])) AS s, list_concat(coalesce(la, []), [length(x) // 2]) AS e FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(s) + 1), lambda q: substr(x, 2 * s[q] + 1, 2 * (e[q] - s[q]))), ''))) AS kept_sha256 FROM f
"""
