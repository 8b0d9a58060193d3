"""Token-ID output: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

Documents are dealt by doc_id into files of about FILE bytes of text, ascending within and between
files. A file is a row of the table written: its ids are ranked by their frequency in it, a rank
takes one to four bytes, and the byte counts (two bits a rank) stand apart in control bytes. It
holds its rank table, its documents' lengths and both streams, so each file decodes alone, by
table lookups in numpy. The table is Parquet, as only Spark's writers reach every kind of store.

Defined cases: null and empty texts are documents of one id (the end id); rows that repeat a
doc_id stay apart, in the order of their text; a null doc_id comes last; an empty table gives
no files and no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import buffers, pieces
from .shared import lean, lean_group, pack, small_batches, table_path, text_bytes

FILE = 8 << 20
END = 2
#: Text encoded at once (bytes), and units a worker remembers (and ids, eight times as many) before it forgets those that it hasn't met for longest; results don't depend on them.
ENCODE, REMEMBER = 4 << 20, 300_000
#: Files whose sizes are added up in one task.
BLOCK = 4096
#: Documents sampled for the edges of a file, and up to how many of all no sampling is done.
SAMPLED, UNSAMPLED = 64, 1 << 20
_LAST = np.iinfo(np.int64).max
Key = tuple[pa.Scalar, ...]

_SIZES = np.array([[(c >> (2 * j) & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers: four two-bit sizes a control byte, then little-endian bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers again, by table lookup of the control bytes."""
    size = _SIZES[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at -= size
    out = np.zeros(n, np.uint32)
    for j in range(4):
        i = np.flatnonzero(size > j) if j else slice(None)
        if j and not len(i):
            break
        out[i] |= data[at[i] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


#: Kinds of bytes: white space that parts stretches, letters, digits, what is neither, and what the vectorised steps leave to the library.
_GAP, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[32, 10]] = _GAP
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Words:
    """Ids of text by the tokenizers library, remembered within a worker for each of its units.

    Only the space and the line feed part stretches: every tokenizer that drops white space gives a
    text's ids as those of its stretches, one after another. Where the tokenizer lower-cases and
    first splits by _SPLIT (`splits`), a Latin stretch's ids are in turn those of its parts, so parts
    are the units; another stretch is one unit. Texts are cut into units by whole arrays of bytes.
    New parts are encoded many at a time, as one text; tokens that end a part carry the vocabulary's
    end mark, and where there aren't as many of them as parts, the parts are encoded one by one.
    """

    #: Characters that no normal form changes, that lower-case one to one, and aren't white space.
    _LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]+")
    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, end: int):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        said = json.dumps([made.get("normalizer"), made.get("pre_tokenizer")])
        mark = made["model"].get("end_of_word_suffix")
        self.splits = bool(mark) and json.dumps(self._SPLIT) in said and '"Lowercase"' in said
        vocabulary = self.tokenizer.get_vocab()
        top = max(*vocabulary.values(), end)
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        #: Kinds and small letters of the characters of two bytes.
        self.kinds, self.small = np.full(0x800, _ODD, np.uint8), np.arange(0x800, dtype=np.uint16)
        for c in filter(self._LATIN.fullmatch, map(chr, range(0x80, 0x800))):
            self.kinds[ord(c)] = _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _OTHER
            self.small[ord(c)] = ord(c.lower())
        #: Units by their place in the order of learning; their ids one after another, where each one's start, how many they are, and when they were last asked for. The end id is the empty unit's.
        self.known: dict[bytes, int] = {b"": 0}
        self.flat = np.array([end], np.uint16 if top < 1 << 16 else np.uint32)
        self.at, self.size, self.last, self.turn = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.int64), 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.flat.dtype) for a in range(0, len(texts), 200) for e in self.tokenizer.encode_batch_fast(texts[a : a + 200], add_special_tokens=False)]

    def _learn(self, parts: list[bytes], stretches: list[bytes]) -> None:
        ids, sizes = [], []
        chunks = [parts[a : a + 100] for a in range(0, len(parts), 100)]
        for chunk, got in zip(chunks, self._encode([b" ".join(c).decode() for c in chunks])):
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(chunk) and cuts[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                some = self._encode([p.decode() for p in chunk])
                ids += some
                sizes.append(np.array([len(x) for x in some]))
        some = self._encode([w.decode("utf-8", "replace") for w in stretches])
        size = np.concatenate([*sizes, np.array([len(x) for x in some], np.int64)])
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, *ids, *some])
        self.size = np.concatenate([self.size, size])
        self.last = np.concatenate([self.last, np.zeros(len(size), np.int64)])
        n = len(self.known)
        self.known.update(zip(parts, range(n, n + len(parts))))
        self.known.update(zip(stretches, range(n + len(parts), n + len(size))))

    def _forget(self) -> None:
        """Keeps the units that were asked for last, within half of what may be remembered."""
        latest = np.argsort(-self.last, kind="stable")[: REMEMBER // 2]
        keep = np.zeros(len(self.last), bool)
        keep[latest[np.cumsum(self.size[latest]) <= 4 * REMEMBER]] = keep[0] = True
        units = [u for u, k in zip(self.known, keep.tolist()) if k]
        self.known = dict(zip(units, range(len(units))))
        self.flat = self.flat[np.repeat(keep, self.size)]
        self.size, self.last = self.size[keep], self.last[keep]
        self.at = np.cumsum(self.size) - self.size

    def look_up(self, units: list[bytes], odd: bool) -> np.ndarray:
        """Places of the (distinct) units. odd: some may be whole stretches."""
        if len(self.known) > REMEMBER or len(self.flat) > 8 * REMEMBER:
            self._forget()
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [units[i] for i in missing.tolist()]
            if odd or not self.splits:
                part = np.array([self.splits and b"<|" not in u and bool(self._LATIN.fullmatch(u.decode("utf-8", "replace"))) for u in new])
                missing = np.concatenate([missing[part], missing[~part]])
                new, rest = [units[i] for i in missing[: part.sum()].tolist()], [units[i] for i in missing[part.sum() :].tolist()]
            else:
                rest = []
            place[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self._learn(new, rest)
        self.turn += 1
        self.last[place] = self.last[0] = self.turn
        return place

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """The text with small letters where they make no difference, which bytes belong to a unit and which begin one, and whether some units are whole stretches."""
        n = len(data)
        raw = bytearray(data)
        text, kind = np.frombuffer(raw.translate(_LOWER.tobytes()), np.uint8), np.frombuffer(raw.translate(_KIND.tobytes()), np.uint8)
        doc = np.zeros(n + 1, bool)
        doc[offsets] = True
        doc = doc[:-1]
        begin = np.ones(n, bool)
        high = np.flatnonzero(data >= 0x80)
        first = high[:-1][np.diff(high) == 1]
        first = first[(data[first] >= 0xC2) & (data[first] < 0xE0) & (data[first + 1] < 0xC0) & ~doc[first + 1]]
        code = (data[first] & 31).astype(np.uint16) << 6 | data[first + 1] & 63
        kind[first] = kind[first + 1] = self.kinds[code]
        text[first], text[first + 1] = 0xC0 | self.small[code] >> 6, 0x80 | self.small[code] & 63
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin |= kind == _DIGIT
        begin[first + 1] = False
        solid = kind != _GAP
        begin |= doc
        begin &= solid
        # 's, 't, 'm, 'd, 're, 've and 'll, where the apostrophe begins a part, end one after their letters
        mark = np.flatnonzero(data == 39)
        mark = mark[begin[mark] & (mark + 1 < n)]
        mark = mark[~doc[mark + 1]]
        then = np.minimum(mark + 2, n - 1)
        a, b = text[mark + 1], np.where((mark + 2 < n) & ~doc[then], text[then], 0)
        short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        begin[mark[short | long] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[long] + 3])
        after = after[after < n]
        begin[after[kind[after] == _LETTER]] = True
        odd = kind == _ODD if self.splits else solid.copy()
        pipe = np.flatnonzero(data == 124)
        pipe = pipe[pipe > 0]
        odd[pipe[(data[pipe - 1] == 60) & ~doc[pipe]]] = True
        if not odd.any():
            return text, solid, begin, False
        stretch = solid.copy()
        stretch[1:] &= ~solid[:-1] | doc[1:]
        start = np.flatnonzero(stretch)
        whole = np.logical_or.reduceat(odd, start)
        inside = np.zeros(n, bool)
        inside[start[0] :] = np.repeat(whole, np.diff(start, append=n))
        begin &= ~inside
        begin[start[whole]] = True
        return np.where(inside, data, text), solid, begin, True

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, each with the end id, and how many each has."""
        text, solid, begin, odd = self._units(data, offsets)
        starts = np.flatnonzero(begin)
        place = np.cumsum(solid, dtype=np.int32)
        edges = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(text[solid])]).dictionary_encode()
        place = np.append(self.look_up(units.dictionary.to_numpy(zero_copy_only=False).tolist(), odd), 0)
        many = np.diff(np.searchsorted(starts, offsets))
        # the end id is one more unit after each document's last
        each = np.insert(units.indices.to_numpy(), np.cumsum(many), len(place) - 1)
        long = self.size[place][each]
        ends = np.cumsum(long)
        kind = np.int32 if max(len(self.flat), ends[-1]) < 1 << 31 else np.int64
        at = np.repeat((self.at[place][each] - (ends - long)).astype(kind), long)
        at += np.arange(len(at), dtype=kind)
        last = np.cumsum(many + 1)
        return self.flat[at], np.add.reduceat(long, last - many - 1)


_WORKER: dict[tuple[str, int], _Words] = {}


def _encoded(path: str, end: int):
    def run(batches):
        words = _WORKER.get((path, end)) or _WORKER.setdefault((path, end), _Words(path, end))
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in pieces(offsets, ENCODE):
                ids, many = words.ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                width = ids.dtype.itemsize
                edges = (width * np.concatenate([[0], np.cumsum(many)])).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("file")[a:b], batch.column("doc_id")[a:b], pa.array(np.full(b - a, width), pa.int32()), packed], names=["file", "doc_id", "width", "ids"])

    return run


def _write(key: Key, table: pa.Table) -> pa.Table:
    doc = table.column("doc_id").to_pylist()
    raw = [x.as_py() for x in table.column("ids")]
    width = table.column("width").to_pylist()
    order = sorted(range(len(doc)), key=lambda i: (_LAST if doc[i] is None else doc[i], doc[i] is None, raw[i]))
    ids = [np.frombuffer(raw[i], np.uint16 if width[i] == 2 else np.uint32) for i in order]
    flat = np.concatenate(ids)
    count = np.bincount(flat)
    ranked = np.lexsort((np.arange(len(count)), -count))[: np.count_nonzero(count)]
    rank = np.zeros(len(count), np.uint32)
    rank[ranked] = np.arange(len(ranked))
    control, data = encode_ranks(rank[flat])
    one = lambda x: pa.array([x], pa.binary())
    return pa.table(
        {
            "file": pa.array([key[0].as_py()], pa.int64()),
            "n_ids": pa.array([len(flat)], pa.int64()),
            "doc_ids": pa.array([[doc[i] for i in order]], pa.list_(pa.int64())),
            "lengths": one(pack(np.array([len(x) for x in ids], np.int64))),
            "ranked": one(pack(ranked.astype(np.uint32))),
            "control": one(control),
            "data": one(data),
        }
    )


_FILE = "file long, n_ids long, doc_ids array<long>, lengths binary, ranked binary, control binary, data binary"


def _edges(docs: DataFrame, rows: int, files: int) -> np.ndarray:
    """First doc_ids of all files but the first, about FILE bytes of text apart; they come to the driver, eight bytes a file.

    A sample of the documents is sorted by range; each range is cut on its own by the text it stands for. They steer balance only.
    """
    share = min(1.0, max(SAMPLED * files, UNSAMPLED) / max(1, rows))
    some = docs.select(F.coalesce("doc_id", F.lit(int(_LAST))).alias("d"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
    some = some.sample(fraction=share, seed=11) if share < 1 else some

    def cut(batches):
        full = None
        for batch in batches:
            d, size = batch.column("d").to_numpy(), batch.column("b").to_numpy() / share
            # bytes before each document in its file's count; the first document of a range begins a file
            total = np.cumsum(size) + (FILE if full is None else full)
            name = np.floor_divide(total - size, FILE)
            first = np.flatnonzero(np.concatenate([[full is None or name[0] > full // FILE], name[1:] > name[:-1]])) if len(d) else np.zeros(0, int)
            full = total[-1] - size[-1] if len(d) else full
            yield pa.RecordBatch.from_arrays([pa.array(d[first])], names=["d"])

    ranges = max(1, math.ceil(files / 64))
    got = some.repartitionByRange(ranges, "d").sortWithinPartitions("d").mapInArrow(cut, "d long").toArrow()
    return np.unique(got.column("d").to_numpy())[1:]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = END) -> None:
    """Writes docs(doc_id, text) as token files under `path`, a folder that all executors reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, size = text_bytes(small_batches(docs))
    files = max(1, math.ceil(size / FILE))
    at = docs.sparkSession.sparkContext.broadcast(_edges(docs, rows, files) if files > 1 else np.zeros(0, np.int64))

    def dealt(batches):
        for batch in batches:
            doc = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(at.value, doc, "right"), pa.int64()), batch.column("doc_id"), batch.column("text")], names=["file", "doc_id", "text"])

    def both(batches):
        yield from _encoded(tokenizer, end)(dealt(batches))

    coded = docs.mapInArrow(lean(both), "file long, doc_id long, width int, ids binary")
    coded.groupBy("file").applyInArrow(lean_group(_write), _FILE).write.parquet(path)


def _read(key_start):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda f, kind: np.frombuffer(batch.column(f)[i].as_buffer(), kind)  # noqa: B023, E731
                n = batch.column("n_ids")[i].as_py()
                ids = get("ranked", np.uint32)[decode_ranks(get("control", np.uint8), get("data", np.uint8), n)].astype("<u4")
                length = get("lengths", np.int64)
                ends = np.cumsum(length)
                first = key_start(batch, i)
                for a in range(0, len(length), 2000):
                    b = min(a + 2000, len(length))
                    yield batch.column("doc_ids")[i].values.slice(a, b - a), first + (ends - length)[a:b], length[a:b], [ids[ends[j] - length[j] : ends[j]] for j in range(a, b)]

    return run


def _with_starts(files: DataFrame) -> DataFrame:
    """Files with the number of ids before each: sums within blocks of files, and over the blocks."""
    size = files.select("file", "n_ids", F.floor(F.col("file") / BLOCK).alias("block"))
    before = lambda *by: Window.partitionBy(*by).orderBy("block", *(["file"] if by else [])).rowsBetween(Window.unboundedPreceding, -1)
    # one row a block of files, so one task has few rows
    blocks = size.groupBy("block").agg(F.sum("n_ids").alias("n")).select("block", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("base"))
    own = size.withColumn("own", F.coalesce(F.sum("n_ids").over(before("block")), F.lit(0))).join(blocks, "block")
    return files.join(own.select("file", (F.col("own") + F.col("base")).alias("first")), "file")


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files under `path`."""

    def run(batches):
        for doc, start, _, ids in _read(lambda b, i: b.column("first")[i].as_py())(batches):
            yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _with_starts(spark.read.parquet(path)).mapInArrow(run, "doc_id long, start long, ids array<long>")


def token_digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under `path`."""

    def run(batches):
        for doc, start, n, ids in _read(lambda b, i: b.column("first")[i].as_py())(batches):
            yield pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(n), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_starts(spark.read.parquet(path)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_ids(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = table_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, path)
    return token_digest(spark, path)
