"""SentencePiece encoding and decoding by suffix-array matching.

Text is one leading blank and the text, blanks written as the piece alphabet's own sign. Pieces
never reach across a blank's left side or a line feed, so a batch's distinct stretches between
those are encoded once: they are concatenated, the suffixes of that text are ranked by prefix
doubling, every piece of the vocabulary is binary-searched for its range of occurrences, the
occurrences (edges) are sorted by where they end, and relaxed from left to right over all
stretches together.

The model merges by rank, so an edge doesn't compete on a sum of scores: it is relaxed if its piece
can follow the last piece of the text before it, i.e. if merging those two alone gives those two.
Exactly one edge at each place can, and the ids are those of the sentencepiece library. Characters
without a piece become bytes. Runs of blanks before a word are the one case with tied ranks; the few
stretches with such runs are merged one by one.

Defined cases: null and empty texts have no ids and decode to an empty text; the blank sign
itself in a text decodes to a blank; rows that repeat a doc_id are each encoded.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import buffers, pieces
from .shared import lean, mix, pack, small_batches

BLANK = "▁"
#: Longest piece that the suffix ranks tell apart, in characters.
DEPTH = 16
#: Stretches a worker remembers between batches (those of up to LONG characters).
REMEMBER, LONG = 250_000, 48
BATCH = 2 << 20
_STRETCH = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
_PAIRS = 1 << 22


def _packed(part: np.ndarray, low: bool) -> np.ndarray:
    """Four codes as one key; blanks after a piece's end as least or greatest."""
    part = part if low else np.where(part > 0, part, np.uint64(0xFFFF))
    return part[:, 0] << np.uint64(48) | part[:, 1] << np.uint64(32) | part[:, 2] << np.uint64(16) | part[:, 3]


def _bounds(kinds: list[np.ndarray], codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Range of ranks (at 4 << level characters) that begin with each row's codes. No closure: one that calls itself would keep a batch's arrays until garbage is collected."""
    if level == 0:
        return np.searchsorted(kinds[0], _packed(codes, True), "left"), np.searchsorted(kinds[0], _packed(codes, False), "right")
    half = 2 << level
    lo, hi = _bounds(kinds, codes[:, :half], level - 1)
    lo2, hi2 = _bounds(kinds, codes[:, half:], level - 1)
    whole = codes[:, half] > 0
    lo = lo.astype(np.uint64) << np.uint64(32)
    a = np.where(whole, lo | lo2.astype(np.uint64), lo)
    b = np.where(whole, lo | hi2.astype(np.uint64), hi.astype(np.uint64) << np.uint64(32))
    b = np.where(hi > lo >> np.uint64(32), b, a)
    return np.searchsorted(kinds[level], a, "left"), np.searchsorted(kinds[level], b, "left")


class Vocabulary:
    """The pieces of a model file, what each was last merged from, and how suffix ranks find them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int64)
        plain = []
        for i, p in enumerate(self.text):
            if model.is_byte(i):
                b = int(p[3:5], 16)
                self.byte[b] = i
                self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)  # surrogateescape
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text[i] = ""
            else:
                plain.append(i)
        self.unknown = model.unk_id()
        self.number = {self.text[i]: i for i in plain}
        #: Merging order: the better score first, then the lower id.
        self.rank = np.full(n + 1, -1, np.int64)
        self.rank[sorted(plain, key=lambda i: (-model.get_score(i), i))] = np.arange(len(plain))
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        made = []
        for i in plain:
            ids, last = self._merge(self.text[i])
            if ids == [i]:
                made.append(i)
                if last:
                    self.left[i], self.right[i] = last
        made = [i for i in made if not self.text[i].startswith(BLANK * 2)]
        if any(len(self.text[i]) > DEPTH for i in made):
            raise ValueError(f"{path} has pieces of more than {DEPTH} characters")
        split = [i for i in made if self.left[i] != i]
        key = self.left[split].astype(np.int64) << 32 | self.right[split]
        order = np.argsort(key)
        self.pair, self.paired = key[order], self.rank[np.array(split)[order]]
        chars = sorted({c for i in made for c in self.text[i]})
        self.code = np.full(0x110000, len(chars) + 1, np.uint16)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.zeros(len(chars) + 2, bool)
        self.single[[self.code[ord(self.text[i])] for i in made if len(self.text[i]) == 1]] = True
        self.id = np.array(made, np.int64)
        self.length = np.array([len(self.text[i]) for i in made], np.int64)
        self.codes = np.zeros((len(made), DEPTH), np.uint64)
        for j, i in enumerate(made):
            self.codes[j, : self.length[j]] = self.code[[ord(c) for c in self.text[i]]]
        order = np.lexsort(self.codes.T[::-1])  # sorted pieces are searched for faster
        self.id, self.length, self.codes = self.id[order], self.length[order], self.codes[order]
        spelled = [t.replace(BLANK, " ").encode("utf-8", "surrogateescape") for t in self.text]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.cache_key, self.cache_value = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)
        self.known: dict[str, bytes] = {}

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """A short text's ids by merging the best pair again and again (-1 - character where there is no piece), and the last pair merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.number.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.rank[k] < best):
                    best, at = self.rank[k], i
            if best is None:
                break
            last = (self.number.get(parts[at], -1), self.number.get(parts[at + 1], -1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.number.get(p, -1 - ord(p[0])) for p in parts], last

    def _can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can stand after piece a: undoing their merges step by step never meets a pair that would have merged first."""
        a, b = a.copy(), b.copy()
        fine, open_ = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(open_):
            x, y = a[open_], b[open_]
            i = np.minimum(np.searchsorted(self.pair, x << 32 | y), len(self.pair) - 1)
            bad = (self.pair[i] == (x << 32 | y)) & (self.paired[i] < limit[open_])
            fine[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            sx, sy = self.right[x] != x, self.left[y] != y
            undo_a = np.where(rx > ry, sx, sx & ~sy)
            undo_b = ~undo_a & sy
            go = ~bad & (undo_a | undo_b)
            i, j = open_[go & undo_a], open_[go & undo_b]
            limit[i] = self.rank[a[i]]
            a[i] = self.right[a[i]]
            limit[j] = self.rank[b[j]] + 1
            b[j] = self.left[b[j]]
            open_ = open_[go]
        return fine

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = (mix(key.astype(np.uint64)) & np.uint64(_PAIRS - 1)).astype(np.int64)
        out = self.cache_value[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            value = self._can_follow(new >> 32, new & 0xFFFFFFFF)
            out[miss] = value[back]
            self.cache_key[slot[miss]], self.cache_value[slot[miss]] = key[miss], out[miss]
            # two missed keys of one slot: keep key and value of the same one
            again = miss[self.cache_key[slot[miss]] == key[miss]]
            self.cache_value[slot[again]] = out[again]
        return out

    def _edges(self, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of every piece in code[:n]; DEPTH zeros follow."""
        c = code.astype(np.uint64)
        word = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
        orders, kinds, groups = [], [], []
        key, span = word[: n + DEPTH - 4], 4
        while True:
            order = np.argsort(key)
            s = key[order]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            group = np.flatnonzero(first)
            orders.append(order), kinds.append(s[group]), groups.append(np.append(group, len(s)))
            if span == DEPTH:
                break
            rank = np.empty(len(key), np.uint64)
            rank[order] = np.cumsum(first, dtype=np.uint64) - np.uint64(1)
            ahead = np.zeros(len(rank), np.uint64)
            ahead[: len(rank) - span] = rank[span:]
            key, span = rank << np.uint64(32) | ahead, 2 * span
        starts, found = [], []
        for level, (least, most) in enumerate(((1, 4), (5, 8), (9, 16))):
            p = np.flatnonzero((self.length >= least) & (self.length <= most))
            lo, hi = _bounds(kinds, self.codes[p, : 4 << level], level)
            here = hi > lo
            p, a, b = p[here], groups[level][lo[here]], groups[level][hi[here]]
            many = b - a
            place = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(many.sum())
            starts.append(orders[level][place]), found.append(np.repeat(p, many))
        return np.concatenate(starts), np.concatenate(found)

    def _stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of each stretch (none empty), as 32-bit numbers."""
        size = np.array([len(t) for t in texts], np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])  # one zero code after each stretch
        at = np.arange(len(chars)) + np.repeat(np.arange(len(size)), size)
        n = len(chars) + len(size)
        code = np.zeros(n + DEPTH, np.uint16)
        code[at] = self.code[chars]
        start, piece = self._edges(code, n)
        lone = np.flatnonzero(~self.single[code[at]])  # characters without a piece
        label = np.concatenate([self.id[piece], np.full(len(lone), len(self.text))])
        start, length = np.concatenate([start, at[lone]]), np.concatenate([self.length[piece], np.ones(len(lone), np.int64)])
        from_begin = np.zeros(n + DEPTH, np.int64)
        from_begin[at] = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        step = from_begin[start] + length
        order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
        start, label, step = start[order], label[order], step[order]
        end = start + length[order]
        last, back = np.full(n + DEPTH, -1, np.int64), np.zeros(n + DEPTH, np.int64)
        fresh = np.zeros(n + DEPTH, bool)
        fresh[begin] = True
        wild = len(self.text)  # stands for a character without a piece; anything goes beside it
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            before = last[start[a:b]]
            ok = fresh[start[a:b]] | (before == wild) | ((label[a:b] == wild) & (before >= 0))
            rest = np.flatnonzero(~ok & (before >= 0))
            ok[rest] = self._follows(before[rest], label[a:b][rest])
            hit = a + np.flatnonzero(ok)
            last[end[hit]], back[end[hit]] = label[hit], start[hit]
        unit, here = np.arange(len(size)), begin + size
        units, ids = [], []
        while len(unit):
            units.append(unit)
            i = last[here]
            back_here = back[here]
            ids.append(np.where(i == wild, -1 - self._char(chars, at, back_here), i))
            here = back_here
            going = here > begin[unit]
            unit, here = unit[going], here[going]
        units, ids = np.concatenate(units[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(units, kind="stable")
        units, ids = units[order], ids[order].astype(np.int32)
        bounds = np.searchsorted(units, np.arange(len(size) + 1)).tolist()
        raw = ids.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
        for u in np.flatnonzero(np.minimum.reduceat(ids, bounds[:-1]) < 0).tolist():
            out[u] = self._plain(ids[bounds[u] : bounds[u + 1]].tolist())
        return out

    @staticmethod
    def _char(chars: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        return chars[np.minimum(np.searchsorted(at, place), len(chars) - 1)].astype(np.int64)

    def _plain(self, ids: list[int]) -> bytes:
        """Ids with the bytes of characters that have no piece."""
        whole = chain.from_iterable((i,) if i >= 0 else (int(self.byte[b]) if self.byte[b] >= 0 else self.unknown for b in chr(-1 - i).encode("utf-8", "surrogatepass")) for i in ids)
        return pack(np.fromiter(whole, np.int32))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_STRETCH.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBER:
                self.known.clear()
                new = set(chain.from_iterable(split))
            runs = {t for t in new if t[:2] == BLANK * 2}
            self.known.update((t, self._plain(self._merge_run(t))) for t in runs)
            ordered = list(new - runs if runs else new)
            at, size = 0, np.cumsum([len(t) for t in ordered])
            while at < len(ordered):  # batch texts of about a hundred thousand characters
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 17), "right")))
                self.known.update(zip(ordered[at:to], self._stretches(ordered[at:to])))
                at = to
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, s)), np.int32) for s in split]
        for t in [t for t in new if len(t) > LONG]:
            del self.known[t]
        return out

    def _merge_run(self, text: str) -> list[int]:
        """Ids of a stretch that begins with several blanks. All blanks but the last few and the word's start merge among themselves."""
        word = text.lstrip(BLANK)
        if len(word) <= 2 * DEPTH and len(text) <= 6 * DEPTH:
            return self._merge(text)[0]
        # a long word: its own ids tell what the last blank merges with; then only blanks are left
        tail = np.frombuffer(self._stretches([BLANK + word])[0], np.int32).tolist() if word else []
        blanks = len(text) - len(word) - (1 if word else 0)
        if tail and tail[0] == self.number.get(BLANK):
            tail, blanks = tail[1:], blanks + 1
        most = max(len(self.text[i]) for i in self.number.values() if not self.text[i].strip(BLANK))
        head: list[int] = []
        while blanks > 4 * most:
            head += self._merge(BLANK * most)[0]
            blanks -= most
        return head + (self._merge(BLANK * blanks)[0] if blanks else []) + tail

    def decode_bytes(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of several lists of ids as UTF-8, by gathering the pieces' bytes."""
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        many = self.spelled_size[flat]
        ends = np.cumsum(many)
        raw = self.spelled[np.repeat(self.spelled_at[flat] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes([np.asarray(ids)])[0].decode("utf-8", "replace")


_WORKER: dict[str, Vocabulary] = {}


def _encoded(batch: pa.RecordBatch, path: str):
    v = _WORKER.get(path) or _WORKER.setdefault(path, Vocabulary(path))
    text = batch.column("text")
    _, offsets = buffers(text)
    for a, b in pieces(offsets, BATCH):
        texts = text[a:b].to_pylist()
        yield v, a, b, texts, v.encode(texts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of docs(doc_id, text)."""

    def run(batches):
        for batch in batches:
            for _, a, b, _, ids in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of coded(doc_id, ids)."""

    def run(batches):
        for batch in batches:
            v = _WORKER.get(path) or _WORKER.setdefault(path, Vocabulary(path))
            texts = [x.decode("utf-8", "replace") for x in v.decode_bytes([np.asarray(x or [], np.int64) for x in batch.column("ids").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): encoded, and decoded again in the same task."""

    def run(batches):
        for batch in batches:
            for v, a, b, texts, ids in _encoded(batch, path):
                same = [x == (t or "").replace(BLANK, " ").encode() for t, x in zip(texts, v.decode_bytes(ids))]
                crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b].cast(pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
