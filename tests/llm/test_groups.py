"""HyperMinHash near duplicates, the conversation trie and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import minhash, spelling, trie
from lumenaudit.llm.arrowtext import buffers, shingle_sets

EMPTY = [(None, None), (7, None), (8, ""), (9, " \n\t "), (10, "one"), (10, "one"), (11, "ONE"), (12, "é one"), (None, "é ONE")]


def plain_groups(rows, k, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {}
    for (d, _), g in zip(sets, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(((d, len(s), least.get(g), d == least.get(g)) for (d, s), g in zip(sets, group)), key=key), key


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randrange(1, 4)
    out, base = list(EMPTY), [[word() for _ in range(rng.choice([4, 5, 6, 12, 60, 400]))] for _ in range(40)]
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(w) // 10)):
            w[rng.randrange(len(w))] = word()
        out.append((100 + i, " ".join(w)))
    out += [(None, out[-1][1]), (None, out[-2][1] + " x"), (500, out[-2][1]), (500, "quite other words here")]
    return out + [(600, "long " * 50000 + "tail"), (601, " ".join(f"w{i}" for i in range(60000))), (602, " ".join(f"w{i}" for i in range(60500)))]


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 90)])
def test_near_duplicates(spark, texts, k, percent):
    want, key = plain_groups(texts, k, percent)
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in texts], "doc_id long, text string, n int, c binary")  # names that the operator uses itself
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs, k, percent).collect()), key=key)
    assert got == want


def test_many_edited_copies_of_one_text(spark):
    """A group whose copies differ from each other more than from their text, over small cells."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for _ in range(8):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want, key = plain_groups(rows, 2, 80)
    before, minhash.CELL_BYTES = minhash.CELL_BYTES, 20000
    try:
        got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()), key=key)
    finally:
        minhash.CELL_BYTES = before
    assert got == want


def test_nothing_is_near_in_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2, 80).count() == 0


def test_sketches_estimate_and_band():
    """Estimates lie within the margin that the filter allows, chance agreement is what the correction says, and close sets share a band."""
    rng = np.random.default_rng(3)
    for n in (5, 40, 600, 20000):
        for _ in range(20):
            whole = rng.integers(0, 2**64 - 1, n + n // 9, dtype=np.uint64)
            a, b = whole[:n], whole[len(whole) - n :]
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = minhash.registers(a), minhash.registers(b)
            est, used = minhash.estimate(x[None], y[None], np.array([n]), np.array([n]))
            assert abs(est[0] - j) <= minhash.DEVIATIONS * (j * (1 - j) / used[0]) ** 0.5 + 1e-9
            assert j < 0.8 or (minhash.bands(x) == minhash.bands(y)).any()
    a, b = (np.stack([minhash.registers(rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64)) for _ in range(4000)]) for _ in range(2))
    seen, said = (a == b).mean(), minhash.chance(np.array([3000]), np.array([3000]))[0]
    assert 0.8 * said < seen < 1.2 * said


def test_class_ids_name_sets():
    data, offsets = buffers(pa.array(["a b c a b", "A B c A b", "b c a b a", "a b"]))
    ids = [minhash.class_id(s) for _, s in shingle_sets(data, offsets, 2)]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        new[c] = own.get(base, [])[:h] + v[h:]
    member = defaultdict(set)
    for c, v in new.items():
        for d in range(len(v) + 1):
            member[tuple(v[:d])].add(c)
    out = []
    for p, m in member.items():
        under = [q for q in member if q[: len(p)] == p]
        child = {q for q in under if len(q) == len(p) + 1}
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under)
        saved = sum((len(member[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(new[c]) == len(p))
        out.append((min(m), len(p), min(member[p[:-1]]) if p else None, len(m), len(child), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


@pytest.mark.parametrize("width,chunk", [(8, 4096), (3, 3)])
def test_trie(spark, width, chunk):
    rng = random.Random(width)
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 0, "user", None), (3, 0, "user", None), (23, 5, None, " two  words "), (-25, 1, "user", "below zero"), (-20, 1, "user", "below zero"), (9, 0, "a", "bc"), (10, 0, "ab", "c"), (2002, 0, "user", "gone: no base, shorter than its own opening")]
    for c in range(60):
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "long " * 3000])))
    for c in (100, 101, 102, 300):  # long ones: two share all but the last turn, and one of them is a prefix
        rows += [(c, t, "user", f"turn {t}") for t in range(9 if c == 102 else 12)] + [(c, 31, "user", f"own {c % 2}")] * 2
    rng.shuffle(rows)
    before, trie.CHUNK = trie.CHUNK, chunk
    try:
        convs = spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, words int, id binary")
        got = sorted((tuple(r) for r in trie.trie(*trie.rebuilt(trie.numbered(convs)), width).collect()), key=lambda r: r[:2])
    finally:
        trie.CHUNK = before
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert trie.trie(*trie.rebuilt(trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        close = sorted(((-m, x) for x, m in words.items() if near(w, x)))
        form = close[0] if close and -close[0][0] >= 10 * n else None
        out[w] = (form and form[1], n, len(close), form and -form[0])
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


@pytest.mark.parametrize("most", [1024, 3])
def test_variants(spark, most):
    """Dense words over few letters, of lengths from 1 on, with ties, chains of forms and non-ASCII letters; lists dealt once and again and again."""
    rng = random.Random(most)
    words = {}
    for _ in range(900):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 7, 8, 9])))
        words[w] = rng.choice([1, 2, 20, 20, 200, 2000])
    words |= {"x" * 3000: 5, "x" * 3001: 50, "x" * 1500 + "y" + "x" * 1499: 7, "🙂words": 1, "🙃words": 10}
    got = sorted((tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), most=most).collect()), key=lambda r: r[0])
    assert got == plain_variants(words)


def test_vocabulary(spark):
    rng = random.Random(4)
    rows = [(None, None), (1, ""), (2, "Straße ABCDEFGH×abc éééééééé"), (None, "abcdefgh abcdefgh"), (3, "abcdefgh" * 20000)]
    rows += [(i, " ".join(rng.choice(["Étudiante", "étudiante", "Language", "LANGUAGE", "seven77letters", "sixsix", "sevenup", "abcdefgh"]) for _ in range(40))) for i in range(50)]
    rows += rows[-3:]
    want = defaultdict(int)
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    assert {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()} == want


def test_no_words(spark):
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([(1, None)], "doc_id long, text string"))).count() == 0
