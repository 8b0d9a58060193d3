"""Each operator against a brute-force restatement, an exact round trip or held-out accuracy, with the defined edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import components, decontaminate, jaccard, langid, lm, quality, spiece, suffix, tokenfile, topk, toxicity

SF = "/root/testdata/sf0.01"
EDGES = [(900, None, 1), (901, "", 2), (902, " \n\t ", 3), (903, "a", 4), (904, "ü🙂 b", 5), (905, "x" * 9000, 6), (905, "x" * 9000, 6)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, c) for d, t, c in rows], "doc_id long, text string, chunk int")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(6)).strip() or "q"
    base = [[word() for _ in range(rng.randrange(5, 80))] for _ in range(30)]
    out = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w), i))
    return out + EDGES


def test_near_duplicates(spark, rows):
    sets = []
    for d, t, _ in rows:
        w = (t or "").lower().split()
        sets.append((d, {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {}
    for (d, _), g in zip(sets, group):
        least[g] = min(d, least.get(g, d))
    want = sorted((d, len(s), least[g]) for (d, s), g in zip(sets, group))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == want


def test_common_shingle_is_dealt_over_buckets():
    """No bucket gathers the classes that hold one common shingle, and none of them is lost."""
    classes, own = np.arange(1, 2001), np.arange(10**6, 10**6 + 2000, dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(classes), pa.array(np.full(2000, 30)), pa.array([np.array([7, x], np.uint64).tobytes() for x in own])], names=["c", "n", "prefix"])
    posted = pa.Table.from_batches(list(jaccard._post(90, 16)([batch])))
    rows = [len(np.frombuffer(x.as_buffer(), np.int64)) for x in posted.column("lc")]
    assert sum(rows) == 1999 and max(rows) < 300
    large = []
    for bucket in posted.column("bucket").unique():
        t = jaccard._candidates(90)((bucket,), posted.filter(pa.compute.equal(posted.column("bucket"), bucket)))
        large += [(a, b) for k, a, b in zip(*(t.column(c).to_pylist() for c in ("kind", "a", "b"))) if k == 1]
    assert sorted(large) == [(7, c) for c in classes.tolist()]


def test_many_edited_copies_make_few_pairs(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(140)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(140)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w), 0))
    got = jaccard.near_duplicates(frame(spark, docs)).groupBy("component_id").count().collect()
    assert max(r["count"] for r in got) > 150


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def brute_cut(rows, n=100):
    seen, out = set(), []
    for d, t in sorted(set((d, t) for d, t, _ in rows), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        mine = set()
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen or w in mine:
                gone[p : p + n] = True
            mine.add(w)
        seen |= mine
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, rows):
    rng = random.Random(2)
    shared = "".join(rng.choice("abc de") for _ in range(400))
    docs = [*rows, *((300 + i, f"{rng.random()} {shared[rng.randrange(100):]} {rng.random()}", 0) for i in range(8)), (400, "aé" * 300, 0)]
    got = suffix.cut_repeats(frame(spark, docs)).distinct().collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(brute_cut(docs))
    assert suffix.cut_repeats(frame(spark, docs)).count() == len(docs)


def test_suffix_dedup_of_heavy_grams(spark, monkeypatch):
    """A passage in all documents, with grams cut into parts, ranges into buckets, and chunks and buckets of a few documents."""
    for name, value in (("HEAVY", 5), ("CHUNK", 1500), ("SUFFIXES", 700), ("RANGES", 6)):
        monkeypatch.setattr(suffix, name, value)
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, ends = text(260), [text(30) for _ in range(4)]
    docs = [(i, f"{text(rng.randrange(150))}{rng.choice(ends)}{passage}{rng.choice(ends)}{text(rng.randrange(150))}", 0) for i in range(120)]
    docs += [(200 + i, "        " * 20 + text(60), 0) for i in range(20)] + [(300, passage[:99], 0), (301, passage[5:105], 0), (302, passage * 3, 0), *EDGES]
    got = suffix.cut_repeats(frame(spark, docs)).distinct().collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(brute_cut(docs))
    data = np.frombuffer((passage + ends[0] + passage).encode(), np.uint8)
    run, bucket = suffix._parts(data, np.array([0, 0, 290]), np.array([20, 40, 310]), np.array([7, 7, 7], np.uint64), np.array([9, 9, 9], np.uint64), 1000)
    named = [set(bucket[run == i].tolist()) for i in range(3)]
    assert 1 < len(named[0]) <= 9 and named[0] == named[2] and named[0] <= named[1]


def test_decontamination(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    edited = items[1][1][:80] + "zz" + items[1][1][81:]
    docs = [(1, text(50) + ". " + items[0][1].upper() + "! " + text(20), 0), (2, text(40) + " " + edited + " " + text(9), 0), (3, text(90), 0), *EDGES]
    got = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items + [(9, None), (10, "")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(1, 0, 0), (2, 1, 2)]


def test_myers_against_table():
    rng = random.Random(6)
    for _ in range(60):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, n))) for n in (9, 25))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        assert decontaminate.myers(p, t)[0] == min(row)


def test_top_k(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(230, 8)).round(1)
    v[50] = v[51] = v[52]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (550, [1.0] * 8)]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(q, q.where("vec_id % 50 = 0")).collect()]
    m = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows if x and len(x) == 8 and None not in x and all(map(np.isfinite, x))}
    want = []
    for i in sorted(x for x in m if x % 50 == 0):
        best = sorted((-int(m[i] @ y), j) for j, y in m.items() if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted(got) == want


def test_top_k_of_repeated_ids(spark):
    """Only the query's own row is left out: rows with its id are candidates, and of equal rows one is the query."""
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-2, 3, 3).astype(float).tolist()) for i in rng.integers(48, 52, 60)] + [(50, [1.0, 0.0, 0.0])] * 9
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    got = sorted(tuple(r) for r in topk.top_k(q, q.where("vec_id % 50 = 0")).collect())
    want = []
    for v in {tuple(x) for i, x in rows if i == 50}:
        others = list(rows)
        others.remove((50, list(v)))
        best = sorted((-int(np.dot(256 * np.array(v), 256 * np.array(x))), i) for i, x in others)[:5]
        want += [(50, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)
    two = topk.quantised(spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.5, 0.0]), (1, [0.1, 0.0])], "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in topk.top_k(two, two.where("vec_id = 50")).collect()) == [(50, 1, 50, 32768), (50, 1, 50, 32768), (50, 2, 1, 3200), (50, 2, 1, 6400)]


def test_texts_without_ids_are_looked_up_once(spark):
    """Pairs of edited copies, none with a doc_id or all with one: each text finds itself, not all others."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 80)) for _ in range(150)]
    texts += [t + " more" for t in texts] + texts[:20]
    for ids in (lambda i: None, lambda i: 7):
        docs = spark.createDataFrame([(ids(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
        got = jaccard.near_duplicates(docs, 3, 90).collect()
        assert len(got) == len(texts) and sorted(r["n_shingles"] for r in got) == [78] * 170 + [79] * 150
        assert {r["component_id"] for r in got} == {ids(0)}


def test_token_files(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenfile.write_tokens(frame(spark, rows), path, f"file://{tmp_path}/t")
    t = Tokenizer.from_file(path)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfile.token_digest(spark, f"file://{tmp_path}/t").collect()]
    want, start = [], 0
    for d, x, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got) == sorted(want)
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], np.uint64)
    control, data = tokenfile.encode_ranks(values)
    assert (tokenfile.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)) == values).all()


def _token_ids(texts: list[str | bytes | None]) -> list[list[int]]:
    import public_tokenizers

    text = pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), text], names=["file", "doc_id", "text"])
    got = tokenfile._encoded(public_tokenizers.path("word_bpe_49k.json"), 2)([batch])
    return [np.frombuffer(x.as_buffer(), f"<u{w}").tolist() for b in got for x, w in zip(b.column("ids"), b.column("width").to_pylist())]


def test_token_ids_of_odd_texts_match_the_library(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = "a b S t re VE ll m d l r e x9 12 é É ß Ä Ÿ ŉ ǅ Ƀ Ⱥ Ⱦ ɏ İ ı × ÷ ª º ² ³ ½ ¡ ¿ « » § \u00ad \u00a0 \u0085 \u0301 ' ' ' '' 's 'LL . , !! - _ < | <| <|endoftext|> |> \t \r \x1c \x7f \x00 \u2019 \u2028 ж 漢字 😀 Σ ς \u212a".split(" ")
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice([*some, " ", " ", "\n"], rng.integers(0, 30))) for _ in range(3000)]
    texts += ["'s", "s", "'", "s", "<", "|endoftext|>", "é", "'r", "e", " ", "\n\n", "", None, "don't WE'LL I'M they've 'really ''s 's's x'²"]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    for remember, encode in ((tokenfile.REMEMBER, tokenfile.ENCODE), (50, 2000)):
        monkeypatch.setattr(tokenfile, "REMEMBER", remember)
        monkeypatch.setattr(tokenfile, "ENCODE", encode)
        monkeypatch.setattr(tokenfile, "_WORKER", {})
        assert _token_ids(texts) == want
    broken = [b"caf\xc3 \xa9 x\xc3\xa9\xa9 \xe2\x80", b"\xa9 \xe2\x80\xc3\xa9 \xff", b"A\xc3", b"\x89B"]
    want = [[*t.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, 2] for x in broken]
    assert _token_ids(broken) == want


def test_token_ids_take_no_step_a_word(monkeypatch):
    """Words that are met once are cut and looked up by whole arrays, not one by one."""
    import sys

    monkeypatch.setattr(tokenfile, "_WORKER", {})
    _token_ids(["to load the tokenizer"])
    rng = np.random.default_rng(6)
    stems = ["".join(map(chr, 97 + rng.integers(0, 26, 7))) for _ in range(5000)]
    text = " ".join(f"{x}{y}" for y in (".", ",", "'s", "é", "-It") for x in stems)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        _token_ids([text])
    finally:
        sys.setprofile(None)
    assert calls < 25_000 / 4


def test_pieces_match_the_library(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spiece.model_path())
    docs = [*rows, (906, "a  b   c\n\n   d " + " " * 40 + "e", 0), (907, "12,34... <s> </s> [UNK] naïve Ω≈ç\x00\t", 0)]
    coded = spiece.encode(frame(spark, docs), spiece.model_path())
    text = {d: t or "" for d, t, _ in docs}
    assert all(list(r["ids"]) == sp.encode(text[r["doc_id"]]) for r in coded.collect())
    assert all(r["text"] == text[r["doc_id"]] for r in spiece.decode(coded, spiece.model_path()).collect())


def test_classifiers_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for op, column, least in ((quality.op7_quality, "quality", 0.95), (toxicity.op8_toxicity, "toxic", 0.9)):
        got = op(spark, SF)
        assert got.count() == docs.count()
        r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col(column)).cast("int")).alias("right")).first()
        assert r["right"] >= least
    got = langid.op6_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_classifier_edges(spark):
    docs = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, y int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.where("doc_id > 902").withColumn("lang", F.lit("xx")))).collect()}
    assert got[900] == got[901] == got[902] == "und" and got[903] == "xx"


def test_toxic_folding():
    assert toxicity.fold("You 1D10T!") == " you idiot "
    assert toxicity.fold("ѕсum") == " scum "
    lex = toxicity.Lexicon({"tras": 2.0}, np.array([1.0, 0.0, -1.0]))
    assert lex.found(toxicity.fold("a trash can"))[0] == 0 and lex.found(toxicity.fold("you tr4sh"))[0] == 2.0


def test_lm_scores(spark):
    docs = spark.createDataFrame([(i, ("good day to you " if i % 2 else "junk junk spam ham ") * 20, bool(i % 2)) for i in range(20)] + [(900, None, False), (901, "", False)], "doc_id long, text string, target boolean")
    got = {r["doc_id"]: r for r in lm.score(docs, lm.train(docs)).collect()}
    assert all(got[i]["score"] > 0 for i in range(1, 20, 2)) and all(got[i]["score"] < 0 for i in range(0, 20, 2))
    assert got[900]["n_tokens"] == 0 and got[901]["score"] == 0.0


@pytest.mark.parametrize(("chunk", "bucket"), [(1, 50), (300, 7), (8 << 20, 1 << 21)])
def test_lm_counts_rare_words_and_bigrams(spark, monkeypatch, chunk, bucket):
    """Losses by plain counting, however texts and keys are dealt."""
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    rng = np.random.default_rng(7)
    rows = [(i % 50, " ".join(f"W{int(w)}" for w in rng.zipf(1.4, int(rng.integers(0, 30)))), i % 3 == 0) for i in range(60)] + [(900, None, False), (901, " ", True), (902, "once", True)]
    texts = [((t or "").lower().split(), target) for _, t, target in rows]
    vocabulary = {w for t, _ in texts for w in t}
    losses = []
    for of in ([t for t, _ in texts], [t for t, target in texts if target]):
        one, two, context = Counter(w for t in of for w in t), Counter(p for t in of for p in zip(t, t[1:])), Counter(v for t in of for v in t[:-1])
        single = lambda w: (one[w] + lm.ADD) / (one.total() + lm.ADD * (len(vocabulary) + 1))  # noqa: B023, E731
        p = lambda v, w: lm.MIX * two[v, w] / context[v] + (1 - lm.MIX) * single(w) if context[v] else single(w)  # noqa: B023, E731
        losses.append([-sum(np.log(p(v, w)) for v, w in zip([None, *t], t)) / max(1, len(t)) for t, _ in texts])
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean").repartition(3)
    got = sorted((r["doc_id"], r["n_tokens"], r["loss_background"], r["loss_target"], r["score"]) for r in lm.score(docs, lm.train(docs)).collect())
    want = sorted((i, len(t), a, b, a - b) for (i, *_), (t, _), a, b in zip(rows, texts, *losses))
    assert np.allclose(np.array(got, float), np.array(want, float), rtol=0, atol=1e-9)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, chunk int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.near_duplicates(docs).count() == suffix.cut_repeats(docs).count() == decontaminate.contaminated(docs, items).count() == 0
    assert spiece.digest(docs, spiece.model_path()).count() == 0
    v = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(v, v).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, SF)
        assert new.columns == docs.columns
        path = corpus_pipeline.table_path(spark, "test")
        new.write.parquet(path)
        kept = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count() and last.where("NOT round_trip").count() == 0


def test_lm_target_set_by_ids(spark):
    """A target set given by ids scores as one given by flags; null ids are in neither, null rows and repeated rows stay."""
    rows = [(i % 9 if i % 7 else None, f"w{i % 4} w{i % 3} w{i % 5}" if i % 11 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(1,), (2,), (2,), (None,), (77,)], "doc_id long")
    flagged = docs.withColumn("target", F.coalesce(F.col("doc_id").isin(1, 2), F.lit(False)))
    got = [sorted(map(str, lm.score(d, lm.train(d, g), g).collect())) for d, g in ((docs, good), (flagged, None))]
    assert got[0] == got[1] and len(got[0]) == 60


def test_lm_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs, lm.train(docs, docs), docs).count() == 0


def test_sorted_strings():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 3, 40, dtype=np.uint8)) for _ in range(300)]
    texts += [t[:24] + b"\x02" * 16 for t in texts[:100]] + texts[:50]
    words = np.frombuffer(b"".join(texts), ">u8").reshape(len(texts), 5).T.astype(np.uint64)
    order, common = suffix.sort_strings(words)
    got = [texts[i] for i in order]
    assert got == sorted(texts)
    shared = lambda x, y: next((i for i in range(40) if x[i] != y[i]), 40)
    assert common.tolist() == [0, *(shared(x, y) for x, y in zip(got, got[1:]))]


def test_decontamination_against_all_alignments(spark):
    """Every (document, item) within the budget, by the full table of edit distances; nulls, repeats and clean texts included."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 9, 20])))) for i in range(6)] + [(6, ""), (7, None)]
    docs = [(900, None), (901, ""), (902, " \n ")]
    for d in range(40):
        t = list(rng.choice(items[:6])[1])
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
        docs.append((d % 30, " ".join([word(), "".join(t), word()] if d % 5 else [word() for _ in range(30)])))

    def least(p, t):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for j, x in enumerate(p):
                new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
            row = new
            best = min(best, row[-1])
        return best

    want = []
    for d, t in docs:
        for i, item in items:
            p = decontaminate.normal(item)
            if p and t and (x := least(p, decontaminate.normal(t))) <= decontaminate.budget(len(p)):
                want.append((d, i, x))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == sorted(want) and want


def test_quality_densities():
    """Scores by plain inverses and determinants of the shrunk covariances."""
    rng = np.random.default_rng(4)
    x = {0: rng.normal(size=(60, 13)), 1: rng.normal(1, 2, size=(40, 13))}
    ones = {c: np.column_stack([np.ones(len(v)), v]) for c, v in x.items()}
    model = quality.Model({c: v.T @ v for c, v in ones.items()})
    every = np.concatenate([x[0], x[1]])
    log = []
    for c in (0, 1):
        cov = np.cov(x[c].T, bias=True)
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * np.diag(np.diag(cov)) + np.diag(0.02 * every.var(0) + 1e-6)
        away = every - x[c].mean(0)
        log.append(np.log(len(x[c]) / 100) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.score(every), 1 / (1 + np.exp(log[0] - log[1])))


def test_lexicon_hits_by_plain_search():
    rng = random.Random(8)
    weights = {"trash": 2.0, "trashc": 3.5, "idiot": 1.5, "scum": 1.0}
    lexicon = toxicity.Lexicon(weights)
    for _ in range(300):
        text = toxicity.fold(" ".join(rng.choice(["trash", "can", "idiots", "proof", "pond", "scum", "idiot", "ok", "trashcan"]) for _ in range(rng.randrange(12))))
        spared = [(a, a + len(e) + 2) for e in toxicity.EXCEPTIONS for a in range(len(text)) if text.startswith(f" {e} ", a)]
        want = sum(max(found) for a in range(len(text)) if (found := [x for w, x in weights.items() if text.startswith(" " + w, a)]) and not any(s <= a < e - 1 for s, e in spared))
        assert lexicon.found(text) == (pytest.approx(want), len(text.split()))


def test_many_exception_phrases_take_no_time():
    import time

    text = toxicity.fold("trash can " * 40_000)
    began = time.process_time()
    assert toxicity.Lexicon({"trash": 1.0}).found(text)[0] == 0
    assert time.process_time() - began < 5


def test_held_out_of_null_ids(spark):
    from lumenaudit.llm.labelled import fold

    assert spark.createDataFrame([(None,)], "doc_id long").select(fold("doc_id", 5)).first()[0] == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_tables(spark, rows, empty):
    """Null ids and texts, blanks, long and repeated rows, columns with the names that the stages use themselves: columns stay, each stage gives rows of its input."""
    import corpus_pipeline

    docs = spark.createDataFrame([] if empty else [(d, t, "en", "s", len(t or ""), 1, 2, "x") for d, t, _ in [*rows, (None, "no id here", 0), (None, None, 0), (7, "long " * 40_000, 0)]], "doc_id long, text string, lang string, source string, n_chars long, chunk int, dkey long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, "/root/testdata/sf0.001")
        if name == corpus_pipeline.STAGES[-1][0]:
            assert new.count() == docs.count()
            break
        assert new.columns == docs.columns
        path = corpus_pipeline.table_path(spark, "test")
        new.write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.count() <= docs.count()
        assert kept.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        docs = kept


def test_empty_tables_of_learned_operators(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, y int")
    assert quality.score(docs, quality.fit(docs, labels)).count() == toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert langid.predict(docs, langid.fit(docs)).count() == 0
    path = "file://" + __import__("tempfile").mkdtemp()
    import public_tokenizers

    tokenfile.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), path + "/t")
    assert tokenfile.token_digest(spark, path + "/t").count() == 0
