"""References, tables stored by task, the frontier, chained duplicates and expiring keys against plain restatements."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import urls
from lumenaudit.operators import components, dedup, findings, frontier, rules, store
from lumenaudit.plans import graphs
from lumenaudit.sources import stored
from lumenaudit.streaming import progress

# The examples of RFC 3986, 5.4, against http://a/b/c/d;p?q.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_references_of_the_rfc(spark):
    import duckdb

    rows = [("http://a/b/c/d;p?q", r, x) for r, x in EXAMPLES.items()] + [("https://h:8/p", "//other/p", "https://other/p"), ("https://h", "x", "https://h/x"), ("http://h/a/f.html?z=1", "?q=1", "http://h/a/f.html?q=1"), ("http://h/a/b", " \n c\t", "http://h/a/c")]
    got = spark.createDataFrame(rows, "base string, ref string, want string").withColumn("got", urls.resolve(F.col("base"), F.col("ref"))).collect()
    assert {(r.base, r.ref): r.got for r in got} == {(b, r): w for b, r, w in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (base VARCHAR, ref VARCHAR, want VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(b, r.strip(), w) for b, r, w in rows])
    assert con.sql(f"SELECT * FROM (SELECT *, {urls.duck_resolve('base', 'ref')} AS got FROM t) WHERE got IS DISTINCT FROM want").fetchall() == []


def test_writing_a_task_leaves_the_others(spark, tmp_path):
    at = str(tmp_path)
    rows = lambda *x: spark.createDataFrame(list(x), "task_id long, url string, rule_id string")
    spark.createDataFrame([("u1", "p1", 1)], "url string, page_id string, task_id long").write.partitionBy("task_id").parquet(f"{at}/pages")
    store.write_issues(rows((1, "u1", "r1"), (1, "u2", "r2"), (3, "u1", "r0")), at)
    store.write_issues(rows((2, "u1", "r3"), (2, "u1", "r4")), at)
    store.write_issues(rows((1, "u2", "r5"), (1, "u3", "r6")), at)  # replaces the issues of task 1; page u2 is found again
    got = {(r.task_id, r.url, r.rule_id, r.page_id) for r in spark.read.parquet(f"{at}/issues").collect()}
    pages = {(r.task_id, r.url): r.page_id for r in spark.read.parquet(f"{at}/pages").collect()}
    assert {x[:3] for x in got} == {(1, "u2", "r5"), (1, "u3", "r6"), (2, "u1", "r3"), (2, "u1", "r4"), (3, "u1", "r0")}
    assert pages[1, "u1"] == "p1" and len(pages) == 5 == spark.read.parquet(f"{at}/pages").count() and all(pages[t, u] == p for t, u, _, p in got)


def test_pages_upserted_by_task(spark, tmp_path):
    at = str(tmp_path / "pages")
    rows = lambda *x: spark.createDataFrame(list(x), "task_id long, url string, status string, depth int")
    store.upsert_pages(rows((1, "a", "old", 1), (1, "b", "old", 2), (2, "a", "old", 3)), at, ["status", "depth"])
    files = {f for f in (tmp_path / "pages" / "task_id=2").iterdir()}
    store.upsert_pages(rows((1, "b", "new", None), (1, "c", "new", 4)), at, ["status", "depth"])
    assert sorted(tuple(r) for r in spark.read.parquet(at).select("task_id", "url", "status", "depth").collect()) == [(1, "a", "old", 1), (1, "b", "new", 2), (1, "c", "new", 4), (2, "a", "old", 3)]
    assert files == {f for f in (tmp_path / "pages" / "task_id=2").iterdir()}


def plain_frontier(seeds, edges, max_depth, max_pages, dup):
    out = {}
    by = defaultdict(list)
    for site, src, dst, score, place in edges:
        by[site, src].append((-score, place, dst))
    for site in {s for s, *_ in seeds}:
        first = {}
        for s, node, place in sorted(seeds, key=lambda x: x[2]):
            if s == site:
                first.setdefault(node, place)
        level = [n for n, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))][:max_pages]
        seen = {n: (0, None, i + 1) for i, n in enumerate(level)}
        for d in range(1, max_depth + 1):
            found = {}
            for n in level:
                if (site, n) not in dup:
                    for _, _, dst in sorted(by[site, n]):
                        if dst not in seen:
                            found.setdefault(dst, n)
            level = list(found)[: max_pages - len(seen)]
            seen |= {n: (d, found[n], len(seen) + i + 1) for i, n in enumerate(level)}
        out |= {(site, n): x for n, x in seen.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_frontier(spark, seed):
    rng = random.Random(seed)
    sites = ["hot", "hot", "hot", "b", "c"]
    edges = list({(s := rng.choice(sites), f"n{rng.randrange(60)}", f"n{rng.randrange(60)}"): (rng.choice([20.0, 50.0, 80.0]), rng.randrange(4)) for _ in range(500)}.items())
    edges = [(*k, *v) for k, v in edges]
    seeds = [(s, f"n{rng.randrange(60)}", i % 3) for i, s in enumerate(["hot", "hot", "hot", "b", "c", "b"])] + [("alone", "x", 0)]
    dup = {(s, f"n{i}") for s in ("hot", "b") for i in range(0, 60, 9)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = frontier.expand(frame(seeds, "site string, node string, place long"), frame(edges, "site string, src string, dst string, score double, place int"), 4, 33, frame(list(dup), "site string, node string"))
    assert {(r.site, r.node): (r.depth, r.parent, r.nth) for r in got.collect()} == plain_frontier(seeds, edges, 4, 33, dup)


def test_missing_ends_become_nodes(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "a", "b"), ("s", "b", "c")], "site string, src string, dst string")
    nodes, once = frontier.graph(edges, spark.createDataFrame([("s", "a", "tested"), ("s", "z", "explored")], "site string, url string, status string"))
    assert sorted(tuple(r) for r in nodes.collect()) == [("s", "a", "tested"), ("s", "b", "discovered"), ("s", "c", "discovered"), ("s", "z", "explored")]
    assert once.count() == 2


def plain_decisions(rows):
    kept, groups, out = {}, defaultdict(list), {}
    for page, site, h, s in sorted(rows):
        g = groups[site, s]
        if (site, h) in kept:
            out[page] = kept[site, h]
        elif len(g) >= dedup.KEPT_PER_TEMPLATE:
            out[page] = g[0]
        else:
            g.append(page)
            kept[site, h] = page
            out[page] = None
    return out


@pytest.mark.parametrize("contents,templates", [(30, 8), (200, 40), (5, 20)])
def test_chained_decisions(spark, contents, templates):
    """Sites whose contents have several signatures, in one large component and in many small ones, beside a site where none chains."""
    rng = random.Random(contents)
    rows = [(i, rng.choice(["a", "a", "b"]), f"h{rng.randrange(contents)}", f"s{rng.randrange(templates)}") for i in range(400)]
    rows += [(1000 + i, "plain", f"h{i % 20}", f"s{i % 20 % 3}") for i in range(60)]
    got = dedup.decide(spark.createDataFrame(rows, "page_id long, site string, content_hash string, signature string")).collect()
    assert {r.page_id: r.original_id for r in got} == plain_decisions(rows)
    assert all(r.is_duplicate == (r.original_id is not None) for r in got)


def test_components_of_random_links(spark):
    rng = random.Random(9)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {x: root(x) for e in links if e[0] != e[1] for x in e}
    assert {r.node: r.component for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()} == want


def test_expired_keys_leave_the_state(spark, tmp_path):
    """A copy within the delay is dropped, in this batch or a later one; a key beyond it is gone from the state, and its next row is new."""
    schema = "k string, at timestamp, n int"
    batches = [[("a", 0, 1), ("b", 1, 2), ("a", 5, 3)], [("a", 8, 4), ("c", 9, 5)], [("d", 120, 6)], [("e", 240, 7)], [("a", 241, 8), ("e", 245, 9)]]
    source = tmp_path / "in"
    out, states = [], []
    q = None
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, n, m) for k, m, n in rows], "k string, n int, m int").select("k", F.timestamp_seconds(1_700_000_000 + F.col("m") * 60).alias("at"), "n").coalesce(1).write.mode("append").parquet(str(source))
        stream = progress.distinct(spark.readStream.schema(schema).parquet(str(source)), ["k"], "at", "10 minutes")
        q = stream.writeStream.foreachBatch(lambda b, _: out.extend(r.n for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert sorted(out) == [1, 2, 5, 6, 7, 8]
    assert states[1] == 3 and states[-1] <= 2


def test_all_severities_and_defaults(spark):
    # What detectors call severities, and how the issue table reads them.
    want = {"critical": "critical", "major": "major", "minor": "minor", "info": "info", "serious": "major", "moderate": "minor", "high": "critical", "low": "minor", "medium": "major", "Serious": "major", "odd": "minor", None: "minor"}
    rows = [(s, None, None, None) for s in want]
    got = findings.normalise(spark.createDataFrame(rows, "severity string, wcag_level string, wcag_criterion string, rule_id string").withColumn("said", F.col("severity"))).collect()
    assert {r.said: r.severity for r in got} == want
    assert {(r.wcag_level, r.wcag_criterion, r.rule_id) for r in got} == {("A", "unknown", "ai-detection")}


def test_a_rule_that_fails_on_a_page_keeps_the_audit(spark):
    """An own rule that raises on page 2 has one info issue there and its issues elsewhere; other rules lose nothing."""
    from lumenaudit.functions import markup
    from lumenaudit.operators import rules

    def check(page):
        for e in page:
            if e["tag"] == "img":
                yield "minor", f"img[src='{e['a_src']}']", e["pos"]
                if e["a_src"] is None:
                    raise ValueError("no source")

    html = {1: '<html lang="en"><body><img src="a" alt="x"><img src="b" alt="y"></body></html>', 2: '<html lang="en"><body><img src="c" alt="x"><img alt="icon"></body></html>', 3: "<html><body></body></html>"}
    pages = spark.createDataFrame(list(html.items()), "page_id long, html string")
    e = markup.elements(pages)
    before = {tuple(r) for r in rules.audit(spark, pages, e).collect()}
    rules.register(rules.Rule("own-image", "1.1.1", "A", "An image", check=check))
    try:
        after = {tuple(r) for r in rules.audit(spark, pages, e).collect()}
    finally:
        rules._OWN.clear()
    own = sorted((r[0], r[4], r[5]) for r in after - before)
    assert before <= after and own == [(1, "minor", "img[src='a']"), (1, "minor", "img[src='b']"), (2, "info", "")]


def test_reports_as_lines_and_quality(spark, tmp_path):
    from lumenaudit.operators import report

    issues = spark.createDataFrame([(1, 10, "r1", 3, "major"), (1, 11, "r2", None, "minor"), (2, 12, "r1", 1, "critical")], "task long, page_id long, rule_id string, pos int, severity string")
    scores = report.scores(issues, spark.createDataFrame([(1,), (1,), (2,), (3,)], "task long"), "task")
    report.export_lines(scores, issues, "task", str(tmp_path / "r"))
    lines = spark.read.text(str(tmp_path / "r")).collect()
    assert sorted((r.task, "score_a" in r.value) for r in lines) == [(1, False), (1, False), (1, True), (2, False), (2, True), (3, True)]
    found = spark.createDataFrame([(1, "r", "a", "rule"), (1, "r", "b", "rule"), (1, "r", "a", "ai"), (1, "r", "a", "ai")], "page_id long, rule_id string, element_selector string, detected_by string")
    labels = spark.createDataFrame([(1, "r", "a"), (2, "r", "a"), (1, "s", "a")], "page_id long, rule_id string, element_selector string")
    runs = spark.createDataFrame([(3, 4, 60), (1, 1, 20)], "pages_tested long, pages_reachable long, seconds long")
    got = {(r.rule_id, r.detected_by): (r.found, r.matched, r.labelled, r.precision, r.recall, r.false_positive_rate, r.page_coverage, r.seconds_per_page) for r in report.quality(found, labels, runs).collect()}
    assert got == {("r", "rule"): (2, 1, 2, 0.5, 0.5, 0.5, 0.8, 20.0), ("r", "ai"): (1, 1, 2, 1.0, 0.5, 0.0, 0.8, 20.0), ("s", "none"): (0, 0, 1, None, 0.0, None, 0.8, 20.0)}


def test_stored_rows_are_not_broadcast_for_their_small_files(spark):
    rows = lambda name: stored.stored(spark.range(600_000).select((F.col("id") / 1000).cast("long").alias("page_id"), F.lit(1).alias("n")), name)
    joined = rows("a").join(rows("b").withColumnRenamed("n", "m"), "page_id")  # some KB of files, 600,000 rows
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_upserted_pages_of_one_url_stay_apart(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame([(i, "http://h/same" if i % 10 == 1 else f"http://h/{i}", "x" * i) for i in range(60)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = graphs.QUERIES["s2_upsert"](spark, str(tmp_path)).select("task_id", "url", "status", "size").collect()
    text = lambda rows: sorted(map(str, map(tuple, rows)))
    assert text(got) == text(con.sql(graphs.ORACLES["s2_upsert"]).fetchall())


def test_own_rules_judge_whole_sorted_pages(spark):
    seen = lambda page: [("minor", ",".join(str(e["pos"]) for e in page), len(page)), ("info", str({type(e["tag"]).__name__ for e in page} | {str(e["a_id"]) for e in page}), page[0]["pos"])]
    e = spark.range(30_000).select((F.col("id") % 3).alias("page_id"), F.col("id").cast("int").alias("pos"), F.lit("p").alias("tag"), F.lit(None).cast("string").alias("a_id"))
    got = rules.run_rule(spark, rules.Rule("own", "1", "A", "t", check=seen), {"elements": e}).collect()
    assert len(got) == 6 and {(r.page_id, r.pos) for r in got} == {(p, n) for p in range(3) for n in (10_000, p)}
    assert all(r.element_selector == (",".join(map(str, range(r.page_id, 30_000, 3))) if r.severity == "minor" else r.element_selector) for r in got)
    assert {r.element_selector for r in got if r.severity == "info"} <= {"{'str', 'None'}", "{'None', 'str'}"}
