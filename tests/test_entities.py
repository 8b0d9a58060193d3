"""Snippet functions, page hashes and table helpers on small fixed cases."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import markup, snippets
from lumenaudit.operators import dedup, findings, frontier, report, tables


@pytest.mark.parametrize(
    ("html", "problems"),
    [
        ('<div role="dialog">', ["label missing for role dialog"]),
        ('<div role="dialog" aria-label="x">', []),
        ('<div aria-hidden="yes">', ["aria-hidden can't be yes"]),
        ('<a aria-hidden="true" tabindex="0">', ["hidden element takes focus"]),
        ('<a aria-hidden="true" tabindex="-1">', []),
        ("", []),
    ],
)
def test_aria_problems(spark, html, problems):
    assert spark.range(1).select(snippets.aria_problems(F.lit(html)).alias("p")).first().p == problems


def test_markup_functions(spark):
    row = spark.range(1).select(
        snippets.normal_text(F.lit(" A \n b ")).alias("text"), snippets.normal_text(F.lit(None).cast("string")).alias("none"), snippets.selector_tag(F.lit("DIV#a")).alias("tag"), snippets.selector_tag(F.lit("#a")).alias("no_tag"),
        snippets.markup_tag(F.lit(" <IMG src=x>")).alias("img"), snippets.markup_attribute(F.lit("<img ALT='x y'>"), "alt").alias("alt"), snippets.markup_attribute(F.lit("<img>"), "alt").alias("no_alt"),
    ).first()
    assert tuple(row) == ("a b", "", "div", None, "img", "x y", None)


def test_content_hash(spark):
    pages = spark.createDataFrame([(1, "u1", "<html><body><p>one</p><main><b>two</b></main></body></html>"), (2, "u2", "plain")], "page_id long, url string, html string")
    got = {r.page_id: r.content_hash for r in dedup.content_hash(markup.elements(pages), markup.tokens(pages), pages).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    assert got == {1: sha("b|two"), 2: sha("u2")}


def test_progress_and_labels(spark):
    t = spark.createDataFrame([(1, 200, 50), (2, 0, 0)], "id long, pages_discovered long, pages_tested long")
    assert [(r.discovered, r.tested) for r in report.progress(t, 100).orderBy("id").collect()] == [(100.0, 25.0), (0.0, None)]
    i = spark.createDataFrame([("critical", "rule"), ("odd", None)], "severity string, detected_by string")
    assert [(r.severity_label, r.source_label) for r in report.labelled(i).orderBy("severity").collect()] == [("Critical", "Rule"), ("Notice", None)]


def test_reports_and_selection(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    r = spark.createDataFrame([(1, 5.0), (2, 7.0), (2, 7.0)], "id long, score double")
    assert [tuple(x) for x in tables.report_of(t, r, "id").orderBy("id").collect()] == [(1, 5.0, True), (2, 7.0, False)]
    n = spark.createDataFrame([(1, "discovered", False), (2, "discovered", True), (3, "tested", False)], "id long, status string, is_duplicate boolean")
    assert [x.id for x in frontier.with_status(n, "discovered").collect()] == [1]


def test_stream_duplicates_read_whole_pages(spark, tmp_path):
    """Pages that differ only after a long common head both stay; an exact copy goes, on its own site only."""
    from lumenaudit.plans import entities

    head = "<html><head>" + "x" * 400
    pages = [(1, "http://a.example/1", head + "one"), (2, "http://a.example/2", head + "two"), (3, "http://a.example/3", head + "one"), (4, "http://b.example/1", head + "one")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = entities.QUERIES["w6_stream_duplicates"](spark, str(tmp_path)).collect()
    md5 = lambda end: hashlib.md5((head + end).encode()).hexdigest()
    assert sorted((r.site, r.content_hash) for r in got) == sorted([("a.example", md5("one")), ("a.example", md5("two")), ("b.example", md5("one"))])


def test_boxes_by_each_strategy(spark):
    from lumenaudit.operators import boxes

    box = lambda pos, selector, tag, y, text=None, alt=None, label=None: (pos, selector, tag, text, alt, label, 0, y)
    b = pd.DataFrame(
        [box(0, "p:nth-child(1)", "p", 90, "Hello there"), box(1, "img#logo", "img", 80, alt="Our Logo"), box(2, "img:nth-child(3)", "img", 70, alt="Team"), box(3, "a:nth-child(4)", "a", 10, "More"), box(4, "p:nth-child(1)", "p", 5, "Again"), box(5, "div", "div", 1)],
        columns=["pos", "selector", "tag", "text", "alt", "aria_label", "x", "y"],
    )
    i = pd.DataFrame(
        [(0, "p:nth-child(1)", None), (1, "p:nth-child(1)", None), (2, None, '<img src="x.png" alt=" our  LOGO ">'), (3, "img[alt*='team']", None), (4, "input[name='q']", None), (5, None, None), (6, None, None), (7, None, None)],
        columns=["issue", "element_selector", "element_html"],
    )
    # 0: of two boxes with its selector the last; 1: that one is taken, nothing else fits; the rest by place, as far as boxes go
    frame = lambda df, schema: spark.createDataFrame([(1, *(None if x != x else x for x in r)) for r in df.itertuples(index=False)], "page_id long, " + schema)
    got = boxes.match(frame(i, "issue long, element_selector string, element_html string"), frame(b, "pos int, selector string, tag string, text string, alt string, aria_label string, x int, y int"))
    assert sorted(((r.issue, r.nth, r.box, r.strategy) for r in got.collect()), key=lambda r: r[1]) == [(0, 1, 4, 1), (2, 2, 1, 2), (3, 3, 2, 3), (1, 4, 5, 4), (4, 5, 3, 4), (5, 6, 0, 4)]


def _placed(issues, boxes):
    """(issue, nth, box, strategy) by a plain search over all boxes, for issues (id, selector, tag, alt, label, text, file, hints) and boxes (pos, selector, tag, text, alt, aria_label, x, y)."""
    within = lambda a, b: bool(a and b) and (a in b or b in a)
    last, taken, out, left = {b[1]: b[0] for b in boxes if b[1]}, set(), [], []

    def by_markup(i, b):
        _, _, tag, alt, label, text, file, _ = i
        return tag == b[2] and 1 + 3 * bool(alt and alt == b[4]) + 3 * bool(label and label == b[5]) + 2 * within(text, b[3]) + 2 * bool(file and file in (b[1] or ""))

    def by_selector(i, b):
        tag, alt, name = i[7]
        return tag == b[2] and 1 + 3 * within(alt, b[4]) + 3 * bool(name and "#" + name in (b[1] or ""))

    for i in issues:
        free = [b for b in boxes if b[0] not in taken]
        best = lambda fit: max((b for b in free if fit(i, b) >= 2), key=lambda b: fit(i, b), default=[None])[0]  # noqa: B023, E731
        exact = last.get(i[1]) if i[1] else None
        found = [exact if exact not in taken else None, best(by_markup) if i[2] else None, best(by_selector) if i[7][0] else None]
        strategy = next((n for n, box in enumerate(found) if box is not None), None)
        if strategy is None:
            left.append(i[0])
        else:
            taken.add(found[strategy])
            out.append((i[0], len(out) + 1, found[strategy], strategy + 1))
    rest = sorted((b[7], b[6], b[0]) for b in boxes if b[0] not in taken)
    return out + [(i, len(out) + n + 1, r[2], 4) for n, (i, r) in enumerate(zip(left, rest))]


def test_every_box_of_a_large_page(spark):
    """No page is too large: what a plain search over all its boxes finds, whatever batches its pairs come in."""
    from lumenaudit.operators import boxes

    rng = random.Random(4)
    some = lambda *of: rng.choice(of)
    word = lambda: some(None, "red", "blue", "green", "old blue")
    all_issues, all_boxes, want = [], [], []
    for page, (n_issues, n_boxes) in enumerate([(150, 420), (400, 300), (9, 5), (4, 0), (151, 151)]):
        b = []
        for pos in range(n_boxes):
            tag = some("a", "img", "p")
            b.append((pos, some(None, f"{tag}:nth-child({pos % 180})", f"{tag}#n{pos % 7}", f"{tag}[src='f{pos % 5}.png']"), tag, word(), word(), some(None, None, word()), rng.randrange(9), rng.randrange(99)))
        i = []
        for issue in range(n_issues):
            tag, alt, label, text, file, hint = some("", "a", "img", "p"), word(), some(None, None, word()), word(), some(None, None, "f1.png"), some("a", "img", "p")
            selector, hints = some((None, ("", None, None)), (f"{hint}:nth-child({rng.randrange(200)})", (hint, None, None)), (f"{hint}[alt*='blue']", (hint, "blue", None)), (f"div > {hint}#n3", ("div", None, "n3")), (f"{hint}#n{issue % 9}", (hint, None, f"n{issue % 9}")))
            written = lambda name, value: f' {name}="{value}"' if value else ""
            html = f"<{tag}{written('alt', alt)}{written('aria-label', label)}{written('src', file and 'd/' + file)}>{text or ''}</{tag}>" if tag else None
            i.append((issue, selector, tag, alt, label, text, file, hints))
            all_issues.append((page, issue, selector, html))
        all_boxes += [(page, *x) for x in b]
        want += [(page, *x) for x in _placed(i, b)]
    rng.shuffle(all_issues)
    rng.shuffle(all_boxes)
    issues = spark.createDataFrame(all_issues, "page_id long, issue long, element_selector string, element_html string")
    captured = spark.createDataFrame(all_boxes, "page_id long, pos int, selector string, tag string, text string, alt string, aria_label string, x int, y int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = sorted(tuple(r) for r in boxes.match(issues, captured).select("page_id", "issue", "nth", "box", "strategy").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(want)
    assert {r[4] for r in got} == {1, 2, 3, 4} and max(r[3] for r in got) > 400 and len({r for r in got if r[0] == 1}) == 300


def test_merged_findings(spark):
    rules = spark.createDataFrame([(1, "1.1.1", "A", "major", "img"), (1, "3.1.1", "A", "critical", "")], "page_id long, wcag_criterion string, wcag_level string, severity string, element_selector string")
    found = spark.createDataFrame([(1, s, "1.4.3", "AA", "minor", x) for s, x in (("ai", "p"), ("ai", "img"), ("vision_ai", "p"), ("vision_ai", "img"), ("vision_ai", None), ("vision_ai", "h1"))], "page_id long, detected_by string, wcag_criterion string, wcag_level string, severity string, element_selector string")
    got = findings.merge(rules, found).collect()
    assert sorted((r.detected_by, r.element_selector or "") for r in got) == [("ai", "img"), ("ai", "p"), ("rule", ""), ("rule", "img"), ("vision_ai", ""), ("vision_ai", "h1")]


def test_logs_and_lifecycles_over_several_batches(spark, tmp_path):
    """State goes on from one batch to the next: what is kept and decided is as if all came at once."""
    from lumenaudit.streaming import progress

    kinds = ["signup", "view", "purchase", "error", "click"]
    rows = [(i, f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 3, kinds[i * i % 5], float(i), "{}") for i in range(90)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in range(3):
        table.where(f"event_id >= {30 * part} AND event_id < {30 * part + 30}").coalesce(1).write.parquet(str(tmp_path / f"events{part}.parquet"))
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events*.parquet")
    log = progress.newest(progress.drain(progress.bounded_log(progress.messages(s), 7), "update")).collect()
    assert sorted((r.task_id, r.nth, r.event_id) for r in log) == sorted((u, n + 1, i) for u in range(3) for n, i in enumerate([r[0] for r in rows if r[2] == u][-7:]))
    step = F.when(F.col("event_type").isin("signup", "view"), "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("cancel")
    steps = s.select(F.col("user_id").alias("task_id"), F.col("ts").alias("timestamp"), "event_id", step.alias("step"))
    got = {r.task_id: (r.status, r.refused) for r in progress.newest(progress.drain(progress.lifecycle(steps), "update")).collect()}
    for u in range(3):
        status, refused = "pending", 0
        for r in rows:
            if r[2] == u:
                if r[3] in ("signup", "view"):
                    refused, status = refused + (status == "running"), "running"
                else:
                    status = {"purchase": "completed", "error": "failed", "click": "cancelled"}[r[3]]
        assert got[u] == (status, refused)


def test_heading_summary_of_all_pages(spark):
    from lumenaudit.plans import entities

    pages = spark.createDataFrame([(1, "<h1>a</h1><h2>b</h2>"), (2, "<h2>a</h2><h4>b</h4>"), (3, "<p>none</p>"), (4, "plain")], "page_id long, html string")
    got = sorted(tuple(r) for r in entities.heading_rows(pages, markup.elements(pages)).collect())
    assert got == [(1, True, 2, 0, True), (2, False, 2, 2, False), (3, False, 0, 0, True), (4, False, 0, 0, True)]


def test_heading_problems_in_order(spark):
    from lumenaudit.plans import entities

    pages = spark.createDataFrame([(1, "<h3>a</h3><h5>b</h5><h2>c</h2><h6>d</h6>"), (2, "<h1>a</h1>"), (3, None)], "page_id long, html string")
    got = {r.page_id: r.problems for r in entities.heading_problems(pages, markup.elements(pages)).collect()}
    assert got == {1: ["no h1", "h3 is followed by h5", "h2 is followed by h6"], 2: [], 3: []}


def test_score_colours(spark):
    rows = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (0.0,), (None,)], "score double").select(report.colour(F.col("score")).alias("c"))
    assert [r.c for r in rows.collect()] == ["#52c41a", "#faad14", "#faad14", "#f5222d", None]


def test_signature_counts_landmarks_by_role(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, '<p role="search">x</p>'), (3, "<p role='search'>y</p>")], "page_id long, html string")
    got = {r.page_id: r.signature for r in dedup.signature(markup.elements(pages)).collect()}
    assert got[1] != got[2] == got[3]


def test_last_entries_of_a_type(spark):
    rows = spark.createDataFrame([("t", i, "a" if i % 2 else "b") for i in range(6)], "task string, seq long, type string")
    assert [r.seq for r in tables.last_entries(rows, 2, "task", "seq", "a").orderBy("nth").collect()] == [5, 3]
    assert [r.seq for r in tables.last_entries(rows, 2, "task", "seq").orderBy("nth").collect()] == [5, 4]


def test_dismissals_fall_back_to_those_of_popups(spark):
    """A cookie bar whose one control is a popup's; an alert without a list of its own; controls without an interruption."""
    from lumenaudit.functions import markup
    from lumenaudit.functions import vocab as V
    from lumenaudit.operators import rules

    pages = {1: '<div class="cookie-bar"><a class="btn-close">x</a></div>', 2: '<div role="alert">Saved<a aria-label="Close">x</a></div>', 3: "<button>Accept</button><button>Close</button>", 4: '<div class="cookie-bar"><a class="btn-close">x</a><button>Accept all</button></div>'}
    e = markup.elements(spark.createDataFrame(list(pages.items()), "page_id long, html string"))
    got = spark.sql(rules.render(V.DISMISS_SQL, "spark"), elements=e).collect()
    assert sorted((r.page_id, r.kind, r.selector) for r in got) == [(1, "cookie", "[class*='close']"), (2, "alert", "[aria-label='Close']"), (4, "cookie", "button:has-text('Accept')")]
