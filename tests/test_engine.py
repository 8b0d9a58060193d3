"""Golden micro-pages for the rules, and the sequential decisions against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from lumenaudit.functions import markup
from lumenaudit.operators import dedup, frontier, rules

# rule -> (markup that breaks it, markup that doesn't)
CASES = {
    "img-alt-quality": ('<img alt="photo">', '<img alt="Team at work">'),
    "tabindex-positive": ('<div tabindex="3">x</div>', '<div tabindex="0">x</div>'),
    "duplicate-id": ('<p id="d">a</p><p id="d">b</p>', '<p id="d">a</p><p id="e">b</p>'),
    "button-name": ("<button></button>", "<button>Send</button>"),
    "no-autoplay": ("<video autoplay></video>", "<video autoplay muted></video>"),
    "area-alt": ('<area href="/a">', '<area href="/a" alt="North">'),
    "aria-roles": ('<div role="bogus">x</div>', '<div role="button">x</div>'),
    "aria-valid-attr": ('<div aria-foo="1">x</div>', '<div aria-busy="true">x</div>'),
    "aria-hidden-focus": ('<div aria-hidden="true"><a href="/h">x</a></div>', '<div aria-hidden="true"><a href="/h" tabindex="-1">x</a></div>'),
    "aria-required-attr": ('<div role="checkbox">x</div>', '<div role="checkbox" aria-checked="true">x</div>'),
    "aria-required-children": ('<div role="list"></div>', '<div role="list"><div role="listitem">x</div></div>'),
    "aria-required-parent": ('<div role="tab">x</div>', '<div role="tablist"><div role="tab">x</div></div>'),
    "frame-title": ("<iframe></iframe>", '<iframe title="Map"></iframe>'),
    "nested-interactive": ('<a href="/n"><button>Go</button></a>', '<a href="/n">Go</a>'),
    "svg-img-alt": ('<svg role="img"></svg>', '<svg role="img"><title>Logo</title></svg>'),
    "td-headers-attr": ('<table><tr><td headers="zz">1</td></tr></table>', '<table><tr><th id="zz">A</th><td headers="zz">1</td></tr></table>'),
    "th-has-data-cells": ("<table><tr><th>A</th></tr></table>", "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"),
    "video-caption": ("<video></video>", '<video><track kind="captions"></video>'),
    "lang-parts-valid": ('<span lang="qq">x</span>', '<span lang="fr-CA">x</span>'),
    "avoid-inline-spacing": ('<p style="line-height:1 !important">x</p>', '<p style="line-height:1">x</p>'),
    "form-label": ('<form><input type="text" name="q" aria-label=""></form>', '<form><input type="text" name="q" aria-label="Query"></form>'),
    "heading-order": ("<h1>a</h1><h3>b</h3>", "<h1>a</h1><h2>b</h2>"),
    "landmark-structure": ("<nav>x</nav>", "<nav>x</nav><main>y</main>"),
    "link-text": ('<a href="/x"></a>', '<a href="/x"><img src="i.png" alt="Report"></a>'),
    "page-title": ("<title>Untitled</title>", "<title>Annual report</title>"),
    "label-in-name": ('<button aria-label="go">Search</button>', '<button aria-label="Search the site">Search</button>'),
    "form-required-indicator": ("<form><input type='text' name='q' required aria-label=''></form>", '<form><label for="i">Q</label><input id="i" type="text" required></form>'),
    "aria-allowed-attr": ('<div role="img" aria-checked="true">x</div>', '<div role="img" aria-label="x">x</div>'),
    "aria-valid-attr-value": ("<div role='checkbox' aria-checked='maybe'>x</div>", "<div role='checkbox' ARIA-CHECKED='Mixed'>x</div>"),
    "bypass": ("<p>x</p>", '<a href="#top">Skip</a>'),
    "duplicate-id-aria": ('<p id="d">a</p><p id="d">b</p><i aria-describedby="c d">x</i>', '<p id="d">a</p><p id="d">b</p><i aria-describedby="D">x</i>'),
    "input-image-alt": ('<form><input type="image" name="go" alt=" "></form>', '<form><input type="image" name="go" alt="Go"></form>'),
    "meta-refresh": ('<meta http-equiv="refresh" content="5; url=/">', '<meta http-equiv="refresh" content="0; url=/">'),
    "scrollable-region-focusable": ('<div style="overflow-y: scroll">x</div>', '<div style="overflow:auto" tabindex="0">x</div>'),
    "select-name": ('<form><select name="s" title=""></select></form>', '<form><select name="s" title="Size"></select></form>'),
    "meta-viewport-scale": ("<meta content='user-scalable=no' name='viewport'>", '<meta name="viewport" content="width=device-width">'),
    "input-autocomplete": ('<input type="email" name="email">', '<input type="email" name="email" autocomplete="email">'),
    "text-spacing": ("<p style='letter-spacing: 0 !important'>x</p>", "<p style='letter-spacing: 0'>x</p>"),
    "aria-live-region": ('<div role="alert" aria-live="polite">x</div>', '<div role="alert" aria-live="assertive">x</div>'),
    "multiple-ways": ("<p>x</p>", "<p>x</p><nav>y</nav>"),
    "img-alt-long": (f'<img src="a.png" alt="{"x" * 151}">', f'<img src="a.png" alt="{"x" * 150}">'),
    "autocomplete-valid": ('<input type="text" autocomplete="shipping emial">', '<input type="text" autocomplete="section-a shipping email">'),
    "link-target-blank": ('<a href="/x" target="_blank">out</a>', '<a href="/x" target="_blank">out (new tab)</a>'),
}


@pytest.fixture(scope="module")
def found(spark):
    names = list(CASES)
    rows = [(2 * i + j, f"<html lang='en'><body>{CASES[n][j]}</body></html>") for i, n in enumerate(names) for j in (0, 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    issues = rules.audit(spark, pages, markup.elements(pages), "AAA").select("page_id", "rule_id").distinct().collect()
    return {(r["page_id"], r["rule_id"]) for r in issues}


@pytest.mark.parametrize("name", list(CASES))
def test_rule(found, name):
    i = list(CASES).index(name)
    assert (2 * i, name) in found
    assert (2 * i + 1, name) not in found


# (name, whole page, rules that it breaks among those listed)
PAGES = [
    ("single quotes", "<html lang='en'><body>x</body></html>", []),
    ("upper case", "<HTML LANG=en><BODY>x</BODY></HTML>", []),
    ("no quotes, unknown", "<html lang=xx-YY><body>x</body></html>", ["html-lang-valid"]),
    ("empty", '<html lang=""><body>x</body></html>', ["html-lang"]),
    ("absent", "<html><body lang='en'>x</body></html>", ["html-lang"]),
    ("within another value", "<html title=' lang=xx' lang='fr'><body><i title=\" role='bogus' aria-foo='1'\">x</i></body></html>", []),
    ("comment and script", "<html lang='en'><body><!-- <i role='bogus'> --><script>'<i aria-foo=\"1\">'</script>x</body></html>", []),
    ("first of two", "<html lang='en' lang='xx'><body><i role='button' role='bogus'>x</i></body></html>", []),
    ("unreadable scale", "<html lang='en'><head><meta name='viewport' content='maximum-scale=1.0.0, user-scalable=no'></head></html>", ["meta-viewport-scale"]),
]


def test_markup_variants(spark):
    judged = ["html-lang", "html-lang-valid", "aria-roles", "aria-valid-attr", "meta-viewport-scale"]
    pages = spark.createDataFrame([(i, html) for i, (_, html, _) in enumerate(PAGES)], "page_id long, html string")
    rows = rules.audit(spark, pages, markup.elements(pages), "AA").where(F.col("rule_id").isin(judged)).collect()
    got = {(PAGES[r["page_id"]][0], r["rule_id"]) for r in rows}
    assert got == {(name, rule) for name, _, broken in PAGES for rule in broken}
    assert [r["severity"] for r in rows if r["rule_id"] == "meta-viewport-scale"] == ["info"]


def test_every_rule_has_golden_pages():
    assert {r.rule_id for r in rules.RULES} == {*CASES, "html-lang", "html-lang-valid"}


def test_golden_rows(spark):
    """All columns of some issues, written out."""
    html = "<html lang='xx'><head><title>Home</title></head><body><nav>n</nav><main><img src='/a/b.png' alt='photo'><p id='d'>1</p><p id='d'>2</p><form><input name='q' placeholder='p'></form></main></body></html>"
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    style = spark.createDataFrame([(7, "rgb(230, 230, 230)", False)], "page_id long, outline_color string, has_outline_none boolean")
    got = sorted(tuple(r) for r in rules.audit(spark, pages, markup.elements(pages), "AA", style).collect())
    assert got == sorted(
        [
            (7, "html-lang-valid", "3.1.1", "A", "major", "html", -1),
            (7, "page-title", "2.4.2", "A", "major", "title", -1),
            (7, "img-alt-quality", "1.1.1", "A", "major", "", 9),
            (7, "duplicate-id", "4.1.1", "A", "critical", "[id='d']", 10),
            (7, "form-label", "1.3.1", "A", "major", "input[name='q']", 15),
            (7, "non-text-contrast", "1.4.11", "AA", "major", "", -1),
        ]
    )


def test_own_rule_and_levels(spark):
    assert {r.level for r in rules.at_level("A")} == {"A"}
    assert rules.at_level("odd") == rules.at_level("AA")
    own = rules.Rule("own-marquee", "2.2.2", "A", "Moving text", rules.Local("elements", "tag = 'marquee'", "'minor'", "tag"))
    rules.register(own)
    try:
        pages = spark.createDataFrame([(1, "<html><body><marquee>x</marquee></body></html>")], "page_id long, html string")
        got = rules.run_rule(spark, own, rules.views(spark, pages, markup.elements(pages))).collect()
        assert [(r["page_id"], r["severity"]) for r in got] == [(1, "minor")]
    finally:
        rules._OWN.clear()


def test_extents_of_unclosed_and_broken_markup(spark):
    html = '<div><p>one<p>two</div><script>var t="</div>";</script><b>x'
    got = {(r["tag"], r["pos"]): r["end_pos"] for r in markup.elements(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert got[("div", 0)] == 3 and got[("p", 1)] == 3 and got[("p", 2)] == 3


def test_greedy_duplicates(spark):
    rng = random.Random(5)
    rows = [(i, "s", f"h{rng.randrange(12)}", f"g{rng.randrange(4)}") for i in range(80)]
    kept_hash, kept_sig, want = {}, {}, {}
    for i, _, h, g in rows:
        if h in kept_hash:
            want[i] = kept_hash[h]
        elif len(kept_sig.setdefault(g, [])) >= 3:
            want[i] = kept_sig[g][0]
        else:
            kept_sig[g].append(i)
            kept_hash[h] = i
            want[i] = None
    got = dedup.decide(spark.createDataFrame(rows, "page_id long, site string, content_hash string, signature string")).collect()
    assert {r["page_id"]: r["original_id"] for r in got} == want


def test_frontier_order(spark):
    edges = [("s", str(a), str(b), 50.0, place) for a, place, b in [(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 3), (2, 1, 4), (3, 0, 5)]]
    got = frontier.expand(spark.createDataFrame([("s", "0", 0)], "site string, node string, place long"), spark.createDataFrame(edges, "site string, src string, dst string, score double, place int"), 5, 5)
    assert {r["node"]: (r["depth"], r["parent"], r["nth"]) for r in got.collect()} == {"0": (0, None, 1), "1": (1, "0", 2), "2": (1, "0", 3), "3": (2, "1", 4), "4": (2, "2", 5)}


def test_expected_purposes(spark):
    """The word that a field's name, placeholder and label call for; fields that say one, or that take nothing personal, have none."""
    said = {"<input type=email name=contact_e-mail>": "email", "<input type=text name=q placeholder='Post-code or postal code'>": "postal-code", "<input type=text aria-label='Birth date'>": "bday",
            "<input type=text name=email autocomplete=email>": None, "<input type=checkbox name=email>": None, "<input type=tel name=n autocomplete=off id=mobile>": None, "<input type=password id=login_secret>": "username"}
    pages = spark.createDataFrame(list(enumerate(said)), "page_id long, html string")
    got = {r["page_id"]: (r["expected"], r["recommendation"]) for r in rules.expected_purposes(markup.elements(pages)).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: w for i, w in enumerate(said.values()) if w}
    assert got[0][1] == 'Say autocomplete="email" on this field.'
