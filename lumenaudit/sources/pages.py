"""Page tables: scan, and the deterministic enrichment that the plain corpus needs to exercise every rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(page_id, site, url, html); site is the URL's authority."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.expr("try_parse_url(url, 'AUTHORITY')").alias("site"), "url", "html")


#: Snippets put before </article>: (modulus, remainder of page_id, markup).
SNIPPETS = [
    (5, 0, '<img src="a.png" alt="photo">'),
    (5, 1, '<img src="a.png" alt="Team at work"><img src="b.png" alt="' + "long words " * 15 + '">'),
    (4, 0, '<form><input type="text" name="q" required><select name="s"></select><input type="image" name="go"></form>'),
    (4, 1, '<form><label for="em">Mail</label><input id="em" type="email" name="email" autocomplete="emial" required><input type="text" name="zip" aria-label="Zip code" autocomplete="shipping postal-code"><input name="phone" type="tel" placeholder="phone"></form>'),
    (6, 0, "<h4>Deep</h4>"),
    (6, 1, "<h2>Next</h2><main><p>Body</p></main>"),
    (7, 0, '<a href="/x" target="_blank">more</a><a href="/y"></a><a href="/z" aria-label="go">Search</a>'),
    (7, 1, '<a href="/x"><img src="i.png" alt="Annual report"></a><a href="#top">Annual report</a>'),
    (8, 0, '<div tabindex="3">t</div><div tabindex="0">u</div>'),
    (8, 1, '<p id="d">one</p><p id="d">two</p><label for="d">L</label>'),
    (8, 2, '<button></button><a href="/n"><button>Go</button></a><button aria-label="send it">Send</button>'),
    (9, 0, '<video autoplay src="v.mp4"></video><map><area href="/a"><area href="/b" alt="North"></map>'),
    (9, 1, '<video autoplay muted src="v.mp4"><track kind="captions" src="c.vtt"></video>'),
    (9, 2, '<div role="img" aria-checked="maybe">x</div><div role="checkbox">y</div><div role="bogus" aria-foo="1">z</div>'),
    (9, 3, '<div role="checkbox" aria-checked="true">ok</div>'),
    (10, 0, '<div aria-hidden="true"><a href="/h">hidden link</a></div><div aria-hidden="true"><a href="/h" tabindex="-1">off</a></div>'),
    (10, 1, '<div role="list"></div><div role="tab">T</div>'),
    (10, 2, '<div role="list"><div role="listitem">item</div></div><div role="alert" aria-live="off">A</div><div role="status" aria-live="assertive">S</div>'),
    (10, 3, '<iframe src="/f"></iframe><iframe src="/g" title="Map"></iframe><meta http-equiv="refresh" content="5; url=/">'),
    (10, 4, '<div style="overflow:auto">text</div><div style="overflow:auto" tabindex="0">text</div>'),
    (11, 2, '<svg role="img"></svg><svg role="img"><title>Logo</title></svg>'),
    (11, 3, '<table><tr><th id="a">A</th></tr><tr><td headers="zz">1</td></tr><tr><th id="b">B</th></tr></table>'),
    (11, 4, '<span lang="qq">x</span><span lang="fr-CA">y</span>'),
    (11, 5, '<p style="line-height:1 !important">tight</p><p style="line-height:1">fine</p>'),
    (12, 3, '<div class="cookie-bar"><button>Accept</button></div><div role="dialog"><button aria-label="Close">x</button></div>'),
]
_VIEWPORT = {0: "width=device-width", 1: "user-scalable=no, maximum-scale=1", 2: "maximum-scale=1.0.0, user-scalable=no", 3: "maximum-scale=1.5"}


RX_REPLACE = "regexp_replace({}, '{}', '{}')"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _head_sql(html: str) -> str:
    """The page's head variants as nested replaces; the same in Spark SQL and DuckDB."""
    html = f"CASE WHEN page_id % 11 = 0 THEN {RX_REPLACE.format(html, '<html lang=\"[a-z]*\">', '<html>')} WHEN page_id % 11 = 1 THEN {RX_REPLACE.format(html, '<html lang=\"[a-z]*\">', '<html lang=\"xx\">')} ELSE {html} END"
    html = f"CASE WHEN page_id % 13 = 0 THEN {RX_REPLACE.format(html, '<title>[^<]*</title>', '<title></title>')} WHEN page_id % 13 = 1 THEN {RX_REPLACE.format(html, '<title>[^<]*</title>', '<title>Home</title>')} ELSE {html} END"
    metas = " ".join(f"WHEN page_id % 7 = {k} THEN {_sql_text(f'<meta name=\"viewport\" content=\"{v}\">')}" for k, v in _VIEWPORT.items())
    return f"replace({html}, '</head>', concat(CASE {metas} ELSE '' END, '</head>'))"


def rich_sql(html: str = "html") -> str:
    parts = ", ".join(f"CASE WHEN page_id % {m} = {r} THEN {_sql_text(s)} ELSE '' END" for m, r, s in SNIPPETS)
    return f"replace({_head_sql(html)}, '</article>', concat({parts}, '</article>'))"


def rich(pages: DataFrame) -> DataFrame:
    """Pages with the snippets of SNIPPETS and the head variants spliced in by page_id."""
    return pages.withColumn("html", F.expr(rich_sql()))

