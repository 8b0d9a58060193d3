"""Queries over entity tables, page lists and small functions, derived from the given tables by page_id or event."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup, snippets
from ..operators import dedup, findings, frontier, report, tables
from ..sources import pages as P
from ..sources.stored import stored
from ..streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PRE = f"WITH rich AS (SELECT page_id, url, {P.rich_sql()} AS html FROM pages), {markup.duck_elements('rich')}"
_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def add(name: str, sql: str) -> Callable:
    def put(query: Callable) -> Callable:
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return put


def _rich(s: SparkSession, d: str) -> DataFrame:
    return P.rich(P.scan(s, d))


# Extraction
@add("e17_content_hash", f"""{_PRE}, roots AS (SELECT page_id, pos, end_pos FROM elements WHERE tag IN ('main', 'body') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tag DESC, pos) = 1),
 tags AS (SELECT page_id, string_agg(tag, ',' ORDER BY pos) AS tags FROM (SELECT e.page_id, e.pos, e.tag FROM elements e JOIN roots r ON e.page_id = r.page_id AND e.pos > r.pos AND e.pos < r.end_pos QUALIFY row_number() OVER (PARTITION BY e.page_id ORDER BY e.pos) <= 500) GROUP BY page_id),
 texts AS (SELECT t.page_id, string_agg(text_after, '' ORDER BY t.pos) AS text FROM tk t JOIN roots r ON t.page_id = r.page_id AND t.pos >= r.pos AND t.pos < r.end_pos GROUP BY t.page_id)
 SELECT p.page_id, sha256(CASE WHEN r.page_id IS NULL THEN url ELSE coalesce(tags, '') || '|' || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')[1:5000] END)[1:16] AS content_hash FROM rich p LEFT JOIN roots r ON r.page_id = p.page_id LEFT JOIN tags g ON g.page_id = p.page_id LEFT JOIN texts x ON x.page_id = p.page_id""")
def content_hash(s: SparkSession, d: str) -> DataFrame:
    p = _rich(s, d)
    e = stored(markup.elements(p).select("page_id", "pos", "end_pos", "tag"), "elements")  # used four times
    return dedup.content_hash(e, markup.tokens(p), p)


# Functions
def heading_problems(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, has_h1, heading_count, n_problems, problems, valid) of every page: a missing h1 and skipped levels, in order, are problems; a page without headings has none."""
    h = elements.where(F.col("tag").rlike("^h[1-6]$")).select("page_id", F.substring("tag", 2, 1).cast("int").alias("level"), "pos")
    h = h.withColumn("prev", F.lag("level").over(Window.partitionBy("page_id").orderBy("pos")))
    out = h.groupBy("page_id").agg(F.bool_or(F.col("level") == 1).alias("has_h1"), F.count(F.lit(1)).alias("heading_count"), F.sort_array(F.collect_list(F.when(F.col("level") > F.col("prev") + 1, F.struct("pos", F.concat(F.lit("h"), "prev", F.lit(" is followed by h"), "level").alias("said"))))).alias("skips"))
    out = pages.select("page_id").join(out, "page_id", "left").na.fill(0, ["heading_count"]).na.fill(False, ["has_h1"])
    none = F.array().cast("array<string>")
    skips = F.coalesce(F.transform("skips", lambda x: x["said"]), none)
    problems = F.concat(F.when((F.col("heading_count") > 0) & ~F.col("has_h1"), F.array(F.lit("no h1"))).otherwise(none), skips)
    return out.select("page_id", "has_h1", "heading_count", F.size(problems).alias("n_problems"), problems.alias("problems"), (F.size(problems) == 0).alias("valid"))


def heading_rows(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """The same with the number of problems only."""
    return heading_problems(pages, elements).drop("problems")


_ROLES = ", ".join(f"'{r}'" for r in snippets.LABEL_REQUIRED_ROLES)


@add("f5_aria_snippets", f"""{_PRE}, x AS (SELECT page_id, pos, raw, regexp_extract(raw, 'role=["'']([^"'']+)["'']', 1) AS role, regexp_extract(raw, 'aria-hidden=["'']([^"'']+)["'']', 1) AS hidden, TRY_CAST(regexp_extract(raw, 'tabindex=["''](-?[0-9]+)["'']', 1) AS INT) AS ti FROM elements),
 y AS (SELECT page_id, pos, list_filter([CASE WHEN role IN ({_ROLES}) AND NOT contains(raw, 'aria-label=') AND NOT contains(raw, 'aria-labelledby=') THEN 'label missing for role ' || role END, CASE WHEN hidden NOT IN ('', 'true', 'false') THEN 'aria-hidden can''t be ' || hidden END, CASE WHEN contains(raw, 'aria-hidden="true"') AND ti >= 0 THEN 'hidden element takes focus' END], lambda v: v IS NOT NULL) AS problems FROM x)
 SELECT page_id, pos, problems FROM y WHERE len(problems) > 0""")
def aria_snippets(s: SparkSession, d: str) -> DataFrame:
    return markup.elements(_rich(s, d)).select("page_id", "pos", snippets.aria_problems(F.col("raw")).alias("problems")).where(F.size("problems") > 0)


@add("f6_heading_summary", f"""{_PRE}, h AS (SELECT page_id, pos, tag[2:2]::INT AS level, lag(tag[2:2]::INT) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM elements WHERE regexp_matches(tag, '^h[1-6]$'))
 SELECT p.page_id, count(*) FILTER (level = 1) > 0 AS has_h1, count(level) AS heading_count, count(*) FILTER (level > prev + 1)::INT + (count(level) > 0 AND count(*) FILTER (level = 1) = 0)::INT AS n_problems, list_concat(CASE WHEN count(level) > 0 AND count(*) FILTER (level = 1) = 0 THEN ['no h1'] ELSE [] END, coalesce(list('h' || prev || ' is followed by h' || level ORDER BY pos) FILTER (level > prev + 1), [])) AS problems, count(*) FILTER (level > prev + 1) = 0 AND (count(level) = 0 OR count(*) FILTER (level = 1) > 0) AS valid FROM pages p LEFT JOIN h ON h.page_id = p.page_id GROUP BY p.page_id""")
def heading_summary(s: SparkSession, d: str) -> DataFrame:
    p = _rich(s, d)
    return heading_problems(p, markup.elements(p))


@add("f7_normal_text", "SELECT doc_id, md5(coalesce(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '')) AS normal FROM documents")
def normal_text(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(snippets.normal_text(F.col("text"))).alias("normal"))


@add("f8_markup_parts", f"""{_PRE} SELECT page_id, pos, nullif(lower(regexp_extract(raw, '^\\s*<([a-zA-Z][a-zA-Z0-9]*)', 1)), '') AS from_markup, nullif(lower(regexp_extract(tag || '#x', '^([a-zA-Z][a-zA-Z0-9]*)', 1)), '') AS from_selector, CASE WHEN regexp_matches(raw, '(?i)alt\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')') THEN regexp_extract(raw, '(?i)alt\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(raw, '(?i)alt\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')', 2) END AS alt FROM elements""")
def markup_parts(s: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return markup.elements(_rich(s, d)).select("page_id", "pos", snippets.markup_tag(raw).alias("from_markup"), snippets.selector_tag(F.concat("tag", F.lit("#x"))).alias("from_selector"), snippets.markup_attribute(raw, "alt").alias("alt"))


# Frontier
_PATH = "lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"


@add("l1_skip", f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) NOT IN ('http', 'https', '') OR regexp_matches({_PATH}, '\\.({'|'.join(frontier.V.SKIPPED_SUFFIXES)})$') AS skipped FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' ELSE '' END AS url FROM pages)")
def skip(s: SparkSession, d: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".html").otherwise(""))
    return P.scan(s, d).select("page_id", frontier.skipped(url).alias("skipped"))


def nodes(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    return P.scan(s, d).select("page_id", "url", "site", F.when(i % 3 == 0, "tested").when(i % 3 == 1, "explored").otherwise("discovered").alias("status"), (i % 6).cast("int").alias("depth"), (i % 7 == 0).alias("is_duplicate"))


_NODES = f"WITH nodes AS (SELECT page_id, url, {_SITE} AS site, CASE page_id % 3 WHEN 0 THEN 'tested' WHEN 1 THEN 'explored' ELSE 'discovered' END AS status, (page_id % 6)::INT AS depth, page_id % 7 = 0 AS is_duplicate FROM pages)"
add("l6_unexplored", f"{_NODES} SELECT page_id, url FROM nodes WHERE status = 'discovered' AND NOT is_duplicate")(lambda s, d: frontier.with_status(nodes(s, d), "discovered").select("page_id", "url"))
add("l6_untested", f"{_NODES} SELECT page_id, url FROM nodes WHERE status = 'explored' AND NOT is_duplicate")(lambda s, d: frontier.with_status(nodes(s, d), "explored").select("page_id", "url"))
add("l7_at_depth", f"{_NODES} SELECT page_id, url FROM nodes WHERE depth = 2")(lambda s, d: nodes(s, d).where("depth = 2").select("page_id", "url"))

# Lists, lookups, patches and deletions: a page is a task of project page_id % 7
def tasks(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    return P.scan(s, d).select(i.alias("id"), (i % 7).alias("project_id"), "url", F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), (i % 4 + 1).cast("int")).alias("status"), (i * 3 % 101).alias("pages_discovered"), (i * 2 % 67).alias("pages_tested"), (i % 13).alias("issues_found"), F.when(i % 3 > 0, i % 90).alias("score"), i.alias("created_at"))


_TASKS = "WITH tasks AS (SELECT page_id AS id, page_id % 7 AS project_id, url, ['pending', 'running', 'completed', 'failed'][page_id % 4 + 1] AS status, page_id * 3 % 101 AS pages_discovered, page_id * 2 % 67 AS pages_tested, page_id % 13 AS issues_found, CASE WHEN page_id % 3 > 0 THEN page_id % 90 END AS score, page_id AS created_at FROM pages)"
_LIST = "SELECT id, url, count(*) OVER () AS total FROM tasks"
add("t2_task_lookup", f"{_TASKS} SELECT id, url, status FROM tasks WHERE id = 42")(lambda s, d: tasks(s, d).where("id = 42").select("id", "url", "status"))
add("t3_patch", f"{_TASKS} SELECT id, CASE WHEN id % 5 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 0 ELSE issues_found END AS issues_found FROM tasks")(
    lambda s, d: tables.patch(tasks(s, d).select("id", "status", "issues_found"), tasks(s, d).where("id % 5 = 0").select("id", F.lit("closed").alias("status"), F.when(F.col("id") % 10 == 0, F.lit(0).cast("long")).alias("issues_found")), ["status", "issues_found"])
)
add("t4_page_list", f"{_TASKS} {_LIST} WHERE project_id = 3 ORDER BY created_at, id LIMIT 20")(lambda s, d: tables.listing(tasks(s, d), {"project_id": 3}, "created_at", 20, ascending=True).select("id", "url", "total"))
add("t5_task_list", f"{_TASKS} {_LIST} WHERE project_id = 2 AND status = 'completed' ORDER BY created_at DESC, id LIMIT 20")(lambda s, d: tables.listing(tasks(s, d), {"project_id": 2, "status": "completed"}, "created_at", 20).select("id", "url", "total"))


def projects(s: SparkSession, d: str) -> DataFrame:
    """A project per site, named after it, as old as its first page."""
    return P.scan(s, d).groupBy(F.col("site").alias("id")).agg(F.min("page_id").alias("created_at"))


add("t6_project_list", f"SELECT id, created_at, count(*) OVER () AS total FROM (SELECT {_SITE} AS id, min(page_id) AS created_at FROM pages GROUP BY ALL) ORDER BY created_at DESC, id LIMIT 10")(lambda s, d: tables.listing(projects(s, d), {}, "created_at", 10))


@add("t7_cascade", f"{_TASKS} SELECT 'project' AS kind, count(DISTINCT project_id) AS n FROM tasks WHERE project_id NOT IN (1, 4) UNION ALL SELECT 'task', count(*) FROM tasks WHERE project_id NOT IN (1, 4)")
def cascade(s: SparkSession, d: str) -> DataFrame:
    t = tasks(s, d)
    p = t.select(F.col("project_id").alias("id")).distinct()
    kept, rest = tables.cascade(p, p.where("id IN (1, 4)"), "id", [(t, "project_id")])
    return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("project").alias("kind"), "n").unionByName(rest.agg(F.count(F.lit(1)).alias("n")).select(F.lit("task").alias("kind"), "n"))


add("t9_annotations", "SELECT event_id, user_id AS issue_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS nth FROM events WHERE event_type IN ('click', 'error')")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").where("event_type IN ('click', 'error')").select("event_id", F.col("user_id").alias("issue_id"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("nth"))
)
add("t11_report_lookup", f"{_TASKS} SELECT id, any_value(score) AS score, count(score) = 1 AS is_unique FROM tasks GROUP BY id HAVING count(score) > 0")(lambda s, d: tables.report_of(tasks(s, d).select("id"), tasks(s, d).where("score IS NOT NULL").select("id", "score"), "id"))


@add("t14_experience", f"""{_PRE} SELECT {_SITE} AS domain, 'detection_' || (page_id % 3) AS key, list(DISTINCT tag ORDER BY tag) AS issues_found, count(DISTINCT tag) AS issue_count FROM elements JOIN pages USING (page_id) WHERE tag IN ('img', 'form', 'iframe', 'video', 'table', 'svg') GROUP BY ALL""")
def experience(s: SparkSession, d: str) -> DataFrame:
    found = markup.elements(_rich(s, d)).where("tag IN ('img', 'form', 'iframe', 'video', 'table', 'svg')").join(P.scan(s, d).select("page_id", "site"), "page_id")
    return tables.experiences(found.select(F.col("site").alias("domain"), (F.col("page_id") % 3).cast("string").alias("page_type"), F.col("tag").alias("rule_id"))).drop("content")


# Reports
add("a2_pages_per_task", f"{_TASKS} SELECT project_id, count(*) AS n FROM tasks GROUP BY ALL")(lambda s, d: tasks(s, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")))
add("a8_dashboard", f"{_TASKS} SELECT count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, sum(issues_found)::BIGINT AS issues, sum(pages_discovered)::BIGINT AS pages FROM tasks")(lambda s, d: report.dashboard(tasks(s, d)))
add("a9_bands", f"{_TASKS} SELECT id, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM tasks WHERE score IS NOT NULL")(lambda s, d: tasks(s, d).where("score IS NOT NULL").select("id", report.band(F.col("score")).alias("band")))
add("a10_progress", f"{_TASKS} SELECT id, least(100.0, 100.0 * pages_discovered / 50)::DOUBLE AS discovered, (100.0 * pages_tested / nullif(pages_discovered, 0))::DOUBLE AS tested FROM tasks")(lambda s, d: report.progress(tasks(s, d), 50).select("id", "discovered", "tested"))
add("s6_labels", f"{_TASKS} SELECT id, CASE id % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Major' WHEN 2 THEN 'Minor' ELSE 'Notice' END AS severity_label, CASE id % 3 WHEN 0 THEN 'Rule' WHEN 1 THEN 'Model' ELSE 'Vision model' END AS source_label, CASE WHEN score >= 80 THEN '#52c41a' WHEN score >= 60 THEN '#faad14' WHEN score IS NOT NULL THEN '#f5222d' END AS score_colour FROM tasks")(
    lambda s, d: report.labelled(tasks(s, d).select("id", "score", F.element_at(F.array(*map(F.lit, ("critical", "major", "minor", "info"))), (F.col("id") % 4 + 1).cast("int")).alias("severity"), F.element_at(F.array(*map(F.lit, ("rule", "ai", "vision_ai"))), (F.col("id") % 3 + 1).cast("int")).alias("detected_by"))).select("id", "severity_label", "source_label", report.colour(F.col("score")).alias("score_colour"))
)


# Boxes: each h1 or p is a box; each page has three issues, one with a selector that no box has
@add("m5_locate", f"{_PRE}, b AS (SELECT page_id, tag AS selector, arg_max(pos, pos) AS y FROM elements WHERE tag IN ('h1', 'p') GROUP BY ALL), i AS (SELECT page_id, unnest(['h1', 'p', 'main > p']) AS element_selector FROM pages) SELECT i.page_id, element_selector, y FROM i LEFT JOIN b ON b.page_id = i.page_id AND b.selector = i.element_selector")
def locate(s: SparkSession, d: str) -> DataFrame:
    boxes = markup.elements(_rich(s, d)).where("tag IN ('h1', 'p')").select("page_id", "pos", F.col("tag").alias("selector"), F.struct(F.lit(0).alias("x"), F.col("pos").alias("y")).alias("bbox"))
    issues = P.scan(s, d).select("page_id", F.explode(F.array(*map(F.lit, ("h1", "p", "main > p")))).alias("element_selector"))
    return findings.locate(issues, boxes).select("page_id", "element_selector", "bbox.y")


add("a11_boxed_pages", f"{_PRE} SELECT page_id, url FROM pages WHERE page_id IN (SELECT page_id FROM elements WHERE tag = 'img')")(lambda s, d: report.boxed(P.scan(s, d), markup.elements(_rich(s, d)).where("tag = 'img'")).select("page_id", "url"))
add("m8_default_reply", "SELECT page_id, (page_id % 2)::INT AS n_findings, CASE page_id % 2 WHEN 0 THEN 'nothing found' ELSE 'findings read' END AS summary FROM pages")(
    lambda s, d: findings.with_default(P.scan(s, d).select("page_id", F.when(F.col("page_id") % 2 == 1, F.concat(F.lit('[{"severity": "'), "site", F.lit('"}]'))).otherwise(F.concat(F.lit("no JSON: "), "url")).alias("reply")), "nothing found")
)
add("s3_missing_pages", "SELECT DISTINCT user_id AS page_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")(
    lambda s, d: tables.missing_parents(s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select(F.col("user_id").alias("page_id")), P.scan(s, d).where("page_id % 3 = 0"), ["page_id"])
)


# Streams
def _arrivals(s: SparkSession, d: str) -> DataFrame:
    """Pages as a stream, a minute apart in the order of page_id."""
    return progress.stream(s, d, "pages").select(F.expr("try_parse_url(url, 'AUTHORITY')").alias("site"), F.md5("html").alias("content_hash"), F.timestamp_seconds(1_700_000_000 + F.col("page_id") * 60).alias("arrived"))


add("w6_stream_duplicates", f"SELECT DISTINCT {_SITE} AS site, md5(html) AS content_hash FROM pages")(lambda s, d: progress.drain(progress.distinct(_arrivals(s, d), ["site", "content_hash"], "arrived", "365 days"), "append").select("site", "content_hash"))
