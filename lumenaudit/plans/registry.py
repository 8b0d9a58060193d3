"""Registered queries: each reads the given tables, enriches pages by page_id where rules need it, and has its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contrast, markup, urls
from ..functions import vocab as V
from ..operators import boxes, dedup, findings, frontier, report, rules, store, tables
from ..sources import pages as P
from ..sources.stored import shared_folder, stored
from ..streaming import progress
from . import entities, graphs, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = entities.QUERIES | graphs.QUERIES | records.QUERIES
ORACLES: dict[str, str] = entities.ORACLES | graphs.ORACLES | records.ORACLES

RICH = f"rich AS (SELECT page_id, url, {P.rich_sql()} AS html FROM pages)"
PRE = f"WITH {RICH}, {markup.duck_elements('rich')}"
FULL = f"{PRE},\n{rules.duck_views()}"


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rich(P.scan(spark, sf_dir))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.elements(rich(spark, sf_dir))


def add(name: str, query: Callable, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# Sources and extraction
add("s1_scan", lambda s, d: P.scan(s, d).select("page_id", "site", F.length("html").alias("chars")), "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, length(html)::INTEGER AS chars FROM pages")
add("e1_tokens", lambda s, d: markup.tokens(rich(s, d)).select("page_id", "pos", "tag", "is_close", F.length("text_after").alias("chars")), f"{PRE} SELECT page_id, pos, tag, is_close, length(text_after)::INTEGER AS chars FROM tk")
add("e2_attributes", lambda s, d: elements(s, d).select("page_id", "pos", "tag", *(markup.column_name(a) for a in markup.ATTRIBUTES), *(f"has_{a}" for a in [*markup.FLAGS, "alt"])), f"{PRE} SELECT * EXCLUDE (end_pos, raw, text) FROM elements")
add("e3_extents", lambda s, d: elements(s, d).select("page_id", "pos", "end_pos", "tag"), f"{PRE} SELECT page_id, pos, end_pos, tag FROM elements")
add("e4_text", lambda s, d: elements(s, d).where("text <> ''").select("page_id", "pos", "text"), f"{PRE} SELECT page_id, pos, text FROM elements WHERE text <> ''")


def _record(s: SparkSession, d: str) -> DataFrame:
    p = rich(s, d)
    return s.sql(rules.render(rules.RECORD, "spark"), pages=p, elements=markup.elements(p)).select("page_id", "lang", "title", "viewport", F.md5("html").alias("html_md5"))


#: Written apart from rules.RECORD: by patterns that fit this corpus, which quotes its attributes with ".
_SCALARS = f"""WITH {RICH}, bare AS (SELECT page_id, html[1:50000] AS head, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS html FROM rich),
 m AS (SELECT page_id, head, regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS lang, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<meta\\s+name="viewport"\\s+content="([^"]*)"', 1) AS viewport FROM bare)
 SELECT page_id, nullif(lang, '') AS lang, trim(replace(title, '&amp;', '&')) AS title, nullif(viewport, '') AS viewport, md5(head) AS html_md5 FROM m"""
add("e5_page_scalars", _record, _SCALARS)


def _view(name: str, where: str = "true") -> Callable:
    def query(s: SparkSession, d: str) -> DataFrame:
        p = rich(s, d)
        return rules.views(s, p, markup.elements(p))[name].where(where)

    return query


for _key, _name in (("e6_headings", "headings"), ("e8_form_inputs", "inputs"), ("e10_interactive", "buttons"), ("e11_landmarks", "landmarks"), ("e16_duplicate_ids", "duplicate_ids")):
    add(_key, _view(_name), f"{FULL} SELECT * FROM v_{_name}")



def _page_links(s: SparkSession, d: str) -> DataFrame:
    """Links with what their references mean on their page."""
    return _view("links")(s, d).join(P.scan(s, d).select("page_id", "url"), "page_id").withColumn("href", urls.resolve(F.col("url"), F.col("href"))).drop("url")


add("e9_links", _page_links, f"{FULL} SELECT * EXCLUDE (url, ref) REPLACE ({urls.duck_resolve('url', 'ref')} AS href) FROM (SELECT v.*, url, regexp_replace(href, '^\\s+|\\s+$', '', 'g') AS ref FROM v_links v JOIN pages USING (page_id))")
_ELEMENT_LISTS = {
    "e7_images": "SELECT page_id, pos, a_src AS src, a_alt AS alt, has_alt, TRY_CAST(nullif(regexp_extract(raw, RX'(?i)\\swidth\\s*=\\s*[\\x22\\x27]?([0-9]+)', 1), '') AS INT) AS width, TRY_CAST(nullif(regexp_extract(raw, RX'(?i)\\sheight\\s*=\\s*[\\x22\\x27]?([0-9]+)', 1), '') AS INT) AS height, a_role AS role FROM {elements} WHERE tag = 'img'",
    "e12_tabindex": "SELECT page_id, pos, tag, TRY_CAST(nullif(regexp_extract(a_tabindex, RX'^\\s*([+-]?[0-9]+)', 1), '') AS INT) AS tabindex FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM {elements} WHERE a_tabindex IS NOT NULL) q WHERE nth <= 100",
    "e13_autocomplete": "SELECT page_id, pos, a_name AS name, lower(a_type) AS type, coalesce(a_autocomplete, '') AS autocomplete FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM {elements} WHERE tag = 'input' AND lower(a_type) IN ('text', 'email', 'tel', 'url', 'password', 'search')) q WHERE nth <= 50",
    "e14_lang_parts": "SELECT page_id, pos, tag, a_lang AS lang FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM {elements} WHERE a_lang IS NOT NULL AND tag <> 'html') q WHERE nth <= 50",
    "e15_live_regions": "SELECT page_id, pos, tag, coalesce(a_role, '') AS role, coalesce(a_aria_live, '') AS aria_live FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM {elements} WHERE a_aria_live IS NOT NULL OR a_role IN ('alert', 'status', 'log', 'marquee', 'timer')) q WHERE nth <= 20",
    "e18_selectors": """SELECT page_id, pos, CASE WHEN coalesce(a_id, '') <> '' THEN concat(tag, '#', a_id) WHEN ppos IS NULL THEN tag
        ELSE concat(CASE WHEN ptag IN ('body', 'html') THEN '' WHEN pid <> '' THEN concat(ptag, '#', pid, ' > ') ELSE concat(ptag, ' > ') END, tag, ':nth-child(', CAST(row_number() OVER (PARTITION BY page_id, ppos ORDER BY pos) AS STRING), ')') END AS selector
        FROM (SELECT c.page_id, c.pos, c.tag, c.a_id, max(p.pos) AS ppos, max_by(p.tag, p.pos) AS ptag, max_by(coalesce(p.a_id, ''), p.pos) AS pid
          FROM {elements} c LEFT JOIN {elements} p ON p.page_id = c.page_id AND p.pos < c.pos AND c.pos < p.end_pos GROUP BY c.page_id, c.pos, c.tag, c.a_id) q""",
    "e20_interactive_kinds": "SELECT page_id, pos, 'a[href]' AS kind FROM {elements} WHERE tag = 'a' AND a_href IS NOT NULL UNION ALL SELECT page_id, pos, tag FROM {elements} WHERE tag IN ('button', 'input', 'select', 'textarea') UNION ALL SELECT page_id, pos, concat('[role=', a_role, ']') FROM {elements} WHERE a_role IN ('button', 'link', 'tab', 'menuitem') UNION ALL SELECT page_id, pos, '[tabindex]' FROM {elements} WHERE a_tabindex IS NOT NULL UNION ALL SELECT page_id, pos, '[onclick]' FROM {elements} WHERE has_onclick",
    "l10_interruptions": V.INTERRUPTION_SQL,
    "l11_dismiss_controls": V.DISMISS_SQL,
}
for _key, _sql in _ELEMENT_LISTS.items():
    add(_key, lambda s, d, sql=_sql: s.sql(rules.render(sql, "spark"), elements=elements(s, d)), f"{PRE} {rules.render(_sql, 'duck').format(elements='elements')}")


# Rules
for _r in rules.RULES:

    def _run(s: SparkSession, d: str, r=_r) -> DataFrame:
        p = rich(s, d)
        return rules.run_rule(s, r, rules.views(s, p, markup.elements(p)))

    add(f"r_{_r.rule_id.replace('-', '_')}", _run, f"{FULL} {rules.duck_rule(_r)}")


add(
    "r37_expected",
    lambda s, d: rules.expected_purposes(elements(s, d)),
    f"""{PRE}, f AS (SELECT page_id, pos, concat(lower(coalesce(nullif(a_name, ''), a_id, '')), ' ', lower(coalesce(a_placeholder, '')), ' ', lower(coalesce(a_aria_label, ''))) AS said FROM elements
  WHERE tag = 'input' AND lower(a_type) IN ('text', 'email', 'tel', 'url', 'password', 'search') AND coalesce(trim(a_autocomplete), '') IN ('', 'off')),
 g AS (SELECT page_id, pos, {rules.render(rules.PURPOSE, 'duck')} AS expected FROM f) SELECT *, 'Say autocomplete="' || expected || '" on this field.' AS recommendation FROM g WHERE expected IS NOT NULL""",
)


# A rule of one's own that fails on some pages: the scale of a viewport must be 2 at least
def _scale(page: list[dict]):
    for e in page:
        if e["tag"] == "meta" and e["a_name"] == "viewport" and "maximum-scale=" in (e["a_content"] or ""):
            if float(e["a_content"].split("maximum-scale=")[1].split(",")[0]) < 2:
                yield "major", "meta", e["pos"]


_OWN_RULE = rules.Rule("own-scale", "1.4.4", "AA", "Scale below two", check=_scale)
add(
    "g3_isolated_rule",
    lambda s, d: rules.run_rule(s, _OWN_RULE, {"elements": elements(s, d)}),
    f"""{PRE}, x AS (SELECT page_id, pos, regexp_extract(a_content, 'maximum-scale=([^,]*)', 1) AS said FROM elements WHERE tag = 'meta' AND a_name = 'viewport' AND contains(a_content, 'maximum-scale='))
 SELECT page_id, 'own-scale' AS rule_id, '1.4.4' AS wcag_criterion, 'AA' AS wcag_level, CASE WHEN TRY_CAST(said AS DOUBLE) IS NULL THEN 'info' ELSE 'major' END AS severity, CASE WHEN TRY_CAST(said AS DOUBLE) IS NULL THEN '' ELSE 'meta' END AS element_selector, CASE WHEN TRY_CAST(said AS DOUBLE) IS NULL THEN -1 ELSE pos END AS pos FROM x WHERE TRY_CAST(said AS DOUBLE) IS NULL OR TRY_CAST(said AS DOUBLE) < 2""",
)


# Colours: captured styles derived from page_id
def _styles_of(p: DataFrame) -> DataFrame:
    c = lambda k: (F.col("page_id") * k % 256).cast("string")
    return p.select("page_id", F.concat(F.lit("rgb("), c(7), F.lit(", "), c(13), F.lit(", "), c(29), F.lit(")")).alias("outline_color"), (F.col("page_id") % 9 == 0).alias("has_outline_none"))


def _styles(s: SparkSession, d: str) -> DataFrame:
    return _styles_of(P.scan(s, d))


def _lum(k: tuple[str, str, str]) -> str:
    one = lambda x: f"CASE WHEN {x} / 255.0::DOUBLE <= 0.04045 THEN {x} / 255.0::DOUBLE / 12.92 ELSE pow(({x} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
    return f"(0.2126 * ({one(k[0])}) + 0.7152 * ({one(k[1])}) + 0.0722 * ({one(k[2])}))"


_PAGE_LUM = _lum(("(page_id * 7 % 256)", "(page_id * 13 % 256)", "(page_id * 29 % 256)"))
_FOCUS = f"SELECT page_id, 'non-text-contrast', '1.4.11', 'AA', 'major', '', -1 FROM pages WHERE page_id % 9 <> 0 AND round(1.05 / ({_PAGE_LUM} + 0.05), 4) < 3"


def audit(s: SparkSession, d: str, level: str = "AA") -> DataFrame:
    p = rich(s, d).select("page_id", "html")
    return rules.audit(s, p, markup.elements(p), level, _styles_of(p))


def _audit_sql(level: str) -> str:
    body = " UNION ALL ".join(f"({rules.duck_rule(r)})" for r in rules.RULES if V.LEVELS[r.level] <= V.LEVELS[level]) + (f" UNION ALL ({_FOCUS})" if level != "A" else "")
    broken = "SELECT page_id FROM record WHERE regexp_extract(replace(lower(viewport), ' ', ''), 'maximum-scale=([0-9.]+)', 1) <> '' AND TRY_CAST(regexp_extract(replace(lower(viewport), ' ', ''), 'maximum-scale=([0-9.]+)', 1) AS DOUBLE) IS NULL"
    return f"{FULL}, every AS MATERIALIZED ({body}), broken AS ({broken}), issues AS (SELECT * FROM every WHERE NOT (rule_id = 'meta-viewport-scale' AND page_id IN (SELECT page_id FROM broken)) UNION ALL SELECT page_id, 'meta-viewport-scale', '1.4.4', 'AA', 'info', '', -1 FROM broken)"


_AUDIT = _audit_sql("AA")
add("g2_audit", audit, f"{_AUDIT} SELECT * FROM issues")
add("g1_audit_level_a", lambda s, d: audit(s, d, "A").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")), f"{_audit_sql('A')} SELECT rule_id, count(*) AS n FROM every GROUP BY ALL")


def _scores(s: SparkSession, d: str) -> DataFrame:
    p = rich(s, d).withColumn("task", F.col("page_id") % 5)
    issues = audit(s, d).withColumn("task", F.col("page_id") % 5)
    return report.scores(issues, p, "task")


_SCORES = f"""{_AUDIT}, c AS (SELECT page_id % 5 AS task, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'info') AS info FROM issues GROUP BY ALL),
 n AS (SELECT page_id % 5 AS task, count(*) AS pages FROM pages GROUP BY ALL),
 s AS (SELECT n.task, pages, critical, major, minor, info, greatest(0.0, round(100 - (10 * critical + 5 * major + 2 * minor) / pages, 1)) AS score FROM n JOIN c USING (task))
 SELECT *, least(100.0, round(score * 1.1, 1)) AS score_a, round(score, 1) AS score_aa, round(score * 0.9, 1) AS score_aaa, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM s"""
add("a3_scores", _scores, _SCORES)
add("a5_by_criterion", lambda s, d: report.by_criterion(audit(s, d)), f"{_AUDIT} SELECT wcag_criterion, count(*) AS n FROM issues GROUP BY ALL")
add("a6_by_level", lambda s, d: report.by_level(audit(s, d).withColumn("task", F.col("page_id") % 5), "task"), f"{_AUDIT} SELECT page_id % 5 AS task, wcag_level, count(*) AS n FROM issues GROUP BY ALL")


def _exported(s: SparkSession, d: str) -> DataFrame:
    issues, at = stored(audit(s, d).withColumn("task", F.col("page_id") % 5), "issues"), f"{shared_folder(s)}/reports-{uuid.uuid4().hex}"
    report.export_lines(report.scores(issues, P.scan(s, d).withColumn("task", F.col("page_id") % 5), "task"), issues, "task", at)
    return s.read.text(at).select(F.col("task").cast("long").alias("task"), F.col("value").alias("line"))


_SCORE_ROWS = _SCORES[: _SCORES.rindex("SELECT *, least(")] + ", t AS (" + _SCORES[_SCORES.rindex("SELECT *, least(") :] + ")"
_HEAD = ", ".join(f"'{c}': {c}" for c in ("task", "pages", "critical", "major", "minor", "info", "score", "score_a", "score_aa", "score_aaa", "band"))
add("s4_report_json", _exported, f"{_SCORE_ROWS} SELECT task, to_json({{{_HEAD}}})::VARCHAR AS line FROM t UNION ALL SELECT page_id % 5, to_json({{'page_id': page_id, 'rule_id': rule_id, 'pos': pos, 'severity': severity}})::VARCHAR FROM issues")


# Issues stored by task, with their pages; written for all tasks at level A, then again for one task at level AA
def _written(s: SparkSession, d: str) -> DataFrame:
    at, p = f"{shared_folder(s)}/issues-{uuid.uuid4().hex}", P.scan(s, d)
    task = (F.col("page_id") % 5).alias("task_id")
    p.where("page_id % 2 = 0").select("url", F.concat(F.lit("p"), "page_id").alias("page_id"), task).write.partitionBy("task_id").parquet(f"{at}/pages")
    issues = stored(audit(s, d).join(p.select("page_id", "url"), "page_id").select(task, "url", "rule_id", "wcag_level", "severity", "element_selector", "pos"), "issues")
    store.write_issues(issues.where("wcag_level = 'A'"), at)
    store.write_issues(issues.where("task_id = 2"), at)
    return store.read(s, f"{at}/issues", "url string, rule_id string, wcag_level string, severity string, element_selector string, pos int, page_id string, task_id long")


add(
    "s3_write_issues",
    _written,
    f"{_AUDIT} SELECT page_id % 5 AS task_id, url, rule_id, wcag_level, severity, element_selector, pos, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id ELSE md5((page_id % 5) || '|' || url) END AS page_id FROM issues JOIN pages USING (page_id) WHERE wcag_level = 'A' OR page_id % 5 = 2",
)


# Reviews: an issue's id is a hash of its place; annotations follow from it
def _issues(s: SparkSession, d: str) -> DataFrame:
    i = audit(s, d).withColumn("id", F.md5(F.concat_ws("|", "page_id", "rule_id", "severity", "element_selector", "pos")))
    return i.withColumn("status", F.lit("open")).withColumn("created_at", F.col("page_id"))


def _annotations(i: DataFrame) -> DataFrame:
    kind = F.conv(F.substring("id", 1, 2), 16, 10).cast("int") % 4
    return i.select(F.col("id").alias("issue_id"), F.col("id").alias("annotation_id"), F.element_at(F.array(*map(F.lit, ("confirm", "false_positive", "reclassify", "comment"))), kind + 1).alias("annotation_type"), "created_at").distinct()


_REVIEWED = f"{_AUDIT}, ided AS (SELECT *, md5(concat_ws('|', page_id, rule_id, severity, element_selector, pos)) AS id FROM issues), reviewed AS (SELECT *, CASE ('0x' || id[1:2])::INT % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'false_positive' ELSE 'open' END AS status FROM ided)"
add("t8_reviewed", lambda s, d: (lambda i: tables.reviewed(i, _annotations(i)).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n")))(_issues(s, d)), f"{_REVIEWED} SELECT rule_id, status, count(*) AS n FROM reviewed GROUP BY ALL")


def _measured(s: SparkSession, d: str) -> DataFrame:
    """Found issues of rules and detectors, held against labels: every third of what rules found, and issues of pages that nothing found."""
    rule = stored(audit(s, d), "issues")
    model = findings.normalise(findings.parse(_replies(s, d)))
    key = ["page_id", "rule_id", "element_selector"]
    found = rule.select(*key, F.lit("rule").alias("detected_by")).unionByName(model.select(*key, "detected_by"))
    labels = rule.where("page_id % 3 = 0").select(key).unionByName(P.scan(s, d).where("page_id % 4 = 0").select("page_id", F.explode(F.array(F.lit("link-text"), F.lit("ai-detection"), F.lit("never-found"))).alias("rule_id"), F.lit("p").alias("element_selector")))
    e = s.read.parquet(f"{d}/events.parquet").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    pages = P.scan(s, d).agg(F.count_if(F.col("page_id") % 10 != 0).alias("pages_tested"), F.count(F.lit(1)).alias("pages_reachable"))
    return report.quality(found, labels, pages.crossJoin(e.agg((F.max("t") - F.min("t")).alias("seconds"))))  # one row each


_MEASURED = f"""{_AUDIT}, found AS (SELECT DISTINCT page_id, rule_id, element_selector, 'rule' AS detected_by FROM issues UNION SELECT page_id, 'ai-detection', CASE WHEN page_id % 5 = 0 THEN 'img' ELSE 'p' END, CASE WHEN page_id % 2 = 0 THEN 'ai' ELSE 'vision_ai' END FROM pages WHERE page_id % 3 < 2),
 labels AS (SELECT page_id, rule_id, element_selector FROM issues WHERE page_id % 3 = 0 UNION SELECT page_id, unnest(['link-text', 'ai-detection', 'never-found']), 'p' FROM pages WHERE page_id % 4 = 0),
 per AS (SELECT f.rule_id, detected_by, count(*) AS found, count(l.page_id) AS matched FROM found f LEFT JOIN labels l ON l.page_id = f.page_id AND l.rule_id = f.rule_id AND l.element_selector = f.element_selector GROUP BY ALL), lab AS (SELECT rule_id, count(*) AS labelled FROM labels GROUP BY ALL),
 run AS (SELECT count(*) FILTER (page_id % 10 <> 0) AS tested, count(*) AS reachable, (SELECT floor(epoch(max(ts))) - floor(epoch(min(ts))) FROM events) AS seconds FROM pages),
 q AS (SELECT coalesce(per.rule_id, lab.rule_id) AS rule_id, coalesce(detected_by, 'none') AS detected_by, coalesce(found, 0) AS found, coalesce(matched, 0) AS matched, coalesce(labelled, 0) AS labelled FROM per FULL JOIN lab ON per.rule_id = lab.rule_id)
 SELECT q.*, matched / nullif(found, 0) AS precision, matched / nullif(labelled, 0) AS recall, (found - matched) / nullif(found, 0) AS false_positive_rate, tested / reachable AS page_coverage, seconds / tested AS seconds_per_page FROM q, run"""
add("a12_quality", _measured, _MEASURED)
add("t1_issue_list", lambda s, d: tables.listing(_issues(s, d), {"severity": "critical"}, "created_at", 50).select("id", "page_id", "rule_id", "total"), f"{_REVIEWED} SELECT id, page_id, rule_id, count(*) OVER () AS total FROM reviewed WHERE severity = 'critical' ORDER BY page_id DESC, id LIMIT 50")
add("t10_priority", lambda s, d: audit(s, d).select(F.when(F.col("severity") == "critical", "Highest").when(F.col("severity") == "major", "High").when(F.col("severity") == "minor", "Medium").otherwise("Low").alias("priority")).groupBy("priority").agg(F.count(F.lit(1)).alias("n")), f"{_AUDIT} SELECT CASE severity WHEN 'critical' THEN 'Highest' WHEN 'major' THEN 'High' WHEN 'minor' THEN 'Medium' ELSE 'Low' END AS priority, count(*) AS n FROM issues GROUP BY ALL")
add("s5_export_rows", lambda s, d: report.export_rows(rules.with_texts(s, audit(s, d)), P.scan(s, d)).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("recommendation") == "").alias("blank")), f"{_AUDIT} SELECT url, count(*) AS n, 0::BIGINT AS blank FROM issues JOIN pages USING (page_id) GROUP BY ALL")


add("r_non_text_contrast", lambda s, d: contrast.weak_focus(_styles(s, d)).select("page_id", "contrast"), f"SELECT * FROM (SELECT page_id, round(1.05 / ({_PAGE_LUM} + 0.05), 4) AS contrast FROM pages WHERE page_id % 9 <> 0) WHERE contrast < 3")
add("f9_text_contrast", lambda s, d: contrast.text_contrast(_styles(s, d).select("page_id", F.col("outline_color").alias("color"), F.lit("rgba(0, 0, 0, 0)").alias("background_color"))).select("page_id", "contrast", "aa", "aaa"), f"SELECT *, contrast >= 4.5 AS aa, contrast >= 7 AS aaa FROM (SELECT page_id, round(1.05 / ({_PAGE_LUM} + 0.05), 4) AS contrast FROM pages)")
add("f4_hex_contrast", lambda s, d: P.scan(s, d).select("page_id", contrast.hex_contrast(F.concat(F.lit("#"), F.lpad(F.hex(F.col("page_id") * 7919 % 16777216), 6, "0")), F.lit("#FFFFFF")).alias("c")).select("page_id", "c.*"), f"SELECT page_id, r AS ratio, v >= 4.5 AS aa, v >= 3 AS aa_large, v >= 7 AS aaa, v >= 4.5 AS aaa_large FROM (SELECT page_id, v, round(v, 2) AS r FROM (SELECT page_id, 1.05 / ({_lum(('(page_id * 7919 % 16777216 // 65536)', '(page_id * 7919 % 16777216 // 256 % 256)', '(page_id * 7919 % 256)'))} + 0.05) AS v FROM pages))")


# Duplicates
add("d1_signature", lambda s, d: dedup.signature(elements(s, d)), f"{PRE}, {graphs.SIGNATURE_TABLES} SELECT * FROM signatures")


# Frontier
def _candidates(s: SparkSession, d: str) -> DataFrame:
    return graphs.links(s, P.scan(s, d)).select("page_id", "pos", F.col("link").alias("url"), (F.col("page_id") % 6).cast("int").alias("depth"), (F.col("page_id") % 2 == 0).alias("parent_has_forms"), (F.col("page_id") % 3 == 0).alias("parent_has_issues"))


def _first_sql(words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(path, '{w}') THEN '{w}'" for w in words) + " END"


_SKIPPED_SQL = f" WHERE NOT regexp_matches(path, '\\.({'|'.join(V.SKIPPED_SUFFIXES)})$')"
_RANK = f"""{graphs.LINKS_SQL}, c AS (SELECT page_id, pos, link AS url, (page_id % 6)::INTEGER AS depth, page_id % 2 = 0 AS parent_has_forms, page_id % 3 = 0 AS parent_has_issues, lower(regexp_extract(link, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)) AS path FROM site_links),
 w AS (SELECT *, {_first_sql(V.HIGH_PRIORITY)} AS hi, {_first_sql(V.MEDIUM_PRIORITY)} AS mid, {_first_sql(V.LOW_PRIORITY)} AS lo, 10.0::DOUBLE * depth / 5 AS penalty FROM c{_SKIPPED_SQL}),
 x AS (SELECT page_id, pos, url, depth, parent_has_forms, parent_has_issues, round(greatest(0.0, least(100.0, 50.0 + (hi IS NOT NULL)::INT * 30.0 + (mid IS NOT NULL)::INT * 15.0 - (lo IS NOT NULL)::INT * 20.0 - penalty + parent_has_forms::INT * 15.0 + parent_has_issues::INT * 10.0 - greatest(0.0, (length(url) - 100) * 0.1)))::DOUBLE, 6) AS score,
  coalesce(nullif(concat_ws('; ', 'High-priority pattern: ' || hi, 'Medium-priority pattern: ' || mid, 'Low-priority pattern: ' || lo, CASE WHEN penalty > 5 THEN format('Depth penalty: -{{:.1f}}', penalty) END, CASE WHEN parent_has_forms THEN 'Parent has forms' END, CASE WHEN parent_has_issues THEN 'Parent had a11y issues' END), ''), 'Default priority') AS reason FROM w)
 SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::INTEGER AS rank FROM x"""
add("l3_rank", lambda s, d: frontier.rank(_candidates(s, d), 5), _RANK)


def _prioritised(s: SparkSession, d: str) -> DataFrame:
    """All links, skipped ones too, with the score that their page's forms and level A issues give them."""
    p = rich(s, d).select("page_id", "html")
    e = stored(markup.elements(p), "elements")
    has = lambda df, name: df.select("page_id").distinct().withColumn(name, F.lit(True))
    links = _candidates(s, d).select("page_id", "pos", "url", "depth")
    links = links.join(has(e.where("tag = 'form'"), "parent_has_forms"), "page_id", "left").join(has(rules.audit(s, p, e, "A"), "parent_has_issues"), "page_id", "left")
    return frontier.prioritise(links.na.fill(False, ["parent_has_forms", "parent_has_issues"]), 5)


add(
    "l2_priority",
    _prioritised,
    _RANK.replace("page_id % 2 = 0 AS parent_has_forms", f"page_id IN (SELECT page_id FROM ({PRE} SELECT page_id FROM elements WHERE tag = 'form')) AS parent_has_forms")
    .replace("page_id % 3 = 0 AS parent_has_issues", f"page_id IN (SELECT page_id FROM ({_audit_sql('A')} SELECT page_id FROM every)) AS parent_has_issues")
    .replace(_SKIPPED_SQL, "")
    .replace(", row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos)::INTEGER AS rank", ""),
)


graphs.graph_queries(graphs.edges_sql(_first_sql, V))
QUERIES |= graphs.QUERIES
ORACLES |= graphs.ORACLES
add("l8_stats", lambda s, d: frontier.graph_stats(P.scan(s, d).withColumn("status", F.when(F.col("page_id") % 3 == 0, "tested").when(F.col("page_id") % 3 == 1, "explored").otherwise("pending"))), "SELECT count(*) AS total, count(*) FILTER (page_id % 3 < 2) AS explored, count(*) FILTER (page_id % 3 = 0) AS tested FROM pages")


# Findings of other detectors, carried by derived replies
#: The severities that replies carry, by page_id: the nine that are known, and another.
_SAID = ("critical", "major", "minor", "info", "serious", "moderate", "high", "low", "medium", "odd")
_READ = "['critical', 'major', 'minor', 'info', 'major', 'minor', 'critical', 'minor', 'major', 'minor'][page_id % 10 + 1]"
_CRITERION = "CASE WHEN page_id % 7 = 0 THEN 'unknown' ELSE '1.1.1' END"


def _replies(s: SparkSession, d: str) -> DataFrame:
    sev = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("page_id") % len(_SAID) + 1).cast("int"))
    criterion = F.when(F.col("page_id") % 7 == 0, "").otherwise('"wcag_criterion": "1.1.1", ')
    one = F.concat(F.lit("{"), criterion, F.lit('"severity": "'), sev, F.lit('", "element_selector": "'), F.when(F.col("page_id") % 5 == 0, "img").otherwise("p"), F.lit('", "confidence": 0.5}'))
    text = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Found:\n```json\n["), one, F.lit("]\n```"))).when(F.col("page_id") % 3 == 1, one).otherwise("nothing to report")
    return P.scan(s, d).select("page_id", F.when(F.col("page_id") % 2 == 0, "ai").otherwise("vision_ai").alias("source"), text.alias("reply"))


add("m1_parse_replies", lambda s, d: findings.normalise(findings.parse(_replies(s, d))).select("page_id", "detected_by", "rule_id", "wcag_criterion", "wcag_level", "severity", "element_selector", "confidence"), f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ai' ELSE 'vision_ai' END AS detected_by, 'ai-detection' AS rule_id, {_CRITERION} AS wcag_criterion, 'A' AS wcag_level, {_READ} AS severity, CASE WHEN page_id % 5 = 0 THEN 'img' ELSE 'p' END AS element_selector, 0.5::DOUBLE AS confidence FROM pages WHERE page_id % 3 < 2")
def _normalised(s: SparkSession, d: str) -> DataFrame:
    """How many findings of each severity as said and as read, with what is filled in."""
    said = findings.parse(_replies(s, d)).withColumn("said", F.col("severity"))
    return findings.normalise(said).groupBy("said", "severity", "wcag_level", "rule_id", "wcag_criterion").agg(F.count(F.lit(1)).alias("n"))


add(
    "m4_severities",
    _normalised,
    f"""SELECT said, read AS severity, 'A' AS wcag_level, 'ai-detection' AS rule_id, {_CRITERION} AS wcag_criterion, count(*) AS n FROM pages JOIN (VALUES (0, 'critical', 'critical'), (1, 'major', 'major'), (2, 'minor', 'minor'), (3, 'info', 'info'),
 (4, 'serious', 'major'), (5, 'moderate', 'minor'), (6, 'high', 'critical'), (7, 'low', 'minor'), (8, 'medium', 'major'), (9, 'odd', 'minor')) AS v(k, said, read) ON k = page_id % 10 WHERE page_id % 3 < 2 GROUP BY ALL""",
)
add("m2_unseen_vision", lambda s, d: (lambda f: findings.drop_known(f.where("detected_by = 'vision_ai'"), elements(s, d).where("tag = 'img'").select("page_id", F.col("tag").alias("element_selector"))))(findings.parse(_replies(s, d))).select("page_id", "element_selector"), f"{PRE} SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'img' ELSE 'p' END AS element_selector FROM pages p WHERE page_id % 3 < 2 AND page_id % 2 = 1 AND NOT (page_id % 5 = 0 AND EXISTS (SELECT 1 FROM elements e WHERE e.page_id = p.page_id AND e.tag = 'img'))")

_FOUND = f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ai' ELSE 'vision_ai' END AS detected_by, {_CRITERION} AS wcag_criterion, 'A' AS wcag_level, {_READ} AS severity, CASE WHEN page_id % 5 = 0 THEN 'img' ELSE 'p' END AS element_selector FROM pages WHERE page_id % 3 < 2"
add(
    "m3_merge",
    lambda s, d: findings.merge(audit(s, d), findings.normalise(findings.parse(_replies(s, d)))),
    f"{_AUDIT}, found AS ({_FOUND}), known AS (SELECT page_id, element_selector FROM issues WHERE element_selector <> '' UNION SELECT page_id, element_selector FROM found WHERE detected_by = 'ai') SELECT page_id, 'rule' AS detected_by, wcag_criterion, wcag_level, severity, element_selector FROM issues UNION ALL SELECT * FROM found WHERE detected_by = 'ai' OR NOT EXISTS (SELECT 1 FROM known k WHERE k.page_id = found.page_id AND k.element_selector = found.element_selector)",
)
_MERGED = f"{_AUDIT}, found AS ({_FOUND}), known AS (SELECT page_id, element_selector FROM issues WHERE element_selector <> '' UNION SELECT page_id, element_selector FROM found WHERE detected_by = 'ai'), merged AS (SELECT page_id, 'rule' AS detected_by FROM issues UNION ALL SELECT page_id, detected_by FROM found WHERE detected_by = 'ai' OR NOT EXISTS (SELECT 1 FROM known k WHERE k.page_id = found.page_id AND k.element_selector = found.element_selector))"
add("m7_totals", lambda s, d: findings.totals(findings.merge(stored(audit(s, d), "issues"), findings.normalise(findings.parse(_replies(s, d))))), f"{_MERGED} SELECT page_id, count(*) FILTER (detected_by = 'rule') AS rule, count(*) FILTER (detected_by = 'ai') AS ai, count(*) FILTER (detected_by = 'vision_ai') AS vision_ai FROM merged GROUP BY ALL")


def _boxed(s: SparkSession, d: str) -> DataFrame:
    """Issues of three kinds of selectors on elements that may have boxes, each matched with the page's boxes."""
    e = stored(elements(s, d), "elements")
    chosen = e.where("tag IN ('a', 'button', 'h1', 'img', 'input', 'p')")
    selector = s.sql(rules.render(_ELEMENT_LISTS["e18_selectors"], "spark"), elements=e)
    b = chosen.join(selector, ["page_id", "pos"]).select("page_id", "pos", "selector", "tag", "text", F.col("a_alt").alias("alt"), F.col("a_aria_label").alias("aria_label"), F.lit(0).alias("x"), (-F.col("pos")).alias("y"))
    i = chosen.join(selector, ["page_id", "pos"]).where("pos % 2 = 0").select("page_id", F.col("pos").cast("long").alias("issue"), F.when(F.col("pos") % 3 == 0, F.col("selector")).when(F.col("a_alt").isNotNull(), F.concat(F.lit("img[alt*='"), "a_alt", F.lit("']"))).alias("element_selector"), F.when(F.col("pos") % 4 == 0, F.col("raw")).alias("element_html"))
    return boxes.match(i, b)


add("m6_match_boxes", _boxed)
_RULES_OF = "SELECT page_id % 5 AS task, string_agg('- ' || rule_id, chr(10) ORDER BY rule_id) AS recommendations FROM (SELECT DISTINCT page_id % 5 AS page_id, rule_id FROM issues) GROUP BY ALL"


def _reports(s: SparkSession, d: str) -> DataFrame:
    issues = stored(audit(s, d).withColumn("task", F.col("page_id") % 5), "issues")  # used twice
    said = issues.groupBy("task").agg(F.sort_array(F.collect_set("rule_id")).alias("recommendations")).withColumn("summary", F.concat(F.lit("task "), "task"))
    return report.report_row(report.scores(issues, rich(s, d).withColumn("task", F.col("page_id") % 5), "task"), issues, "task", said)


add(
    "a7_report",
    _reports,
    f"""{_SCORES.replace("SELECT *, least(100.0", "SELECT *, least(100.0", 1)[: _SCORES.rindex(" SELECT *, least(")]}, z AS ({_RULES_OF}), lv AS (SELECT page_id % 5 AS task, count(*) FILTER (wcag_level = 'A') AS la, count(*) FILTER (wcag_level = 'AA') AS laa, count(*) FILTER (wcag_level = 'AAA') AS laaa FROM issues GROUP BY ALL)
 SELECT s.task, score AS overall_score, least(100.0, round(score * 1.1, 1)) AS score_a, round(score, 1) AS score_aa, round(score * 0.9, 1) AS score_aaa, pages AS total_pages, critical + major + minor + info AS total_issues, critical, major, minor,
  '{{"by_severity":{{"critical":' || critical || ',"major":' || major || ',"minor":' || minor || ',"info":' || info || '}},"by_wcag_level":{{"A":' || la || ',"AA":' || laa || ',"AAA":' || laaa || '}}}}' AS issue_breakdown, 'task ' || s.task AS summary, recommendations FROM s JOIN z USING (task) JOIN lv USING (task)""",
)

# Tables and memory
add("t15_last_entries", lambda s, d: tables.last_entries(s.read.parquet(f"{d}/conversations.parquet"), 2, "conv_id", "turn").select("conv_id", "turn", "role", "nth"), "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS nth FROM conversations QUALIFY nth <= 2")


def _memories(s: SparkSession, d: str) -> DataFrame:
    return P.scan(s, d).select(F.col("site").alias("domain"), F.lit("episodic").alias("memory_type"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("key"), F.concat(F.lit("page "), "page_id").alias("content"), (F.col("page_id") * 37 % 101 / 101.0).alias("relevance_score"))


_MEMORY = "WITH m AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, lpad(page_id::VARCHAR, 9, '0') AS key, 'page ' || page_id AS content, (page_id * 37 % 101) / 101.0::DOUBLE AS relevance_score FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY relevance_score DESC, key)::INTEGER AS nth FROM m QUALIFY nth <= 5)"
add("t12_recall", lambda s, d: tables.recall(_memories(s, d), 5).select("domain", "key", "nth"), f"{_MEMORY} SELECT domain, key, nth FROM r")
add("t13_context", lambda s, d: (lambda m: tables.context_text(tables.recall(m.where("relevance_score > 0.8"), 5), m))(_memories(s, d)), f"{_MEMORY}, top AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY relevance_score DESC, key) AS nth FROM m WHERE relevance_score > 0.8 QUALIFY nth <= 5), x AS (SELECT domain, 'Known about this site:' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY nth) AS context FROM top GROUP BY ALL) SELECT domain, coalesce(context, 'Nothing is known about this site yet.') AS context FROM (SELECT DISTINCT domain FROM m) LEFT JOIN x USING (domain)")

# Streams
_MSG = "WITH m AS (SELECT CASE event_type WHEN 'view' THEN 'page_discovered' WHEN 'click' THEN 'agent_reasoning' WHEN 'purchase' THEN 'issue_found' WHEN 'error' THEN 'event_detected' WHEN 'signup' THEN 'task_progress' ELSE event_type END AS type, user_id AS task_id, ts, event_id, value FROM events)"
add("w2_latest", lambda s, d: progress.drain(progress.latest(progress.messages(progress.stream(s, d, "events"))), "complete"), f"{_MSG} SELECT task_id, type, value, event_id FROM m QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) = 1")
add("w7_counters", lambda s, d: progress.drain(progress.counters(progress.messages(progress.stream(s, d, "events"))), "complete"), f"{_MSG} SELECT task_id, type, count(*) AS n FROM m GROUP BY ALL")
add("w4_routed", lambda s, d: progress.drain(progress.messages(progress.stream(s, d, "events")).where("type = 'issue_found'").select("task_id", "event_id"), "append").drop("batch"), f"{_MSG} SELECT task_id, event_id FROM m WHERE type = 'issue_found'")


add(
    "w3_bounded_log",
    lambda s, d: progress.newest(progress.drain(progress.bounded_log(progress.messages(progress.stream(s, d, "events")), 10), "update")).select("task_id", "nth", "event_id", "type"),
    f"{_MSG}, l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY task_id) AS n FROM m) SELECT task_id, (least(n, 10) - back + 1)::INTEGER AS nth, event_id, type FROM l WHERE back <= 10",
)


def _steps(s: SparkSession, d: str) -> DataFrame:
    step = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("cancel")
    return progress.stream(s, d, "events").select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("timestamp"), "event_id", step.alias("step"))


add(
    "w5_lifecycle",
    lambda s, d: progress.newest(progress.drain(progress.lifecycle(_steps(s, d)), "update")),
    """WITH t AS (SELECT user_id AS task_id, ts, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'start' WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'fail' ELSE 'cancel' END AS step FROM events),
 o AS (SELECT *, lag(step) OVER w AS before, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS back FROM t WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id))
 SELECT task_id, max(CASE WHEN back = 1 THEN CASE step WHEN 'start' THEN 'running' WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'cancelled' END END) AS status, count(*) FILTER (step = 'start' AND before = 'start') AS refused FROM o GROUP BY task_id""",
)


def _stream_audit(s: SparkSession, d: str) -> DataFrame:
    def run(batch: DataFrame) -> DataFrame:
        p = P.rich(batch).select("page_id", "html")
        return rules.audit(batch.sparkSession, p, markup.elements(p), focus_styles=_styles_of(p))

    return progress.incremental_audit(s, progress.stream(s, d, "pages"), run)


add("w1_stream_audit", _stream_audit, f"{_AUDIT} SELECT * FROM issues")
