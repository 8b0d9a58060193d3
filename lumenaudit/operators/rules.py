"""The rule catalogue: 46 checks as SQL over the element and page-record tables.

A rule gives (page_id, pos, severity, element_selector); `audit` unions the rules of the requested
level over one stored element table and adds the catalogue's columns. The statements use a small
common dialect, rendered for Spark (raw strings, explode) and, for comparison, for DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contrast, markup
from ..functions import vocab as V
from ..sources.stored import stored


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def values(pairs: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + quoted(list(p)) + ")" for p in pairs) + ")"


def render(sql: str, dialect: str) -> str:
    """RX'..' is a pattern, HAS(x, p) a search, EACH(a) a row per array item, ARRAY_OF(..) an array, WORDS(x) the words of x."""
    if dialect == "spark":
        sql = re.sub(r"WORDS\(([^()]*)\)", r"filter(split(\1, RX'\\s+'), w -> w <> '')", sql)
        return sql.replace("RX'", "r'").replace("HAS(", "regexp_like(").replace("EACH(", "explode(").replace("ARRAY_OF(", "array(")
    sql = re.sub(r"WORDS\(([^()]*)\)", r"list_filter(regexp_split_to_array(\1, RX'\\s+'), lambda w: w <> '')", sql)
    return sql.replace("RX'", "'").replace("HAS(", "regexp_matches(").replace("EACH(", "unnest(").replace("ARRAY_OF(", "list_value(")


_ATTR = markup.ATTRIBUTE.replace('"', r"\x22").replace("'", r"\x27")
#: Tables that several rules use, in order; each may use those before it.
VIEWS = {
    "labels": "SELECT DISTINCT page_id, a_for FROM {elements} WHERE tag = 'label' AND a_for IS NOT NULL",
    "inputs": """
        SELECT i.page_id, i.pos, f.pos AS form_pos, i.tag, coalesce(lower(i.a_type), CASE i.tag WHEN 'input' THEN 'text' WHEN 'select' THEN 'select-one' ELSE 'textarea' END) AS kind,
          coalesce(i.a_name, '') AS name, i.a_id AS id, i.a_alt AS alt, i.a_aria_label AS aria_label, i.a_aria_labelledby AS labelledby, i.a_title AS title, i.a_placeholder AS placeholder, i.has_required AS required, l.page_id IS NOT NULL AS has_label
        FROM {elements} f JOIN {elements} i ON f.page_id = i.page_id AND i.pos > f.pos AND i.pos < f.end_pos LEFT JOIN {labels} l ON l.page_id = i.page_id AND l.a_for = i.a_id
        WHERE f.tag = 'form' AND i.tag IN ('input', 'select', 'textarea')""",
    "inner_names": """
        SELECT a.page_id, a.pos, min_by(CASE WHEN c.tag = 'img' THEN nullif(trim(c.a_alt), '') END, CASE WHEN c.tag = 'img' AND c.has_alt THEN c.pos END) AS img_alt,
          min_by(c.a_aria_label, CASE WHEN c.tag = 'svg' AND c.a_aria_label IS NOT NULL THEN c.pos END) AS svg_label
        FROM {elements} a JOIN {elements} c ON a.page_id = c.page_id AND c.pos > a.pos AND c.pos < a.end_pos
        WHERE (a.tag IN ('a', 'button') OR a.a_role = 'button') AND c.tag IN ('img', 'svg') GROUP BY a.page_id, a.pos""",
    "links": """
        SELECT * FROM (SELECT e.page_id, e.pos, e.a_href AS href, substring(coalesce(nullif(e.text, ''), n.img_alt, n.svg_label, e.a_title, ''), 1, 100) AS text, coalesce(e.a_aria_label, '') AS aria_label, coalesce(e.a_aria_labelledby, '') AS labelledby,
          coalesce(e.a_title, '') AS title, coalesce(e.a_target, '') AS target, row_number() OVER (PARTITION BY e.page_id ORDER BY e.pos) AS nth
        FROM {elements} e LEFT JOIN {inner_names} n ON n.page_id = e.page_id AND n.pos = e.pos WHERE e.tag = 'a' AND e.a_href IS NOT NULL) q WHERE nth <= 200""",
    "buttons": """
        SELECT e.page_id, e.pos, e.tag, e.a_type AS type, substring(coalesce(nullif(e.text, ''), n.img_alt, n.svg_label, e.a_value, e.a_title, ''), 1, 100) AS text, coalesce(e.a_aria_label, '') AS aria_label, coalesce(e.a_aria_labelledby, '') AS labelledby, coalesce(e.a_title, '') AS title, coalesce(e.a_value, '') AS value, e.has_disabled AS disabled
        FROM {elements} e LEFT JOIN {inner_names} n ON n.page_id = e.page_id AND n.pos = e.pos WHERE e.tag = 'button' OR e.a_role = 'button' OR (e.tag = 'input' AND lower(e.a_type) IN ('submit', 'button'))""",
    "headings": "SELECT page_id, pos, CAST(substring(tag, 2, 1) AS INT) AS level, substring(text, 1, 200) AS text, a_id AS id FROM {elements} WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')",
    "landmarks": f"SELECT page_id, pos, tag, coalesce(a_role, tag) AS role, a_aria_label AS aria_label FROM {{elements}} WHERE tag IN ('main', 'nav', 'header', 'footer', 'aside') OR a_role IN ({quoted(['main', 'navigation', 'banner', 'contentinfo', 'complementary', 'search', 'region'])})",
    "kinds": "SELECT page_id, max(CASE WHEN role = 'main' THEN 1 ELSE 0 END) AS has_main, max(CASE WHEN role IN ('navigation', 'nav') THEN 1 ELSE 0 END) AS has_nav, max(CASE WHEN role = 'search' THEN 1 ELSE 0 END) AS has_search FROM {landmarks} GROUP BY page_id",
    "duplicate_ids": "SELECT page_id, id, n, pos FROM (SELECT page_id, a_id AS id, count(*) AS n, min(pos) AS pos, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) AS nth FROM {elements} WHERE a_id IS NOT NULL GROUP BY page_id, a_id HAVING count(*) > 1) q WHERE nth <= 30",
    "focusable": "SELECT page_id, pos, end_pos, tag FROM {elements} WHERE coalesce(a_tabindex, '0') NOT LIKE '-%' AND ((tag = 'a' AND a_href IS NOT NULL) OR tag IN ('button', 'input', 'select', 'textarea') OR a_tabindex IS NOT NULL)",
    "aria": "SELECT page_id, pos, end_pos, tag, lower(trim(coalesce(a_role, ''))) AS role FROM {elements} WHERE a_role IS NOT NULL",
    "aria_attrs": f"""
        SELECT page_id, pos, role, name, trim(value) AS value FROM (
          SELECT page_id, pos, role, lower(regexp_extract(attr, RX'^\\s([^\\s=]+)', 1)) AS name, regexp_extract(attr, RX'=\\s*[\\x22\\x27]?([^\\x22\\x27]*)', 1) AS value FROM (
            SELECT page_id, pos, lower(trim(coalesce(a_role, ''))) AS role, EACH(regexp_extract_all(raw, RX'{_ATTR}', 0)) AS attr FROM {{elements}} WHERE HAS(raw, RX'(?i)\\saria-')) q) r WHERE name LIKE 'aria-%'""",
}

_SKIP = f"kind NOT IN ({quoted(V.UNLABELLED_TYPES)})"
_LANG_OK = quoted(V.LANGUAGES)
_COMBINED = "concat(lower(coalesce(nullif(a_name, ''), a_id, '')), ' ', lower(coalesce(a_placeholder, '')), ' ', lower(coalesce(a_aria_label, '')))"
PURPOSE = "CASE " + " ".join(f"WHEN HAS(said, RX'{p}') THEN '{t}'" for p, t in V.PURPOSES) + " END"
#: Inputs whose purpose is judged: of a kind that takes personal data, and without a word for it.
FIELD = "tag = 'input' AND lower(a_type) IN ('text', 'email', 'tel', 'url', 'password', 'search') AND coalesce(trim(a_autocomplete), '') IN ('', 'off')"


@dataclass(frozen=True)
class Local:
    """A rule that judges one row of one table; all such rules of a table run in one pass."""

    table: str
    where: str
    severity: str
    selector: str
    pos: str = "pos"

    def __str__(self) -> str:
        return f"SELECT page_id, {self.pos} AS pos, {self.severity} AS severity, {self.selector} AS element_selector FROM {{{self.table}}} WHERE {self.where}"


@dataclass(frozen=True)
class Rule:
    """sql gives page_id, pos, severity, element_selector over {elements}, {record} and VIEWS; or build does, from a DataFrame of elements and one of records;
    or check does, from one page's elements in order: (severity, selector, pos) of each issue. A check that fails on a page has one `info` issue there instead of its own, and its issues on all other pages."""

    rule_id: str
    criterion: str
    level: str
    title: str
    sql: str | Local = ""
    build: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    check: Callable[[list[dict]], Iterable[tuple[str, str, int]]] | None = None


def _element(where: str, severity: str = "'major'", selector: str = "tag") -> Local:
    return Local("elements", where, severity, selector)


def _page(where: str, severity: str = "'major'", selector: str = "''") -> Local:
    return Local("record", where, severity, selector, "-1")


def _part(tag: str, column: str) -> str:
    return f"CASE WHEN coalesce({column}, '') = '' THEN '{tag}' ELSE concat('{tag}[src*=', chr(39), substring({column}, 1, 50), chr(39), ']') END"


_NAME = "concat('input[name=', chr(39), name, chr(39), ']')"
_PRIMARY = "lower(trim(split_part({}, '-', 1)))"
_SPACING = "SELECT 'line-height' AS prop UNION ALL SELECT 'letter-spacing' UNION ALL SELECT 'word-spacing'"
_PROP = "concat(p.prop, RX'\\s*:[^;]*!important')"

RULES = [
    Rule("img-alt-quality", "1.1.1", "A", "Image text says nothing about the image", _element(f"tag = 'img' AND lower(trim(a_alt)) IN ({quoted(V.MEANINGLESS_ALT)})", selector="''")),
    Rule("form-label", "1.3.1", "A", "Form field without a label", Local("inputs", f"{_SKIP} AND NOT has_label AND coalesce(aria_label, '') = ''", "CASE WHEN coalesce(placeholder, '') = '' THEN 'critical' ELSE 'major' END", f"{_NAME}")),
    Rule("heading-order", "1.3.1", "A", "Headings are out of order", """SELECT page_id, -1 AS pos, 'major' AS severity, '' AS element_selector FROM {headings} GROUP BY page_id HAVING min(level) > 1 UNION ALL
        SELECT page_id, pos, 'minor', concat('h', CAST(level AS STRING)) FROM (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM {headings}) q WHERE level > prev + 1"""),
    Rule("html-lang", "3.1.1", "A", "Page without a language", _page("coalesce(lang, '') = ''", "'critical'", "'html'")),
    Rule("html-lang-valid", "3.1.1", "A", "Page with an unknown language code", _page(f"{_PRIMARY.format('lang')} <> '' AND {_PRIMARY.format('lang')} NOT IN ({_LANG_OK})", selector="'html'")),
    Rule("landmark-structure", "1.3.1", "A", "Main or navigation landmark is missing", """SELECT r.page_id, -1 AS pos, 'major' AS severity, '' AS element_selector FROM {record} r LEFT JOIN {kinds} k ON k.page_id = r.page_id WHERE coalesce(has_main, 0) = 0 UNION ALL
        SELECT r.page_id, -1, 'minor', '' FROM {record} r LEFT JOIN {kinds} k ON k.page_id = r.page_id WHERE coalesce(has_nav, 0) = 0"""),
    Rule("link-text", "2.4.4", "A", "Link without a telling name", Local("links", f"(text = '' AND aria_label = '' AND labelledby = '' AND title = '') OR (lower(trim(text)) IN ({quoted(V.GENERIC_LINK_TEXT)}) AND aria_label = '')", f"CASE WHEN text = '' AND aria_label = '' AND labelledby = '' AND title = '' THEN 'critical' ELSE 'minor' END", f"concat('a[href=', chr(39), href, chr(39), ']')")),
    Rule("page-title", "2.4.2", "A", "Page title is missing or generic", _page(f"coalesce(title, '') = '' OR lower(title) IN ({quoted(V.GENERIC_TITLE)})", "CASE WHEN coalesce(title, '') = '' THEN 'critical' ELSE 'major' END", "'title'")),
    Rule("tabindex-positive", "2.4.3", "A", "Positive tabindex", _element("TRY_CAST(nullif(regexp_extract(a_tabindex, RX'^\\s*([+-]?[0-9]+)', 1), '') AS INT) > 0")),
    Rule("duplicate-id", "4.1.1", "A", "An id is used more than once", "SELECT page_id, pos, 'critical' AS severity, concat('[id=', chr(39), id, chr(39), ']') AS element_selector FROM {duplicate_ids}"),
    Rule("button-name", "4.1.2", "A", "Button without a name", Local("buttons", "text = '' AND aria_label = '' AND labelledby = '' AND title = '' AND value = ''", "'critical'", "tag")),
    Rule("label-in-name", "2.5.3", "A", "Visible text is not part of the accessible name", """SELECT page_id, pos, 'major' AS severity, tag AS element_selector FROM {buttons} WHERE text <> '' AND aria_label <> '' AND position(lower(trim(text)) IN lower(trim(aria_label))) = 0 UNION ALL
        SELECT page_id, pos, 'major', 'a' FROM {links} WHERE text <> '' AND aria_label <> '' AND position(lower(trim(text)) IN lower(trim(aria_label))) = 0"""),
    Rule("no-autoplay", "1.4.2", "A", "Media starts by itself with sound", _element("tag IN ('video', 'audio') AND has_autoplay AND lower(raw) NOT LIKE '%muted%'", "'critical'")),
    Rule("form-required-indicator", "3.3.1", "A", "Required field is not identified", Local("inputs", f"required AND {_SKIP} AND NOT has_label AND coalesce(aria_label, '') = ''", f"'major'", f"{_NAME}")),
    Rule("area-alt", "1.1.1", "A", "Image-map area without a text", _element("tag = 'area' AND coalesce(a_alt, '') = '' AND coalesce(a_aria_label, '') = '' AND a_aria_labelledby IS NULL", "'critical'", "CASE WHEN coalesce(a_href, '') = '' THEN 'area' ELSE concat('area[href=', chr(39), substring(a_href, 1, 80), chr(39), ']') END")),
    Rule("aria-allowed-attr", "4.1.2", "A", "ARIA attribute that the role does not take", f"""SELECT a.page_id, a.pos, 'critical' AS severity, a.name AS element_selector FROM (SELECT * FROM {{aria_attrs}} WHERE role IN ({quoted(list(V.ARIA_BY_ROLE))})) a
        LEFT JOIN (SELECT * FROM {values([(r, n) for r, more in V.ARIA_BY_ROLE.items() for n in more])} AS v(role, name)) ok ON ok.role = a.role AND ok.name = a.name WHERE ok.name IS NULL AND a.name NOT IN ({quoted(V.ARIA_GLOBAL)})"""),
    Rule("aria-hidden-focus", "4.1.2", "A", "Hidden element can take the focus", "SELECT DISTINCT f.page_id, f.pos, 'major' AS severity, f.tag AS element_selector FROM {focusable} f JOIN {elements} h ON h.page_id = f.page_id AND h.a_aria_hidden = 'true' AND f.pos >= h.pos AND f.pos <= h.end_pos"),
    Rule("aria-required-attr", "4.1.2", "A", "Role without a required attribute", f"SELECT a.page_id, a.pos, 'critical' AS severity, v.name AS element_selector FROM {{aria}} a JOIN (SELECT * FROM {values([(r, n) for r, m in V.ARIA_REQUIRED.items() for n in m])} AS v(role, name)) v ON v.role = a.role LEFT JOIN {{aria_attrs}} t ON t.page_id = a.page_id AND t.pos = a.pos AND t.name = v.name WHERE t.name IS NULL"),
    Rule("aria-required-children", "4.1.2", "A", "Role without its required children", f"""SELECT p.page_id, p.pos, 'critical' AS severity, p.role AS element_selector FROM {{aria}} p LEFT JOIN (SELECT a.page_id, a.pos FROM {{aria}} a JOIN (SELECT * FROM {values([(r, n) for r, m in V.REQUIRED_CHILDREN.items() for n in m])} AS v(role, child)) v ON v.role = a.role
        JOIN {{aria}} c ON c.page_id = a.page_id AND c.role = v.child AND c.pos > a.pos AND c.pos < a.end_pos GROUP BY a.page_id, a.pos) k ON k.page_id = p.page_id AND k.pos = p.pos WHERE p.role IN ({quoted(list(V.REQUIRED_CHILDREN))}) AND k.pos IS NULL"""),
    Rule("aria-required-parent", "4.1.2", "A", "Role outside its required parent", f"""SELECT c.page_id, c.pos, 'critical' AS severity, c.role AS element_selector FROM (SELECT c.page_id, c.pos, c.role, max_by(p.role, p.pos) AS parent FROM {{aria}} c LEFT JOIN {{aria}} p ON p.page_id = c.page_id AND p.role <> '' AND p.pos < c.pos AND c.pos < p.end_pos WHERE c.role IN ({quoted(list(V.REQUIRED_PARENT))}) GROUP BY c.page_id, c.pos, c.role) c
        LEFT JOIN (SELECT * FROM {values([(r, n) for r, m in V.REQUIRED_PARENT.items() for n in m])} AS v(role, parent)) v ON v.role = c.role AND v.parent = c.parent WHERE v.role IS NULL"""),
    Rule("aria-roles", "4.1.2", "A", "Unknown role", f"SELECT page_id, pos, 'critical' AS severity, word AS element_selector FROM (SELECT page_id, pos, EACH(WORDS(role)) AS word FROM {{aria}}) q WHERE word NOT IN ({quoted(V.ROLES)})"),
    Rule("aria-valid-attr", "4.1.2", "A", "Unknown ARIA attribute", f"SELECT page_id, pos, 'critical' AS severity, name AS element_selector FROM {{aria_attrs}} WHERE name NOT IN ({quoted(V.ARIA_NAMES)})"),
    Rule("aria-valid-attr-value", "4.1.2", "A", "ARIA attribute with an unknown value", f"""SELECT q.page_id, q.pos, 'critical' AS severity, q.name AS element_selector FROM (SELECT page_id, pos, name, lower(value) AS value FROM {{aria_attrs}}) q
        LEFT JOIN (SELECT * FROM {values([(n, x) for n, m in V.ARIA_VALUES.items() for x in m])} AS v(name, value)) v ON v.name = q.name AND v.value = q.value WHERE q.name IN ({quoted(list(V.ARIA_VALUES))}) AND v.name IS NULL"""),
    Rule("bypass", "2.4.1", "A", "No way past repeated blocks", _page("html <> '' AND NOT HAS(lower(html), RX'<a\\b[^>]*href\\s*=\\s*[\"\\x27]#') AND NOT HAS(lower(html), RX'<main\\b') AND NOT HAS(lower(html), RX'role\\s*=\\s*[\"\\x27]main[\"\\x27]')")),
    Rule("duplicate-id-aria", "4.1.1", "A", "A referenced id is used more than once", """SELECT d.page_id, d.pos, 'critical' AS severity, concat('[id=', chr(39), d.id, chr(39), ']') AS element_selector FROM {duplicate_ids} d JOIN (SELECT DISTINCT page_id, id FROM (SELECT page_id, a_for AS id FROM {labels} UNION ALL
        SELECT page_id, EACH(WORDS(value)) FROM {aria_attrs} WHERE name IN ('aria-activedescendant', 'aria-controls', 'aria-describedby', 'aria-details', 'aria-errormessage', 'aria-flowto', 'aria-labelledby', 'aria-owns')) u) r ON r.page_id = d.page_id AND r.id = d.id"""),
    Rule("frame-title", "4.1.2", "A", "Frame without a title", _element("tag IN ('iframe', 'frame') AND coalesce(a_title, '') = '' AND coalesce(a_aria_label, '') = '' AND coalesce(a_aria_labelledby, '') = ''", selector=_part("iframe", "a_src"))),
    Rule("input-image-alt", "1.1.1", "A", "Image button without a text", _element("tag = 'input' AND lower(a_type) = 'image' AND coalesce(trim(a_alt), '') = '' AND coalesce(trim(a_aria_label), '') = ''", "'critical'", "concat('input[type=''image''][name=', chr(39), coalesce(a_name, ''), chr(39), ']')")),
    Rule("meta-refresh", "2.2.1", "A", "Timed refresh", _element("tag = 'meta' AND TRY_CAST(nullif(regexp_extract(raw, RX'(?i)http-equiv\\s*=\\s*[\"\\x27]refresh[\"\\x27][^>]*content\\s*=\\s*[\"\\x27]\\s*([0-9]+)', 1), '') AS INT) > 0", "'critical'", "'meta[http-equiv=''refresh'']'")),
    Rule("nested-interactive", "4.1.2", "A", "Interactive element inside another", "SELECT DISTINCT i.page_id, i.pos, 'major' AS severity, i.tag AS element_selector FROM {focusable} o JOIN {focusable} i ON i.page_id = o.page_id AND i.pos > o.pos AND i.pos < o.end_pos WHERE o.tag IN ('a', 'button')"),
    Rule("scrollable-region-focusable", "2.1.1", "A", "Scrolling region out of the keyboard's reach", "SELECT e.page_id, e.pos, 'major' AS severity, e.tag AS element_selector FROM {elements} e LEFT JOIN {focusable} f ON f.page_id = e.page_id AND f.pos >= e.pos AND f.pos < e.end_pos WHERE HAS(lower(e.a_style), RX'overflow[-xy]*\\s*:\\s*(auto|scroll)') AND f.pos IS NULL"),
    Rule("select-name", "4.1.2", "A", "Selection list without a name", Local("inputs", "tag = 'select' AND NOT has_label AND coalesce(aria_label, '') = '' AND coalesce(labelledby, '') = '' AND coalesce(title, '') = ''", "'critical'", "concat('select[name=', chr(39), name, chr(39), ']')")),
    Rule("svg-img-alt", "1.1.1", "A", "Drawing without a text", "SELECT e.page_id, e.pos, 'major' AS severity, 'svg[role=''img'']' AS element_selector FROM {elements} e LEFT JOIN {elements} t ON t.page_id = e.page_id AND t.tag = 'title' AND t.pos > e.pos AND t.pos < e.end_pos WHERE e.tag = 'svg' AND e.a_role = 'img' AND coalesce(e.a_aria_label, '') = '' AND coalesce(e.a_aria_labelledby, '') = '' AND t.pos IS NULL"),
    Rule("td-headers-attr", "1.3.1", "A", "Cell names a header that its table lacks", """SELECT c.page_id, c.pos, 'major' AS severity, 'td[headers]' AS element_selector FROM (SELECT d.page_id, d.pos, d.word, max(t.pos) AS table_pos FROM (SELECT page_id, pos, EACH(WORDS(a_headers)) AS word FROM {elements} WHERE tag = 'td' AND a_headers IS NOT NULL) d JOIN {elements} t ON t.page_id = d.page_id AND t.tag = 'table' AND d.pos > t.pos AND d.pos < t.end_pos GROUP BY d.page_id, d.pos, d.word) c
        LEFT JOIN (SELECT h.page_id, h.a_id AS id, t.pos AS table_pos FROM {elements} h JOIN {elements} t ON t.page_id = h.page_id AND t.tag = 'table' AND h.pos > t.pos AND h.pos < t.end_pos WHERE h.tag = 'th' AND h.a_id IS NOT NULL) h ON h.page_id = c.page_id AND h.table_pos = c.table_pos AND h.id = c.word WHERE h.id IS NULL"""),
    Rule("th-has-data-cells", "1.3.1", "A", "Header cell without data cells", """SELECT h.page_id, h.pos, 'major' AS severity, h.tag AS element_selector FROM (SELECT c.page_id, c.pos, c.tag, r.pos AS row_pos, max(t.pos) AS table_pos, row_number() OVER (PARTITION BY c.page_id, r.pos ORDER BY c.pos) AS col FROM {elements} c JOIN {elements} r ON r.page_id = c.page_id AND r.tag = 'tr' AND c.pos > r.pos AND c.pos < r.end_pos JOIN {elements} t ON t.page_id = c.page_id AND t.tag = 'table' AND c.pos > t.pos AND c.pos < t.end_pos WHERE c.tag IN ('th', 'td') GROUP BY c.page_id, c.pos, c.tag, r.pos) h
        LEFT JOIN (SELECT c.page_id, r.pos AS row_pos, max(t.pos) AS table_pos, row_number() OVER (PARTITION BY c.page_id, r.pos ORDER BY c.pos) AS col, c.tag FROM {elements} c JOIN {elements} r ON r.page_id = c.page_id AND r.tag = 'tr' AND c.pos > r.pos AND c.pos < r.end_pos JOIN {elements} t ON t.page_id = c.page_id AND t.tag = 'table' AND c.pos > t.pos AND c.pos < t.end_pos WHERE c.tag IN ('th', 'td') GROUP BY c.page_id, c.pos, c.tag, r.pos) d
        ON d.page_id = h.page_id AND d.tag = 'td' AND d.table_pos = h.table_pos AND (d.row_pos = h.row_pos OR d.col = h.col) WHERE h.tag = 'th' GROUP BY h.page_id, h.pos, h.tag HAVING count(d.tag) = 0"""),
    Rule("video-caption", "1.2.2", "A", "Video without captions", "SELECT e.page_id, e.pos, 'critical' AS severity, CASE WHEN coalesce(e.a_src, '') = '' THEN 'video' ELSE concat('video[src*=', chr(39), substring(e.a_src, 1, 50), chr(39), ']') END AS element_selector FROM {elements} e LEFT JOIN {elements} k ON k.page_id = e.page_id AND k.tag = 'track' AND lower(k.a_kind) IN ('captions', 'subtitles') AND k.pos > e.pos AND k.pos < e.end_pos WHERE e.tag = 'video' AND k.pos IS NULL"),
    Rule("meta-viewport-scale", "1.4.4", "AA", "Zooming is limited", """SELECT page_id, -1 AS pos, 'critical' AS severity, 'meta[name=''viewport'']' AS element_selector FROM {record} WHERE HAS(replace(lower(viewport), ' ', ''), RX'user-scalable=(no|0)') UNION ALL
        SELECT page_id, -1, 'major', 'meta[name=''viewport'']' FROM {record} WHERE TRY_CAST(regexp_extract(replace(lower(viewport), ' ', ''), RX'maximum-scale=([0-9.]+)', 1) AS DOUBLE) < 2"""),
    Rule("input-autocomplete", "1.3.5", "AA", "Field does not name its purpose", f"SELECT page_id, pos, 'major' AS severity, element_selector FROM (SELECT page_id, pos, concat('input[name=', chr(39), coalesce(a_name, ''), chr(39), ']') AS element_selector, {_COMBINED} AS said FROM {{elements}} WHERE {FIELD}) i WHERE {PURPOSE} IS NOT NULL"),
    Rule("lang-parts-valid", "3.1.2", "AA", "Passage with an unknown language code", _element(f"a_lang IS NOT NULL AND tag <> 'html' AND {_PRIMARY.format('a_lang')} <> '' AND {_PRIMARY.format('a_lang')} NOT IN ({_LANG_OK})", "'minor'")),
    Rule("text-spacing", "1.4.12", "AA", "Text spacing is locked", f"SELECT r.page_id, -1 AS pos, 'major' AS severity, p.prop AS element_selector FROM {{record}} r JOIN ({_SPACING}) p ON HAS(lower(r.html), {_PROP})"),
    Rule("aria-live-region", "4.1.3", "AA", "Live region contradicts its role", """SELECT page_id, pos, 'minor' AS severity, a_role AS element_selector FROM {elements} WHERE (a_role = 'alert' AND a_aria_live <> 'assertive') OR (a_role = 'status' AND a_aria_live <> 'polite') UNION ALL
        SELECT page_id, pos, 'major', a_role FROM {elements} WHERE a_role IN ('alert', 'status', 'log') AND a_aria_live = 'off'"""),
    Rule("multiple-ways", "2.4.5", "AA", "Only one way to find pages", "SELECT r.page_id, -1 AS pos, 'minor' AS severity, '' AS element_selector FROM {record} r LEFT JOIN {kinds} k ON k.page_id = r.page_id WHERE coalesce(has_nav, 0) + coalesce(has_search, 0) = 0 AND lower(html) NOT LIKE '%role=\"search\"%' AND lower(html) NOT LIKE '%type=\"search\"%' AND substring(lower(html), 1, 5000) NOT LIKE '%search%' AND lower(html) NOT LIKE '%sitemap%'"),
    Rule("img-alt-long", "1.1.1", "AA", "Image text is very long", _element("tag = 'img' AND length(a_alt) > 150", "'minor'", "concat('img[src*=', chr(39), substring(coalesce(a_src, ''), 1, 50), chr(39), ']')")),
    Rule("autocomplete-valid", "1.3.5", "AA", "Unknown autocomplete word", f"SELECT page_id, pos, 'major' AS severity, concat('input[name=', chr(39), name, chr(39), ']') AS element_selector FROM (SELECT page_id, pos, name, EACH(WORDS(a_autocomplete)) AS word FROM (SELECT page_id, pos, coalesce(a_name, '') AS name, lower(a_autocomplete) AS a_autocomplete FROM {{elements}} WHERE tag = 'input' AND lower(a_type) IN ('text', 'email', 'tel', 'url', 'password', 'search') AND trim(a_autocomplete) NOT IN ('off', 'on')) i) q WHERE word NOT IN ('shipping', 'billing') AND word NOT LIKE 'section-%' AND word NOT IN ({quoted(V.AUTOCOMPLETE)})"),
    Rule("avoid-inline-spacing", "1.4.12", "AA", "Inline style locks text spacing", f"SELECT e.page_id, e.pos, 'major' AS severity, p.prop AS element_selector FROM {{elements}} e JOIN ({_SPACING}) p ON HAS(lower(e.a_style), {_PROP})"),
    Rule("link-target-blank", "3.2.5", "AAA", "Link opens a new window unannounced", Local("links", "trim(target) = '_blank' AND " + " AND ".join(f"concat(lower(text), ' ', lower(aria_label)) NOT LIKE '%{w}%'" for w in V.NEW_WINDOW_WORDS), "'minor'", "concat('a[href=', chr(39), href, chr(39), ']')")),
]

#: The rule that judges captured focus styles instead of markup; see functions.contrast.
FOCUS_RULE = Rule("non-text-contrast", "1.4.11", "AA", "Focus outline is hard to see")
_BY_ID = {r.rule_id: r for r in [*RULES, FOCUS_RULE]}
_OWN: list[Rule] = []


def register(rule: Rule) -> None:
    """Adds a rule of one's own: a Rule with `check(page's elements)`, `build(elements, record)` or `sql`."""
    _OWN.append(rule)


def at_level(level: str) -> list[Rule]:
    """Rules up to a level; an unknown level means AA."""
    most = V.LEVELS.get(level, V.LEVELS["AA"])
    return [r for r in [*RULES, *_OWN] if V.LEVELS[r.level] <= most]


RECORD = """SELECT p.page_id, substring(p.html, 1, 50000) AS html, nullif(e.lang, '') AS lang, coalesce(e.title, '') AS title, nullif(e.viewport, '') AS viewport FROM {pages} p LEFT JOIN (
    SELECT page_id, min_by(CASE WHEN tag = 'html' THEN a_lang END, CASE WHEN tag = 'html' THEN pos END) AS lang, min_by(CASE WHEN tag = 'title' THEN text END, CASE WHEN tag = 'title' THEN pos END) AS title,
      min_by(CASE WHEN tag = 'meta' AND a_name = 'viewport' THEN a_content END, CASE WHEN tag = 'meta' AND a_name = 'viewport' THEN pos END) AS viewport
    FROM {elements} WHERE tag IN ('html', 'title', 'meta') GROUP BY page_id) e ON e.page_id = p.page_id"""


#: Tables that several rules read; stored once per audit.
SHARED = {"inputs", "links", "buttons", "headings", "kinds", "duplicate_ids", "focusable", "aria", "aria_attrs"}


def views(spark: SparkSession, pages: DataFrame, elements: DataFrame, store: bool = False) -> dict[str, DataFrame]:
    held = {"elements": elements, "pages": pages}
    held["record"] = spark.sql(render(RECORD, "spark"), pages=pages, elements=elements)
    if store:
        held["record"] = stored(held["record"], "record")
    for name, sql in VIEWS.items():
        held[name] = spark.sql(render(sql, "spark"), **{k: v for k, v in held.items() if "{" + k + "}" in sql})
        if store and name in SHARED:
            held[name] = stored(held[name], name)
    return held


_FOUND = pa.schema([("page_id", pa.int64()), ("severity", pa.string()), ("element_selector", pa.string()), ("pos", pa.int32())])


def _checked(rule: Rule, elements: DataFrame) -> DataFrame:
    """(page_id, severity, element_selector, pos) of a rule's check, page by page; a task reads its pages one after another, sorted, and holds one page and one batch at a time."""

    def judge(page: list[dict]) -> list[tuple]:
        try:
            found = [(page[0]["page_id"], severity, selector, pos) for severity, selector, pos in rule.check(page)]
            return list(zip(*(pa.array(c, f.type).to_pylist() for c, f in zip(zip(*found), _FOUND))))
        except Exception:  # whatever a rule of somebody else's raises is that rule's fault on that page
            return [(page[0]["page_id"], "info", "", -1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, page in groupby(rows, key=lambda e: e["page_id"]):
            if found := judge(list(page)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)

    return elements.repartition("page_id").sortWithinPartitions("page_id", "pos").mapInArrow(run, "page_id long, severity string, element_selector string, pos int")


def run_rule(spark: SparkSession, rule: Rule, held: dict[str, DataFrame]) -> DataFrame:
    """(page_id, rule_id, wcag_criterion, wcag_level, severity, element_selector, pos) of one rule."""
    if rule.check:
        found = _checked(rule, held["elements"])
    elif rule.build:
        found = rule.build(held["elements"], held["record"])
    else:
        found = spark.sql(render(str(rule.sql), "spark"), **{k: v for k, v in held.items() if "{" + k + "}" in str(rule.sql)})
    return found.select("page_id", F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.criterion).alias("wcag_criterion"), F.lit(rule.level).alias("wcag_level"), "severity", "element_selector", F.col("pos").cast("int").alias("pos"))


def run_local(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """The issues of all local rules of one table, in one pass over it."""
    lit = lambda x, name: F.lit(x).alias(name)
    expr = lambda x: F.expr(render(x, "spark"))
    found = [F.when(expr(r.sql.where), F.struct(lit(r.rule_id, "rule_id"), lit(r.criterion, "wcag_criterion"), lit(r.level, "wcag_level"), expr(r.sql.severity).alias("severity"), expr(r.sql.selector).alias("element_selector"), expr(r.sql.pos).cast("int").alias("pos"))) for r in rules]
    return table.select("page_id", F.inline(F.array_compact(F.array(*found))))


def broken_viewports(record: DataFrame) -> DataFrame:
    """Pages whose scale can't be read: the rule fails there, which is an `info` issue instead of the rule's own."""
    scale = F.regexp_extract(F.replace(F.lower("viewport"), F.lit(" "), F.lit("")), r"maximum-scale=([0-9.]+)", 1)
    return record.where((scale != "") & scale.try_cast("double").isNull()).select("page_id")


def focus_issues(focus_styles: DataFrame) -> DataFrame:
    """The focus rule's issues of captured focus_styles(page_id, outline_color, has_outline_none)."""
    r = FOCUS_RULE
    lit = lambda x, name: F.lit(x).alias(name)
    return contrast.weak_focus(focus_styles).select("page_id", lit(r.rule_id, "rule_id"), lit(r.criterion, "wcag_criterion"), lit(r.level, "wcag_level"), lit("major", "severity"), lit("", "element_selector"), F.lit(-1).alias("pos"))


def audit(spark: SparkSession, pages: DataFrame, elements: DataFrame, level: str = "AA", focus_styles: DataFrame | None = None) -> DataFrame:
    """All issues of pages(page_id, html) up to a level, as one table; with captured focus styles also those of the focus rule."""
    held = views(spark, pages, stored(elements, "elements"), store=True)
    rules = at_level(level)
    local = [r for r in rules if isinstance(r.sql, Local)]
    tables = sorted({r.sql.table for r in local})
    parts = [run_local(held[t], [r for r in local if r.sql.table == t]) for t in tables]
    issues = reduce(DataFrame.unionByName, parts + [run_rule(spark, r, held) for r in rules if not isinstance(r.sql, Local)])
    if focus_styles is not None and V.LEVELS[FOCUS_RULE.level] <= V.LEVELS.get(level, V.LEVELS["AA"]):
        issues = issues.unionByName(focus_issues(focus_styles))
    broken = broken_viewports(held["record"])
    if any(r.rule_id == "meta-viewport-scale" for r in rules):
        kept = issues.join(broken.withColumn("rule_id", F.lit("meta-viewport-scale")), ["page_id", "rule_id"], "left_anti").select(issues.columns)
        r = _BY_ID["meta-viewport-scale"]
        error = broken.select("page_id", F.lit(r.rule_id).alias("rule_id"), F.lit(r.criterion).alias("wcag_criterion"), F.lit(r.level).alias("wcag_level"), F.lit("info").alias("severity"), F.lit("").alias("element_selector"), F.lit(-1).alias("pos"))
        issues = kept.unionByName(error)
    return issues


def expected_purposes(elements: DataFrame) -> DataFrame:
    """(page_id, pos, expected, recommendation) of the fields that don't name their purpose, with the autocomplete word that their names call for."""
    fields = elements.selectExpr("page_id", "pos", f"{_COMBINED} AS said", f"({render(FIELD, 'spark')}) AS judged")
    found = fields.where("judged").select("page_id", "pos", F.expr(render(PURPOSE, "spark")).alias("expected")).where("expected IS NOT NULL")
    return found.withColumn("recommendation", F.format_string("Say autocomplete=\"%s\" on this field.", "expected"))


def with_texts(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """Adds title, recommendation, detected_by and confidence from the catalogue."""
    rows = [(r.rule_id, r.title, f"See success criterion {r.criterion} (level {r.level}).") for r in [*RULES, FOCUS_RULE, *_OWN]]
    catalogue = spark.createDataFrame(rows, "rule_id string, title string, recommendation string")
    return issues.join(F.broadcast(catalogue), "rule_id", "left").withColumn("detected_by", F.lit("rule")).withColumn("confidence", F.lit(1.0))


# The same in DuckDB's SQL, for comparison.
def duck_views(names: set[str] | None = None) -> str:
    out = [f"record AS ({render(RECORD, 'duck').format(pages='rich', elements='elements')})"]
    known = {"elements": "elements", "record": "record"} | {k: f"v_{k}" for k in VIEWS}
    out += [f"v_{k} AS ({render(sql, 'duck').format(**known)})" for k, sql in VIEWS.items()]
    return ",\n".join(out)


def duck_rule(rule: Rule) -> str:
    known = {"elements": "elements", "record": "record"} | {k: f"v_{k}" for k in VIEWS}
    body = render(str(rule.sql), "duck").format(**known)
    return f"SELECT page_id, '{rule.rule_id}' AS rule_id, '{rule.criterion}' AS wcag_criterion, '{rule.level}' AS wcag_level, severity, element_selector, pos::INTEGER AS pos FROM ({body})"
