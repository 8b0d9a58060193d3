"""Page records: whole nested rows, with each list as JSON, so that engines can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..operators import record, rules
from ..sources import pages as P
from . import entities

_RICH = f"rich AS (SELECT page_id, url, {P.rich_sql()} AS html FROM pages)"
_NAMED = record.NAMED.replace("'", "''")
_HASHES = entities.ORACLES["e17_content_hash"].replace(f"{entities._PRE},", "WITH")
_TEXT = lambda n: f"text[1:{n}]"


def _listed(name: str, source: str, fields: dict[str, str], where: str = "true", cap: int = 1 << 30) -> str:
    """A CTE of one list a page."""
    struct = ", ".join(f"'{k}': {v}" for k, v in fields.items())
    return f"l_{name} AS (SELECT page_id, to_json(list({{{struct}}} ORDER BY pos))::VARCHAR AS {name} FROM (SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= {cap}) q GROUP BY page_id)"


def _size(name: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(raw, '(?i)\\s{name}\\s*=\\s*[\"'']?([0-9]{{1,9}})', 1), '') AS INT)"


def _absolute(reference: str) -> str:
    return urls.duck_resolve("url", reference)


_NAMES = {"aria_label": "aria_label", "aria_labelledby": "labelledby", "title": "title"}
_FORMS = f"""trimmed AS (SELECT e.*, url, regexp_replace(coalesce(a_src, ''), '^\\s+|\\s+$', '', 'g') AS src, regexp_replace(coalesce(a_action, ''), '^\\s+|\\s+$', '', 'g') AS act FROM elements e JOIN pages USING (page_id)),
 linked AS (SELECT v.*, url, regexp_replace(href, '^\\s+|\\s+$', '', 'g') AS ref FROM v_links v JOIN pages USING (page_id)),
 fields AS (SELECT page_id, form_pos, list({{'tag': tag, 'type': kind, 'name': name, 'id': coalesce(id, ''), 'has_label': has_label, 'aria_label': aria_label, 'placeholder': coalesce(placeholder, ''), 'required': required}} ORDER BY pos) AS inputs FROM v_inputs GROUP BY ALL),
 filled AS (SELECT t.*, coalesce(inputs, []) AS inputs FROM trimmed t LEFT JOIN fields f ON f.page_id = t.page_id AND f.form_pos = t.pos WHERE tag = 'form')"""
_LISTS = {
    "headings": ("elements", {"level": "tag[2:2]::INT", "text": _TEXT(200), "id": "nullif(a_id, '')"}, "regexp_matches(tag, '^h[1-6]$')"),
    "images": ("trimmed", {"src": f"CASE WHEN coalesce(a_src, '') = '' THEN '' ELSE {_absolute('src')} END", "alt": "coalesce(a_alt, '')", "has_alt": "has_alt", "width": _size("width"), "height": _size("height"), "role": "a_role"}, "tag = 'img'"),
    "tabindex_elements": ("elements", {"tag": "tag", "tabindex": "TRY_CAST(nullif(regexp_extract(a_tabindex, '^\\s*([+-]?[0-9]+)', 1), '') AS INT)", "text": _TEXT(60), "role": "a_role"}, "a_tabindex IS NOT NULL", 100),
    "autocomplete_inputs": (
        "elements",
        {"tag": "tag", "type": "lower(a_type)", "name": "coalesce(a_name, '')", "id": "coalesce(a_id, '')", "autocomplete": "coalesce(a_autocomplete, '')", "aria_label": "a_aria_label", "placeholder": "coalesce(a_placeholder, '')"},
        "tag = 'input' AND lower(a_type) IN ('text', 'email', 'tel', 'url', 'password', 'search')",
        50,
    ),
    "lang_parts": ("elements", {"tag": "tag", "lang": "a_lang", "text": _TEXT(80)}, "a_lang IS NOT NULL AND tag <> 'html'", 50),
    "aria_live_regions": ("elements", {"tag": "tag", "role": "a_role", "aria_live": "a_aria_live", "text": _TEXT(100)}, "a_aria_live IS NOT NULL OR a_role IN ('alert', 'status', 'log', 'marquee', 'timer')", 20),
    "forms": ("filled", {"action": _absolute("act"), "method": "lower(coalesce(nullif(a_method, ''), 'get'))", "inputs": "inputs"}),
    "links": ("linked", {"href": _absolute("ref"), "text": "text", "target": "target", **_NAMES}, "true", 200),
    "interactive_elements": ("v_buttons", {"tag": "tag", "text": "text", "type": "type", **_NAMES, "value": "value", "disabled": "disabled"}),
    "landmarks": ("v_landmarks", {"tag": "tag", "role": "role", "aria_label": "aria_label"}),
    "duplicate_ids": ("v_duplicate_ids", {"id": "id", "count": "n"}),
}


def _records(s: SparkSession, d: str) -> DataFrame:
    r = record.page_records(s, P.rich(P.scan(s, d)))
    return r.select(*(F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if c in _LISTS else F.col(c) for c in r.columns))


QUERIES = {"e21_page_record": _records}
ORACLES = {
    "e21_page_record": f"""WITH {_RICH}, {markup.duck_elements("rich", f"(regexp_matches(e.raw, '{_NAMED}') AND e.tag <> 'html')")},
{rules.duck_views()}, hashes AS ({_HASHES}), {_FORMS}, {", ".join(_listed(name, *how) for name, how in _LISTS.items())}
 SELECT p.page_id, url, coalesce(title, '') AS title, coalesce(lang, '') AS lang, coalesce(viewport, '') AS viewport_meta, p.html[1:50000] AS html, content_hash, {", ".join(f"coalesce({name}, '[]') AS {name}" for name in _LISTS)}
 FROM rich p JOIN record USING (page_id) LEFT JOIN hashes USING (page_id) {" ".join(f"LEFT JOIN l_{name} USING (page_id)" for name in _LISTS)}"""
}
