"""Markup as tables: tokens, elements with attributes, extents and text.

Everything is column expressions and windows per page; no row leaves the JVM. An element's extent
comes from same-tag nesting levels (opens and closes of a level alternate), ancestry is an
equi-join on the page with an interval residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags without content, attributes that become columns, tags whose text is gathered.
VOID = ["area", "base", "br", "col", "embed", "frame", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
ATTRIBUTES = [
    "alt", "src", "href", "id", "name", "type", "role", "tabindex", "title", "value", "lang", "style", "class", "for", "target", "placeholder", "autocomplete",
    "headers", "content", "http-equiv", "kind", "action", "method", "aria-label", "aria-labelledby", "aria-hidden", "aria-live", "scope",
]
FLAGS = ["required", "autoplay", "muted", "disabled", "hidden", "onclick"]
TEXT_TAGS = ["a", "button", "h1", "h2", "h3", "h4", "h5", "h6", "label", "title", "th", "td", "option", "div", "svg"]

RAW_TEXT = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
TAG = r"""(</?[a-zA-Z][^>"']*+(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+>)([^<]*)"""


#: A name and, perhaps, a value; taken one after another, so that nothing within a value is read as a name.
ATTRIBUTE = r"""\s([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def column_name(attribute: str) -> str:
    return "a_" + attribute.replace("-", "_")


def attribute_values(values: Column) -> Column:
    """Values without quotes and with their entities read; null where a name has no value. The array is that of ATTRIBUTE's second parts."""

    def one(v: Column) -> Column:
        bare = F.when(v.rlike("""^["']"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.when(v != "", F.when(v.contains("&"), unescape(bare)).otherwise(bare))

    return F.transform(values, one)


def attribute(names: Column, values: Column, name: str) -> Column:
    """The first value of an attribute; null if it is absent or has no value."""
    return F.get(values, F.array_position(names, name).cast("int") - 1)


def unescape(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split(pages: DataFrame) -> DataFrame:
    """pages and their parts: an array of every tag in order, with the text after it. Pages that have been split stay as they are, so that a stored table isn't searched again."""
    if "parts" in pages.columns:
        return pages
    found = lambda part: F.regexp_extract_all("clean", F.lit(TAG), F.lit(part))
    clean = pages.withColumn("clean", F.regexp_replace("html", RAW_TEXT, ""))
    return clean.withColumn("parts", F.arrays_zip(found(1).alias("raw"), found(2).alias("text_after"))).drop("clean")


def tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, is_close, raw, text_after) of every tag, in order."""
    t = split(pages).select("page_id", F.posexplode("parts").alias("pos", "t"))
    raw = F.col("t.raw")
    return t.select("page_id", "pos", F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"), raw.startswith("</").alias("is_close"), raw.alias("raw"), F.col("t.text_after").alias("text_after"))


def _extents(pages: DataFrame) -> DataFrame:
    """(page_id, found): an array of each page's elements (pos, offset, tag, end), from its tokens without their markup. The ends are those of tags, (pos, offset)."""
    t = tokens(pages).select("page_id", "pos", "tag", "is_close", F.length("text_after").alias("size"))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("at", F.struct("pos", (F.sum("size").over(before) - F.col("size")).cast("int").alias("offset"))).drop("size")
    order = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("void", F.col("tag").isin(VOID)).withColumn("level", F.sum(F.when(F.col("void"), 0).when(F.col("is_close"), -1).otherwise(1)).over(order) + F.col("is_close").cast("int"))
    same = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    t = t.withColumn("close", F.when(F.col("void"), F.col("at")).when(F.lead("is_close").over(same), F.lead("at").over(same)))
    p = t.groupBy("page_id").agg(F.collect_list(F.when(~F.col("is_close"), F.struct("at", "tag", "void", "close"))).alias("opened"), F.max("at").alias("last"))
    p = p.withColumn("closed", F.filter("opened", lambda x: x["close"].isNotNull() & ~x["void"]))
    # an unclosed element ends with the nearest closed element around it, else with the page
    around = lambda x: F.filter("closed", lambda c: (c["at"]["pos"] < x["at"]["pos"]) & (x["at"]["pos"] < c["close"]["pos"]))
    end = lambda x: F.coalesce(x["close"], F.array_min(F.transform(around(x), lambda c: c["close"])), F.col("last"))
    return p.select("page_id", F.transform("opened", lambda x: F.struct(x["at"]["pos"].alias("pos"), x["at"]["offset"].alias("offset"), x["tag"].alias("tag"), end(x).alias("end"))).alias("found"))


def elements(pages: DataFrame, with_text: Column | None = None) -> DataFrame:
    """(page_id, pos, end_pos, tag, raw, text, a_*, has_*) of every element. An element spans the tokens pos .. end_pos; its text is cut out of its page's at the offsets of both, for TEXT_TAGS and what with_text(tag, raw) holds for.

    Extents are found on slim rows and meet the page's markup in one join on the page, so that markup is shuffled once and sorted never by token.
    """
    pages = split(pages).select("page_id", "parts")
    p = pages.join(_extents(pages), "page_id").select("page_id", "parts", F.array_join("parts.text_after", "").alias("page_text"), F.explode("found").alias("e"))
    e = p.select("page_id", "e.pos", F.col("e.end.pos").alias("end_pos"), "e.tag", F.get("parts", F.col("e.pos"))["raw"].alias("raw"), "page_text", F.col("e.offset").alias("offset"), (F.col("e.end.offset") - F.col("e.offset")).alias("size"))
    part = strip(unescape(F.substring("page_text", F.col("offset") + 1, F.col("size"))))
    e = e.select("page_id", "pos", "end_pos", "tag", "raw", F.when(F.col("tag").isin(TEXT_TAGS) if with_text is None else F.col("tag").isin(TEXT_TAGS) | with_text, part).otherwise("").alias("text"))
    found = lambda part: F.regexp_extract_all("raw", F.lit(ATTRIBUTE), F.lit(part))
    e = e.select("*", F.transform(found(1), F.lower).alias("names"), attribute_values(found(2)).alias("values"))
    names, values = F.col("names"), F.col("values")
    # with array_contains for flags, Spark makes one method of 9 KB of all these columns, and the JVM compiles none of more than 8,000 bytes; with exists, it makes small ones
    has = lambda a: F.exists(names, lambda n: n == a)
    return e.select("page_id", "pos", "end_pos", "tag", "raw", *(attribute(names, values, a).alias(column_name(a)) for a in ATTRIBUTES), *(has(a).alias(f"has_{a}") for a in [*FLAGS, "alt"]), "text")


# The same tables in DuckDB's SQL, for comparison.
def _duck_attribute(name: str) -> str:
    v = f"""regexp_extract(raw, '(?i)\\s{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1)"""
    bare = f"CASE WHEN {v}[1] IN ('\"', '''') THEN substr({v}, 2, length({v}) - 2) ELSE {v} END"
    return f"CASE WHEN {v} <> '' THEN {_duck_unescape(bare)} END"


def _duck_unescape(x: str) -> str:
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {char})"
    return x


def duck_elements(pages: str, with_text: str = "false") -> str:
    """CTEs `tk`, `elements` over a CTE or table `pages` (page_id, html)."""
    tag = TAG.replace("*+", "*").replace("'", "''")
    raw_text = RAW_TEXT.replace("'", "''")
    void = ", ".join(f"'{x}'" for x in VOID)
    columns = ", ".join([f"{_duck_attribute(a)} AS {column_name(a)}" for a in ATTRIBUTES] + [f"regexp_matches(raw, '(?i)\\s{a}(\\s|=|/|>)') AS has_{a}" for a in [*FLAGS, "alt"]])
    text_tags = ", ".join(f"'{x}'" for x in TEXT_TAGS)
    return f"""
cl AS (SELECT page_id, regexp_replace(html, '{raw_text}', '', 'g') AS clean FROM {pages}),
ar AS (SELECT page_id, regexp_extract_all(clean, '{tag}', 1) AS r, regexp_extract_all(clean, '{tag}', 2) AS x FROM cl),
t0 AS (SELECT page_id, i - 1 AS pos, r[i] AS raw, x[i] AS text_after FROM (SELECT page_id, r, x, unnest(range(1, len(r) + 1)) AS i FROM ar)),
tk AS (SELECT page_id, pos::INTEGER AS pos, lower(regexp_extract(raw, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, starts_with(raw, '</') AS is_close, raw, text_after FROM t0),
t1 AS (SELECT *, tag IN ({void}) AS void FROM tk),
t2 AS (SELECT *, sum(CASE WHEN void THEN 0 WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) + is_close::INT AS level, max(pos) OVER (PARTITION BY page_id) AS last FROM t1),
t3 AS (SELECT *, CASE WHEN lead(is_close) OVER w THEN lead(pos) OVER w END AS close FROM t2 WINDOW w AS (PARTITION BY page_id, tag, level ORDER BY pos)),
e0 AS (SELECT * REPLACE (CASE WHEN void THEN pos ELSE close END AS close) FROM t3 WHERE NOT is_close),
lost AS (SELECT e.page_id, e.pos, min(o.close) AS outer_end FROM e0 e JOIN e0 o ON e.page_id = o.page_id AND e.close IS NULL AND o.close IS NOT NULL AND NOT o.void AND o.pos < e.pos AND e.pos < o.close GROUP BY ALL),
e1 AS (SELECT e.page_id, e.pos, coalesce(close, outer_end, last) AS end_pos, tag, raw FROM e0 e LEFT JOIN lost l ON e.page_id = l.page_id AND e.pos = l.pos),
tx AS (SELECT e.page_id, e.pos, regexp_replace({_duck_unescape("string_agg(t.text_after, '' ORDER BY t.pos)")}, '^\\s+|\\s+$', '', 'g') AS text FROM e1 e JOIN tk t ON e.page_id = t.page_id AND t.pos >= e.pos AND t.pos < e.end_pos AND (e.tag IN ({text_tags}) OR {with_text}) GROUP BY ALL),
elements AS (SELECT e1.page_id, e1.pos, end_pos, tag, raw, coalesce(text, '') AS text, {columns} FROM e1 LEFT JOIN tx ON e1.page_id = tx.page_id AND e1.pos = tx.pos)"""
