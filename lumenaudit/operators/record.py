"""The whole record of a page as one nested row: an array of structs for each of its lists, in document order and with their caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..sources.stored import stored
from . import dedup, rules

#: How many entries a list has at most, characters of a text in it, types of inputs that take personal data, roles of live regions.
CAPS = {"tabindex_elements": 100, "autocomplete_inputs": 50, "lang_parts": 50, "aria_live_regions": 20}
TEXTS = {"headings": 200, "tabindex_elements": 60, "lang_parts": 80, "aria_live_regions": 100}
PERSONAL = ["text", "email", "tel", "url", "password", "search"]
LIVE = ["alert", "status", "log", "marquee", "timer"]
#: Elements whose text a list holds beside markup.TEXT_TAGS: those with one of these attributes, but for the root.
NAMED = r"(?i)\s(tabindex|lang|aria-live|role)[\s=/>]"


def _ordered(struct: Column, fields: list[str], cap: int | None = None) -> Column:
    """The structs of a group by their pos, the first cap of them, without it; nulls are no entries."""
    rows = F.sort_array(F.collect_list(struct))
    rows = rows if cap is None else F.slice(rows, 1, cap)
    return F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def _number(name: str) -> Column:
    return F.regexp_extract("raw", rf"""(?i)\s{name}\s*=\s*["']?([0-9]{{1,9}})""", 1).try_cast("int")


def _of_elements(e: DataFrame) -> DataFrame:
    """The lists that elements(…, url) give by themselves, in one aggregate a page."""
    text = lambda name: F.substring("text", 1, TEXTS[name]).alias("text")
    has, tag, role, type_ = (lambda a: F.col(a).isNotNull()), F.col("tag"), F.col("a_role").alias("role"), F.lower("a_type")
    src = F.when(F.coalesce("a_src", F.lit("")) != "", urls.resolve(F.col("url"), F.col("a_src"))).otherwise("")
    lists = {
        "headings": (tag.rlike("^h[1-6]$"), [F.substring("tag", 2, 1).try_cast("int").alias("level"), text("headings"), F.nullif(F.col("a_id"), F.lit("")).alias("id")]),
        "images": (tag == "img", [src.alias("src"), F.coalesce("a_alt", F.lit("")).alias("alt"), F.col("has_alt"), _number("width").alias("width"), _number("height").alias("height"), role]),
        "tabindex_elements": (has("a_tabindex"), [tag, F.regexp_extract("a_tabindex", r"^\s*([+-]?[0-9]+)", 1).try_cast("int").alias("tabindex"), text("tabindex_elements"), role]),
        "autocomplete_inputs": (
            (tag == "input") & type_.isin(PERSONAL),
            [tag, type_.alias("type"), *(F.coalesce(f"a_{c}", F.lit("")).alias(c) for c in ("name", "id", "autocomplete")), F.col("a_aria_label").alias("aria_label"), F.coalesce("a_placeholder", F.lit("")).alias("placeholder")],
        ),
        "lang_parts": (has("a_lang") & (tag != "html"), [tag, F.col("a_lang").alias("lang"), text("lang_parts")]),
        "aria_live_regions": (has("a_aria_live") | F.col("a_role").isin(LIVE), [tag, role, F.col("a_aria_live").alias("aria_live"), text("aria_live_regions")]),
    }
    names = {k: e.select(*fields).columns for k, (_, fields) in lists.items()}
    return e.groupBy("page_id").agg(*(_ordered(F.when(where, F.struct("pos", *fields)), names[k], CAPS.get(k)).alias(k) for k, (where, fields) in lists.items()))


def _of_view(view: DataFrame, name: str, fields: dict[str, str], *keys: str) -> DataFrame:
    return view.groupBy(*keys).agg(_ordered(F.struct("pos", *(F.col(c).alias(f) for f, c in fields.items())), list(fields)).alias(name))


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row for each of pages(page_id, url, html): its scalars, its markup up to 50,000 characters, its content hash, and its lists.

    References are absolute. Width and height are those that the markup states, since nothing is rendered; a form without an action sends to its page,
    without a method by get. Texts and colours as rendered aren't in markup and so not in the record. A page without elements has empty lists, and a
    missing scalar is empty. A list is gathered whole for each page, whose markup is one row already, and never for more than a page.
    """
    pages = stored(markup.split(pages).select("page_id", "url", "html", "parts"), "pages")
    e = stored(markup.elements(pages, F.col("raw").rlike(NAMED) & (F.col("tag") != "html")), "elements")
    v, url = rules.views(spark, pages, e), pages.select("page_id", "url")
    links = v["links"].join(url, "page_id").withColumn("href", urls.resolve(F.col("url"), F.col("href")))
    inputs = v["inputs"].withColumn("id", F.coalesce("id", F.lit(""))).withColumn("placeholder", F.coalesce("placeholder", F.lit("")))
    inputs = _of_view(inputs, "inputs", {"tag": "tag", "type": "kind", **{c: c for c in ("name", "id", "has_label", "aria_label", "placeholder", "required")}}, "page_id", "form_pos")
    forms = e.where("tag = 'form'").join(url, "page_id").select("page_id", "pos", urls.resolve(F.col("url"), F.coalesce("a_action", F.lit(""))).alias("action"), F.lower(F.coalesce(F.nullif(F.col("a_method"), F.lit("")), F.lit("get"))).alias("method"))
    forms = forms.join(inputs.withColumnRenamed("form_pos", "pos"), ["page_id", "pos"], "left")
    forms = forms.withColumn("inputs", F.coalesce("inputs", F.array().cast(inputs.schema["inputs"].dataType)))
    named = {"aria_label": "aria_label", "aria_labelledby": "labelledby", "title": "title"}
    lists = [
        _of_elements(e.join(url, "page_id")),
        _of_view(forms, "forms", {c: c for c in ("action", "method", "inputs")}, "page_id"),
        _of_view(links, "links", {"href": "href", "text": "text", "target": "target", **named}, "page_id"),
        _of_view(v["buttons"], "interactive_elements", {"tag": "tag", "text": "text", "type": "type", **named, "value": "value", "disabled": "disabled"}, "page_id"),
        _of_view(v["landmarks"], "landmarks", {c: c for c in ("tag", "role", "aria_label")}, "page_id"),
        _of_view(v["duplicate_ids"], "duplicate_ids", {"id": "id", "count": "n"}, "page_id"),
    ]
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    out = v["record"].withColumnRenamed("viewport", "viewport_meta").select("page_id", empty("title"), empty("lang"), empty("viewport_meta"), "html")
    out = url.join(out, "page_id").join(dedup.content_hash(e, markup.tokens(pages), pages), "page_id", "left")
    for part in lists:
        out = out.join(part, "page_id", "left")
    kinds = {f.name: f.dataType for part in lists for f in part.schema if f.name != "page_id"}
    return out.select(*(c for c in out.columns if c not in kinds), *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in kinds.items()))
