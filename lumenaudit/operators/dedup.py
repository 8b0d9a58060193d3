"""Page duplicates: exact by content hash, template by structural signature; greedy in arrival order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import split, strip
from ..sources.stored import stored
from .components import components

KEPT_PER_TEMPLATE = 3


def content_hash(elements: DataFrame, tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, content_hash): 16 hex digits over the first 500 tags under main, or else body, and its first 5000 characters of text; of the URL where there is neither. The text is cut out of a page's parts, in its own row; tokens aren't read for it."""
    root = elements.where("tag IN ('main', 'body')").groupBy("page_id").agg(F.min_by(F.struct("pos", "end_pos"), F.struct(F.when(F.col("tag") == "main", 0).otherwise(1).alias("o"), F.col("pos").alias("p"))).alias("root"))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    inside = elements.join(root, "page_id").where("pos > root.pos AND pos < root.end_pos").withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("nth <= 500")
    tags = inside.groupBy("page_id").agg(F.array_join(ordered("tag"), ",").alias("tags"))
    found = split(pages).select("page_id", "url", F.col("parts.text_after").alias("between")).join(root, "page_id", "left")
    text = F.array_join(F.slice("between", F.col("root.pos") + 1, F.col("root.end_pos") - F.col("root.pos")), "")
    found = found.select("page_id", "url", "root", text.alias("text")).join(tags, "page_id", "left")
    content = F.concat(F.coalesce("tags", F.lit("")), F.lit("|"), F.substring(strip(F.coalesce("text", F.lit(""))), 1, 5000))
    return found.select("page_id", F.substring(F.sha2(F.when(F.col("root").isNull(), F.col("url")).otherwise(content), 256), 1, 16).alias("content_hash"))


def signature(elements: DataFrame) -> DataFrame:
    """(page_id, signature): 12 hex digits over counts of headings, forms, landmarks and images, levels, inputs per form and roles."""
    mark = F.col("tag").isin("main", "nav", "header", "footer", "aside") | F.coalesce(F.col("a_role").isin("main", "navigation", "banner", "contentinfo", "complementary", "search", "region"), F.lit(False))
    head = F.col("tag").rlike("^h[1-6]$")
    ordered = lambda cond, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("pos", value.alias("v"))))), lambda x: x["v"]), ",")
    a = elements.groupBy("page_id").agg(
        F.count_if(head).alias("h"), F.count_if(F.col("tag") == "form").alias("f"), F.count_if(mark).alias("l"), F.count_if(F.col("tag") == "img").alias("i"), ordered(head, F.substring("tag", 2, 1)).alias("levels"), ordered(mark, F.coalesce("a_role", "tag")).alias("roles")
    )
    forms = elements.where("tag = 'form'").select("page_id", F.col("pos").alias("a"), F.col("end_pos").alias("b"))
    fields = elements.where("tag IN ('input', 'select', 'textarea')").select(F.col("page_id").alias("p2"), "pos")
    per = forms.join(fields, (F.col("page_id") == F.col("p2")) & (F.col("pos") > F.col("a")) & (F.col("pos") < F.col("b")), "left").groupBy("page_id", "a").agg(F.count("pos").alias("n"))
    per = per.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "n"))), lambda x: x["n"].cast("string")), ",").alias("inputs"))
    text = F.concat_ws("|", F.concat(F.lit("h:"), "h"), F.concat(F.lit("f:"), "f"), F.concat(F.lit("l:"), "l"), F.concat(F.lit("i:"), "i"), "levels", F.coalesce("inputs", F.lit("")), "roles")
    return a.join(per, "page_id", "left").select("page_id", F.substring(F.md5(text), 1, 12).alias("signature"))


def _functional(pages: DataFrame) -> DataFrame:
    """The decision where every content hash of a site has one signature: two window passes."""
    first = Window.partitionBy("site", "content_hash").orderBy("page_id")
    p = pages.withColumn("first_id", F.first("page_id").over(first)).withColumn("is_first", F.col("first_id") == F.col("page_id"))
    group = Window.partitionBy("site", "signature").orderBy("page_id")
    p = p.withColumn("nth", F.sum(F.col("is_first").cast("int")).over(group)).withColumn("leader", F.first("page_id").over(group))
    kept = F.col("is_first") & (F.col("nth") <= KEPT_PER_TEMPLATE)
    p = p.withColumn("first_kept", F.max(F.when(kept, F.col("page_id"))).over(Window.partitionBy("site", "content_hash")))
    return p.select("page_id", "site", "content_hash", "signature", (~kept).alias("is_duplicate"), F.when(kept, None).otherwise(F.coalesce("first_kept", "leader")).alias("original_id"))


def _kept(rows: pd.DataFrame) -> pd.DataFrame:
    """The pages that stay of one component, from the first page of each pair of content and signature in arrival order."""
    taken: set[str] = set()
    members: dict[str, int] = {}
    keep = []
    for h, s in zip(rows["content_hash"], rows["signature"]):
        stays = h not in taken and members.get(s, 0) < KEPT_PER_TEMPLATE
        keep.append(stays)
        if stays:
            taken.add(h)
            members[s] = members.get(s, 0) + 1
    return rows[keep]


_PAIR = "page_id long, site string, content_hash string, signature string"


def _chained(pages: DataFrame) -> DataFrame:
    """The decision where one content has several signatures.

    Only the first page of a (content, signature) can stay: if it doesn't, the content has been kept already, or the
    template is full and stays full. So the pages that stay follow from these pairs, and pairs influence each other only within a
    connected component of contents and signatures; one component is one sequential group. All other pages are then joined to what stays.
    """
    first = stored(pages.groupBy("site", "content_hash", "signature").agg(F.min("page_id").alias("page_id")), "pairs")
    name = lambda kind, c: F.concat_ws("|", "site", F.lit(kind), c)
    label = components(first.select(name("c", "content_hash").alias("a"), name("s", "signature").alias("b")))
    groups = first.withColumn("node", name("s", "signature")).join(label, "node")
    run = lambda rows: _kept(rows.sort_values("page_id"))[["page_id", "site", "content_hash", "signature"]]
    kept = stored(groups.select("component", *(c.split()[0] for c in _PAIR.split(", "))).groupBy("component").applyInPandas(run, _PAIR), "kept")
    by_content = kept.select("site", "content_hash", F.col("page_id").alias("copy_of"))  # a content stays once
    leaders = kept.groupBy("site", "signature").agg(F.min("page_id").alias("leader"))
    p = pages.join(by_content, ["site", "content_hash"], "left").join(leaders, ["site", "signature"], "left")
    stays = F.coalesce(F.col("copy_of") == F.col("page_id"), F.lit(False))
    before = F.when(F.col("copy_of") < F.col("page_id"), F.col("copy_of"))  # a content that stays later doesn't count yet
    return p.select("page_id", "site", "content_hash", "signature", (~stays).alias("is_duplicate"), F.when(~stays, F.coalesce(before, "leader")).alias("original_id"))


def decide(pages: DataFrame) -> DataFrame:
    """(…, is_duplicate, original_id) for pages(page_id, site, content_hash, signature), in the order of page_id. Only sites where a content has several signatures take the sequential way."""
    pages = pages.select("page_id", "site", "content_hash", "signature")
    chained = pages.groupBy("site", "content_hash").agg(F.min("signature").alias("a"), F.max("signature").alias("b")).where("a <> b").select("site").distinct()
    chained = stored(chained, "chained")
    return _functional(pages.join(chained, "site", "left_anti")).unionByName(_chained(pages.join(chained, "site", "left_semi")))


def template_groups(decided: DataFrame) -> DataFrame:
    """(site, signature, members) of templates with several kept pages."""
    return decided.where("NOT is_duplicate").groupBy("site", "signature").agg(F.sort_array(F.collect_list("page_id")).alias("members")).where(F.size("members") > 1)
