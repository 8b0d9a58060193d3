"""Issues placed on a page's captured boxes: by selector, by the element's markup, by hints in the selector, then by place.

How well a box fits an issue is worked out in columns, over a join on the page, for every box of it. Only the choice, where
each box goes to one issue and earlier issues choose first, is sequential: a page's fitting pairs come sorted, in batches, and are never held together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.snippets import markup_attribute, markup_tag, normal_text, selector_tag
from ..sources.stored import stored

# The least score of a match, and what an agreement counts.
LEAST = 2
TAG, ALT, LABEL, TEXT, SOURCE, IDENTIFIER = 1, 3, 3, 2, 2, 3


def _hint(selector: Column, name: str) -> Column:
    return F.coalesce(F.regexp_extract(selector, rf"""(?i)\[{name}\s*[*~|^$]?=\s*['"]([^'"]+)['"]\]""", 1), F.lit(""))


def _points(*agreements: tuple[int, Column]) -> Column:
    return sum((F.when(agrees, n).otherwise(0) for n, agrees in agreements), F.lit(0))


def _within(a: Column, b: Column) -> Column:
    """Either holds the other; neither is empty."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def fits(issues: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, issue, box, exact, by_markup, by_selector) of pairs that fit in one way at least; scores are 0 where a tag contradicts or nothing is known."""
    text = lambda c: F.coalesce(c, F.lit(""))
    html, selector = text(F.col("element_html")), text(F.col("element_selector"))
    said = issues.select(
        "page_id", "issue", selector.alias("selector"), (html != "").alias("has_html"),
        text(markup_tag(html)).alias("tag"), normal_text(markup_attribute(html, "alt")).alias("alt"), normal_text(markup_attribute(html, "aria-label")).alias("label"), normal_text(F.regexp_replace(html, "<[^>]+>", "")).alias("text"),
        F.regexp_extract(text(markup_attribute(html, "src")), r"^(?:[^?]*/)?([^/?]*)", 1).alias("file"),
        text(selector_tag(selector)).alias("s_tag"), normal_text(_hint(selector, "alt")).alias("s_alt"), _hint(selector, "src").alias("s_src"), F.regexp_extract(selector, r"#([\w-]+)", 1).alias("s_id"),
    )
    b = boxes.select(F.col("page_id").alias("page"), F.col("pos").alias("box"), text(F.col("selector")).alias("b_selector"), F.lower(text(F.col("tag"))).alias("b_tag"), normal_text(F.col("alt")).alias("b_alt"), normal_text(F.col("aria_label")).alias("b_label"), normal_text(F.col("text")).alias("b_text"), F.concat_ws(" ", text(F.col("selector")), text(F.col("alt")), text(F.col("text"))).alias("b_said"))
    b = b.withColumn("last", F.row_number().over(Window.partitionBy("page", "b_selector").orderBy(F.desc("box"))) == 1)
    c = F.col
    same = lambda x, y: (c(x) != "") & (c(x) == c(y))
    by_markup = F.when(c("has_html") & ((c("tag") == "") | (c("b_tag") == "") | (c("tag") == c("b_tag"))), _points((TAG, same("tag", "b_tag")), (ALT, same("alt", "b_alt")), (LABEL, same("label", "b_label")), (TEXT, _within(c("text"), c("b_text"))), (SOURCE, (c("file") != "") & c("b_selector").contains(c("file"))))).otherwise(0)
    by_selector = F.when(same("s_tag", "b_tag"), F.lit(TAG) + _points((ALT, _within(c("s_alt"), c("b_alt"))), (SOURCE, (c("s_src") != "") & c("b_said").contains(c("s_src"))), (IDENTIFIER, (c("s_id") != "") & c("b_selector").contains(F.concat(F.lit("#"), c("s_id")))))).otherwise(0)
    pairs = said.join(b, c("page_id") == c("page")).select("page_id", "issue", "box", (same("selector", "b_selector") & c("last")).alias("exact"), by_markup.alias("by_markup"), by_selector.alias("by_selector"))
    return pairs.where(c("exact") | (c("by_markup") >= LEAST) | (c("by_selector") >= LEAST))


_CHOSEN = pa.schema([("page_id", pa.int64()), ("issue", pa.int64()), ("box", pa.int32()), ("strategy", pa.int32())])


def _chosen(pairs: Iterable[tuple]) -> Iterator[tuple]:
    """(page_id, issue, box, strategy) of pairs (page_id, issue, box, exact, by_markup, by_selector) sorted by page, issue and box; holds the boxes taken on one page and the best of one issue."""
    for page_id, page in groupby(pairs, key=lambda r: r[0]):
        taken = set()
        for issue, own in groupby(page, key=lambda r: r[1]):
            best = {}  # strategy: (score, box), the first of equals
            for _, _, box, *scores in own:
                if box not in taken:
                    for strategy, score, least in zip((1, 2, 3), scores, (1, LEAST, LEAST)):
                        if score >= least and (strategy not in best or score > best[strategy][0]):
                            best[strategy] = score, box
            if best:
                strategy = min(best)
                box = best[strategy][1]
                taken.add(box)
                yield page_id, issue, box, strategy


def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Issues in order take their exact box, else the free one that their markup, else their selector fits best; of equals the first. Pages may go on from batch to batch."""
    pairs = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for rows in batched(_chosen(pairs), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHOSEN)], schema=_CHOSEN)


def match(issues: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, issue, nth, box, strategy): the box of each of issues(page_id, issue, element_selector, element_html), at most one each, numbered as found, of boxes(page_id, pos, selector, tag, text, alt, aria_label, x, y).

    What fits no box takes the boxes that are left, from the top and the left. Null selectors and markup match by place only; pages without
    boxes, and issues beyond the number of boxes, give no row.
    """
    own = lambda df, *columns: df.select(*(F.col(x).alias(x) for x in ("page_id", *columns)))  # noqa: E731, both may come from one table
    issues = own(issues, "issue", "element_selector", "element_html")
    boxes = own(boxes, "pos", "selector", "tag", "text", "alt", "aria_label", "x", "y")
    pairs = fits(issues, boxes).repartition("page_id").sortWithinPartitions("page_id", "issue", "box")
    found = stored(pairs.mapInArrow(choose, "page_id long, issue long, box int, strategy int"), "fitted")
    nth = lambda *order: F.row_number().over(Window.partitionBy("page_id").orderBy(*order)).alias("nth")
    left = issues.join(found, ["page_id", "issue"], "left_anti").select("page_id", "issue", nth("issue"))
    free = boxes.withColumnRenamed("pos", "box").join(found, ["page_id", "box"], "left_anti").select("page_id", "box", nth("y", "x", "box"))
    every = found.unionByName(left.join(free, ["page_id", "nth"]).select("page_id", "issue", "box", F.lit(4).alias("strategy")))
    return every.select("page_id", "issue", nth((F.col("strategy") == 4), "issue"), F.col("box").cast("int").alias("box"), "strategy")
