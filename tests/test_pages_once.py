"""A page is searched for tags once, and what is made of its elements is code that the JVM compiles."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from lumenaudit.functions import markup

PAGE = "<html><body><p ID=a class='b'>one<b>two<p hidden>three</p></body><div>four<i>five</div>six"


def test_split_pages_are_not_searched_again(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<p>" * 40 + "x</p>")], "page_id long, html string")
    split = markup.split(pages).withColumn("html", F.lit(None).cast("string"))  # all that follows has to come from the parts
    rows = lambda p: sorted(map(str, markup.elements(p).collect()))
    assert rows(split) == rows(pages) and markup.tokens(split).count() == markup.tokens(pages).count() == 10 + 41
    got = {(r["page_id"], r["tag"], r["pos"]): (r["end_pos"], r["text"]) for r in markup.elements(split).collect()}
    assert got[1, "div", 7] == (9, "fourfive") and got[1, "i", 8][0] == 9 and got[1, "p", 2][0] == 6 and got[4, "p", 0][0] == 40 and got[4, "p", 39][0] == 40


def test_no_method_is_too_large_to_be_compiled(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    said = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(said):
            markup.elements(pages).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue())]
    assert sizes and max(sizes) < 8000
