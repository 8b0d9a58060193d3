"""The whole record of a page, by hand."""

from lumenaudit.operators import record

PAGE = """<html lang="en"><head><title>T</title><meta name="viewport" content="w"></head><body id="d">
<h1 id="">One <b>two</b></h1><h3 id="d">Three</h3>
<img src="../i.png" width="30" height='4'><img alt="x" role="presentation">
<form METHOD="POST"><label for="n">N</label><input id="n" name="n" type="email" required><select name="s"></select></form><form action="/go#f"></form>
<a href="?q=1" target="_blank">go</a><button disabled>B</button><nav aria-label="m"></nav>
<span tabindex=" +2x" role="tab">under</span><p lang="fr">bon<i>jour</i></p><div role="timer">9</div>%s</body></html>"""


def test_page_record(spark):
    long = "".join(f'<i tabindex="{i}">{"y" * 70}</i><input type="text" name="a{i}"><u lang="de"></u><s aria-live="polite"></s><a href="/{i}"></a>' for i in range(210))
    pages = spark.createDataFrame([(1, "http://h/a/b?x", PAGE % ""), (2, "http://h/", PAGE % long), (3, "http://h/e", ""), (4, "http://h/n", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r.asDict(recursive=True) for r in record.page_records(spark, pages).collect()}
    r = got[1]
    assert (r["title"], r["lang"], r["viewport_meta"], len(r["content_hash"])) == ("T", "en", "w", 16) and r["html"] == PAGE % ""
    assert r["headings"] == [{"level": 1, "text": "One two", "id": None}, {"level": 3, "text": "Three", "id": "d"}]
    image = dict.fromkeys(("width", "height", "role"))
    assert r["images"] == [image | {"src": "http://h/i.png", "alt": "", "has_alt": False, "width": 30, "height": 4}, image | {"src": "", "alt": "x", "has_alt": True, "role": "presentation"}]
    field = {"aria_label": None, "placeholder": ""}
    assert r["forms"] == [
        {"action": "http://h/a/b?x", "method": "post", "inputs": [field | {"tag": "input", "type": "email", "name": "n", "id": "n", "has_label": True, "required": True}, field | {"tag": "select", "type": "select-one", "name": "s", "id": "", "has_label": False, "required": False}]},
        {"action": "http://h/go#f", "method": "get", "inputs": []},
    ]
    assert r["links"] == [{"href": "http://h/a/b?q=1", "text": "go", "target": "_blank", "aria_label": "", "aria_labelledby": "", "title": ""}]
    assert [(x["tag"], x["text"], x["disabled"]) for x in r["interactive_elements"]] == [("button", "B", True)]
    assert r["landmarks"] == [{"tag": "nav", "role": "nav", "aria_label": "m"}]
    assert r["tabindex_elements"] == [{"tag": "span", "tabindex": 2, "text": "under", "role": "tab"}]
    assert [(x["type"], x["name"], x["autocomplete"]) for x in r["autocomplete_inputs"]] == [("email", "n", "")]
    assert r["lang_parts"] == [{"tag": "p", "lang": "fr", "text": "bonjour"}]
    assert r["aria_live_regions"] == [{"tag": "div", "role": "timer", "aria_live": None, "text": "9"}]
    assert r["duplicate_ids"] == [{"id": "d", "count": 2}]
    long = got[2]
    assert {k: len(v) for k, v in long.items() if isinstance(v, list)} == {
        "headings": 2, "images": 2, "forms": 2, "links": 200, "interactive_elements": 1, "landmarks": 1, "tabindex_elements": 100, "autocomplete_inputs": 50, "lang_parts": 50, "aria_live_regions": 20, "duplicate_ids": 1,
    }
    assert long["tabindex_elements"][1]["text"] == "y" * 60 and long["tabindex_elements"][99]["tabindex"] == 98
    for empty in (got[3], got[4]):
        assert (empty["title"], empty["lang"], empty["viewport_meta"]) == ("", "", "") and [v for v in empty.values() if isinstance(v, list)] == [[]] * 11
    assert record.page_records(spark, pages.limit(0)).count() == 0
