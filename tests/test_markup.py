"""Trees of markup, spans, recovered quotes, measurements, the table function and the stored site, on planted cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.functions import grounding, markup, measure
from gneiss.operators import chunking, table_functions
from gneiss.shared import scratch
from gneiss.sources import site


def test_parameters_under_headings():
    page = """<h2>Specs</h2><h3>M200</h3><h2>Body</h2><div><strong>Size</strong><br>10 mm<br/>wide</div>
     <div><div><h5><strong>Old</strong></h5></div><p>legacy</p></div><h3>M210</h3><div><strong></strong>only text</div><script><strong>no</strong></script>"""
    assert markup.parameters(page, ("Specs",)) == [
        {"group": "M200 / Body", "label": "Size", "value": "10 mm\nwide"},
        {"group": "M200 / Body", "label": "Old", "value": "legacy"},
        {"group": "M210", "label": "note", "value": "only text"},
    ]
    assert markup.parameters(None) == [] and markup.parameters("<strong>top</strong>") == []
    assert markup.parameters("<div><strong>a</strong>b")[0] == {"group": "other", "label": "a", "value": "b"}


def grid(html):
    return markup.tables(html)


def test_spans_make_a_rectangle():
    assert grid("<table><tr><td rowspan=2>a<td colspan='2'>b</td></td></tr></table>") != []
    assert grid("<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td></tr></table>") == [[["a", "b", "b"], ["a", "c", "d"], ["e", "", ""]]]
    # Overlap: the wide cell of the second row runs into the tall one of the first.
    assert grid("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=3>c</td></tr></table>") == [[["a", "b", ""], ["c", "c", "c"]]]
    assert grid("<table><tr><td rowspan=3>a</td></tr></table>") == [[["a"], ["a"], ["a"]]]
    assert grid("<table><tr><td colspan=x rowspan=0>a</td><td colspan=-3>b</td></tr></table>") == [[["a", "b"]]]
    assert grid("<table></table>") == [[]] and grid("") == []
    outer = "<table><tr><td>x<table><tr><td>in</td></tr></table></td><td>y</td></tr></table>"
    assert grid(outer) == [[["x in", "y"]], [["in"]]]
    assert len(grid("<table><tr><td rowspan=99999 colspan=99999>a</td></tr></table>")[0]) == markup.MOST_ROWS


@pytest.mark.parametrize("seed", range(20))
def test_recovered_spans_cut_the_planted_quote(seed):
    r = random.Random(seed)
    words = [r.choice(("plain", "it’s", "a–b", "“so”", "漢字", "x-y", "end.")) + str(r.randrange(1000)) for _ in range(60)]
    text = "".join(w + r.choice((" ", "\n", "  ", "\t ")) for w in words)
    a = r.randrange(40)
    start = sum(len(x) for x in re.findall(r"\S+\s+", text)[:a])
    end = len("".join(re.findall(r"\S+\s+", text)[: a + 8]).rstrip())
    quote = re.sub(r"\s+", " ", text[start:end]).translate(grounding.PLAIN)
    assert grounding.recovered(text, quote) == (start, end) and grounding.recovered(text, f"\n{quote} ") == (start, end)
    assert grounding.recovered(text, quote.upper(), True) == (start, end) and grounding.recovered(text, quote + "?") is None


def test_blanks_beside_han_and_ambiguous_cases():
    assert grounding.recovered("前 面 的 test 词", "前面的test词") == (0, 12)
    assert grounding.recovered("one two", "onetwo") is None
    assert grounding.recovered("Ab x aB", "ab", True) is None and grounding.recovered("Ab x Ab", "ab", True) == (0, 2)
    assert grounding.recovered("abc", " ") is None and grounding.recovered(None, "a") is None and grounding.recovered("a", None) is None


def test_measurements_and_names():
    cases = {
        "1-inch 20MP camera": ("camera", {"size": "1 inch", "pixels": "20 mp"}), "f/1.8, 24 mm equivalent lens": ("lens", {"aperture": "f/1.8", "focal": "24 mm"}), "4K 60fps camera": ("camera", {"format": "4k", "rate": "60 fps"}),
        "dual sensors": ("sensors", {"count": "dual"}), "odd 4K camera": ("odd 4K camera", {}), "4K 8K camera": ("4K 8K camera", {}), "camera": ("camera", {}), "20 camera": ("20 camera", {}), "1/2.3 inch sensor": ("sensor", {"size": "1/2.3 inch"}), "camera bag": ("camera bag", {}), "": ("", {}), None: (None, {}),
    }
    assert {k: measure.core_name(k) for k in cases} == cases


def test_owners():
    products = ["Air", "Air 2", "Mini"]
    say = lambda t: measure.owner(t, "camera", products)
    assert say("The Air has a camera") == "Air" and say("the air 2's camera") == "Air 2" and say("Airy camera") is None
    assert say("Air and Mini: camera") is None and say("Both the Air: camera") is None and say("Air camera, shared by all") is None
    assert say("Mini.\nThe camera") is None and say("The camera of the Air") is None and say(None) is None


def test_the_table_function_equals_the_expressions(spark):
    rows = [(1, "Lead line\nrest " + "x" * 50, "T"), (2, "", "T"), (3, None, "T"), (4, "  \n\n lead " + "y" * 40, None), (5, "z" * 25, "T")]
    df = spark.createDataFrame(rows, "k long, body string, name string")
    want = sorted(map(tuple, chunking.article_chunks(df.filter("body IS NOT NULL"), "k", "body", "name", 10).collect()))
    got = table_functions.article_chunks(df, "k", "body", "name", 10)
    assert got.columns == ["k", "chunk_index", "body", "kind"] and sorted(map(tuple, got.collect())) == want
    with pytest.raises(Exception, match="no column nope"):
        table_functions.article_chunks(df.withColumnRenamed("name", "n"), "k", "body", "n", 10).sparkSession.sql("SELECT * FROM article_chunks(TABLE({d}), key => 'nope', text => 'body', title => 'name', size => 10)", d=df)


def test_the_site_is_read_in_parts_and_filters_reach_it(spark):
    folder = scratch(spark, "site")
    pages = [(f"u/{i}", [f"u/{i + 1}", f"u/{2 * i}"], "b" * i) for i in range(40)] + [(None, None, None)]
    spark.createDataFrame(pages, "url string, links array<string>, body string").repartition(6).write.json(folder)
    stored = site.read_site(spark, folder)
    assert sorted(map(repr, map(tuple, stored.collect()))) == sorted(map(repr, pages))
    assert [r["body"] for r in stored.filter("url = 'u/7'").collect()] == ["b" * 7]
    assert stored.filter(F.col("url").startswith("u/3")).count() == 11
    reader = site.SiteReader({"path": folder, "files": "2"})
    assert len(reader.partitions()) == 3
    hops, front = {"u/1": 0}, {"u/1"}
    known = {u: x for u, x, _ in pages if u}
    for h in (1, 2, 3):
        front = {v for u in front for v in known[u] if v in known} - set(hops)
        hops.update(dict.fromkeys(front, h))
    assert {r["url"]: r["hop"] for r in site.crawled(stored, "u/1", 3).collect()} == hops
    assert json.dumps(hops)


def test_articles():
    page = """<html><head><title> A &amp; B </title></head><body><nav><p>menu</p></nav><article><h1>Head</h1>loose <p>one <b>bold</b><p>two</p><ul><li>x</li><li></li></ul><footer>foot</footer></article><p>outside</p></body></html>"""
    assert markup.article(page) == {"title": "A & B", "published": None, "blocks": ["Head", "loose", "one bold", "two", "x"]}
    assert markup.article('<time datetime="2024">x</time>y')["published"] == "2024" and markup.article(None) == {"title": None, "published": None, "blocks": []}
