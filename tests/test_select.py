"""The selector dialect on hand-written pages."""

import random
import time

import pytest
import test_elements as brute
from conftest import rows

from pageloom.model import CSS, REGEX, WORDLIST, XPATH, ContentSelector, FieldSelector
from pageloom.operators import select as S
from pageloom.operators.selectors import node_fields
from pageloom.operators.shred import shred
from pageloom.plans.session import materialise

PAGE = """
<div id=main class="box outer"><p class="x y">one <b>two</b> three</p><p class=y title="alpha beta">four</p></div>
<div class=box><ul><li><a href="/1" name="pagination-1">A</a></li><li><a href="/2">B</a><li>plain</ul></div>
<table id=t><tr><td>a<td>b<tr><td>c<td>d<tr><td>e<td>f</table><table id=u><tr><td>g</table>
<script>var hidden = 1;</script>"""


def css(text):
    return FieldSelector(text, CSS)


def xpath(text):
    return FieldSelector(text, XPATH)


@pytest.mark.parametrize(
    "selector, expected",
    [
        (css("p.x.y::text"), ["one ", " three"]),
        (css("p.y.x b::text"), ["two"]),
        (css("#main > p::text"), ["one ", " three", "four"]),
        (css("div.box > b::text"), []),
        (css("div b::text"), ["two"]),
        (css("div#main.outer p:nth-child(2)::attr(title)"), ["alpha beta"]),
        (css("td:nth-of-type(2)::text"), ["b", "d", "f"]),
        (css("a::href"), ["/1", "/2"]),
        (css("b::text, li a::text"), ["two", "A", "B"]),
        (css("li a::text, b::text, b::text"), ["two", "A", "B"]),
        (css("a::text, a::attr(href)"), ["A", "/1", "B", "/2"]),
        (xpath("//table[count(.//tr) > 2]//tr[2]/td[1]/text()"), ["c"]),
        (xpath("//div[@id='main']//text()"), ["one ", "two", " three", "four"]),
        (xpath("//div[@id='main']/p/text()"), ["one ", " three", "four"]),
        (xpath("//a[contains(@name, 'pagination')]/@href"), ["/1"]),
        (xpath("//p[starts-with(@title,'alpha')]/text()"), ["four"]),
        (xpath("//p[@class='y'] | //b"), ["two", "four"]),
        (xpath("/div[2]//li[3]/text()"), ["plain"]),
        (xpath("//ul/*[2]/a/@href"), ["/2"]),
        (css("table#u td"), ["g"]),
        (css("script::text"), []),
    ],
)
def test_dialect(page, selector, expected):
    found = S.values(page(PAGE), selector).orderBy("pre").collect()
    got = [r["value"] for r in found]
    assert sorted(got) == sorted(expected)
    if selector.selector.count("::") < 2 or "attr" not in selector.selector:
        assert got == expected


@pytest.mark.parametrize(
    "selector",
    [css("a:hover"), css("a >"), css("a + b"), css("p[title]"), xpath("a/b"), xpath("//a[last()]"),
     xpath("//a[@x='1'][2]"), xpath("//a/text()/b"), FieldSelector("x", REGEX)],
)
def test_other_forms_are_errors(page, selector):
    with pytest.raises(ValueError):
        S.values(page(PAGE), selector)


def test_bare_text_takes_all_visible_text(page):
    got = [r["value"].strip() for r in S.values(page("<p>a<b>b</b></p><script>no</script>c"), css("::text")).collect()]
    assert got == ["a", "b"]


def test_region_is_the_first_match_and_must_exist(page):
    dom = page("<p>out</p><div><p>in</p></div><div><p>later</p></div>", "<p>none</p>")
    assert rows(S.values(dom, css("p::text"), css("div")), "page_id", "value") == [(1, "in")]
    assert rows(S.restrict(dom, css("div")), "page_id", "tag") == [(1, "div"), (1, "p")]


def test_element_texts(page):
    dom = page("<td> <b>x </b> <i><![CDATA[c]]>CDATA no</i><u>y</u></td>", "<td>\n first <b>second</b></td>", "<td></td>")
    assert rows(S.own_text(dom, "td"), "page_id", "text") == [(1, ""), (2, "first"), (3, "")]
    assert rows(S.full_text(dom, "td"), "page_id", "text") == [(1, "x y"), (2, "first"), (3, "")]


CONTENT = "<h1>amd outside</h1><div class=d>lead<p><b>AMD inner</b>Intel own</p><p>HP_LAPTOP sku</p></div>"


def content(selector, kind, scope="region"):
    return ContentSelector(FieldSelector(selector, kind), css("div.d"), scope)


def test_content_search_finds_the_first_element_in_the_region(page):
    # the paragraph precedes its child in document order, so its own text wins
    dom = page(CONTENT, "<div class=d>nothing</div>", "<p>amd</p>")
    assert rows(S.content_search(dom, content("AMD, INTEL", WORDLIST)), "page_id", "value") == [(1, "Intel own"), (2, "")]
    assert rows(S.content_search(dom, content("[A-Z]{2}_[A-Z]+", REGEX)), "page_id", "value") == [(1, "HP_LAPTOP sku"), (2, "")]


def test_content_search_matches_from_the_start_only(page):
    assert rows(S.content_search(page(CONTENT), content("own", REGEX)), "value") == [("",)]


def test_content_search_can_cover_the_document(page):
    dom = page(CONTENT)
    assert rows(S.content_search(dom, content("AMD, INTEL", WORDLIST, "document")), "value") == [("amd outside",)]


def test_words_are_literal(page):
    dom = page("<div class=d><p>axb</p><p>a.b c</p></div>")
    assert rows(S.content_search(dom, content("a.b, q", WORDLIST)), "value") == [("a.b c",)]


def test_deep_levels_are_found(page):
    dom = page("<div>" * 515 + "<section><i>x</i></section>", "<section>" + "<div>" * 2_000 + "<b>x</b>")
    assert rows(S.select(dom, "section i"), "page_id", "pre") == [(1, 516)]
    for selector in ("section b", "section div div div b", "div > div b", "section > div div > b"):
        assert rows(S.select(dom, selector), "page_id", "pre") == [(2, 2_001)]
    assert S.select(dom, "section div div div").count() == 1_998


def test_descendants_cost_one_sweep(spark):
    """Several descendant steps over many nested and many disjoint matches take about the time of one."""
    pages = ["<section>" + "<div>" * 500 + "<b>x</b>" * 2_000, "<table>" + "<tr><td><b>x</b></td></tr>" * 4_000 + "</table>"]
    made = shred(spark.createDataFrame([(i, html) for i, html in enumerate(pages)], "page_id long, html string"))
    dom = materialise(made)

    def seconds(selector: str) -> float:
        started = time.perf_counter()
        S.select(dom, selector).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds("b")
    assert seconds("section div div div b") < 3 * seconds("section b") + 2
    assert seconds("table tr td b") < 3 * seconds("table b") + 2


def test_selectors_equal_trying_every_ancestor(spark):
    rng = random.Random(5)
    parts = ["<div>", "<div class=a>", "<p class='a b'>", "<b id=k>", "<b>", "</div>", "</p>", "</b>", "t"]
    htmls = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(120)]
    pages = spark.createDataFrame([(i, html) for i, html in enumerate(htmls)], "page_id long, html string")
    dom = materialise(shred(pages))
    trees = [brute.tree(html) for html in htmls]
    for selector in ("div b", "div div b", "div > b", "div > div b", "div b > b", "div.a p.b b", "b b b", "div > div > b div", "#k div > b"):
        want = [(i, pre) for i, nodes in enumerate(trees) for pre in brute.selected(selector, nodes)]
        assert rows(S.select(dom, selector), "page_id", "pre") == sorted(want, key=repr), selector
    union = rows(S.select(dom, "div b, b > b, p"), "page_id", "pre")
    want = {(i, pre) for i, nodes in enumerate(trees) for s in ("div b", "b > b", "p") for pre in brute.selected(s, nodes)}
    assert union == sorted(want, key=repr)


def test_node_fields_are_those_a_selector_reads(spark):
    pages = spark.createDataFrame([(1, "<div class=a><a href=x id=k>t</a></div>")], "page_id long, html string")
    for selector, more in (("div.a a::href", {"classes", "attrs"}), ("#k::text", {"id", "text"}), ("div > a:nth-child(1)", {"nth", "text"})):
        fields = node_fields(selector)
        assert fields == {"pre", "last", "parent", "tag"} | more
        assert S.values(shred(pages, fields), selector).count() == 1
