"""Trees of real-world HTML: recovery rules, numbering, raw text."""

import time

import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st

from pageloom.model import RAW_TEXT_TAG, TEXT_TAG
from pageloom.operators.shred import _Trees, elements, shred, texts, write_dom


def tree(html: str) -> list[dict]:
    trees = _Trees()
    trees.parse(html)
    return trees.array().to_pylist()[0]


def outline(html: str) -> str:
    """Tags nested by depth, texts in quotes."""
    return " ".join(
        f"{n['depth']}:{n['tag'] if n['text'] is None else repr(n['text'])}" for n in tree(html)
    )


def test_unclosed_paragraphs_and_items_end_where_the_next_begins():
    assert outline("<p>a<p>b") == "0:p 1:'a' 0:p 1:'b'"
    assert outline("<ul><li>a<li>b<ul><li>c</ul></ul>") == "0:ul 1:li 2:'a' 1:li 2:'b' 2:ul 3:li 4:'c'"
    assert outline("<dl><dt>a<dd>b<dt>c</dl>") == "0:dl 1:dt 2:'a' 1:dd 2:'b' 1:dt 2:'c'"


def test_paragraph_ends_inline_elements_left_open_inside_it():
    assert outline("<p><b>a<br><p>b</p>") == "0:p 1:b 2:'a' 2:br 0:p 1:'b'"


def test_block_start_ends_paragraph_but_not_across_table_cells():
    assert outline("<p>a<div>b</div>") == "0:p 1:'a' 0:div 1:'b'"
    assert outline("<p><object><p>x</object>") == "0:p 1:object 2:p 3:'x'"


def test_table_parts_end_each_other():
    html = "<table><tr><td>1<td>2<tr><th>3<tbody><tr><td>4</table>x"
    assert outline(html) == (
        "0:table 1:tr 2:td 3:'1' 2:td 3:'2' 1:tr 2:th 3:'3' 1:tbody 2:tr 3:td 4:'4' 0:'x'"
    )


def test_nested_table_does_not_end_the_outer_cell():
    assert outline("<table><tr><td><table><tr><td>x</table>y<td>z</table>") == (
        "0:table 1:tr 2:td 3:table 4:tr 5:td 6:'x' 3:'y' 2:td 3:'z'"
    )


def test_stray_end_tags_are_ignored_and_stay_within_cells():
    assert outline("a</b><i>c</u></i>") == "0:'a' 0:i 1:'c'"
    assert outline("<div><table><tr><td>a</div>b</table></div>") == "0:div 1:table 2:tr 3:td 4:'a' 4:'b'"


def test_script_content_is_one_raw_text():
    nodes = tree("<script>if(a<b){x=\"</p>\"}</SCRIPT ><p>t")
    assert [(n["tag"], n["text"]) for n in nodes] == [
        ("script", None), (RAW_TEXT_TAG, 'if(a<b){x="</p>"}'), ("p", None), (TEXT_TAG, "t"),
    ]


def test_title_content_is_text_without_markup():
    assert outline("<title>a <b>&amp; c</title>d") == "0:title 1:'a <b>& c' 0:'d'"


def test_entities_decode_once_with_or_without_semicolon():
    assert outline("<p>a &amp; b &lt;i&gt; &#233;&#x41; &amp;lt; x&amp &nope; & &copy2") == (
        "0:p 1:'a & b <i> éA &lt; x& &nope; & ©2'"
    )


def test_comments_and_declarations_vanish_and_split_text():
    assert outline("<!DOCTYPE html><p>a<!-- <b>no</b> -->b<?pi?>c") == "0:p 1:'a' 1:'b' 1:'c'"
    assert outline("a<!-- open") == "0:'a'"


def test_attributes():
    (node,) = tree("<A HREF='u?a=1&amp;b' data-x class=\" a  b \" ID=k id=second title=\"x > y\">")
    assert node["tag"] == "a"
    assert dict(node["attrs"]) == {"href": "u?a=1&b", "data-x": "", "class": " a  b ", "id": "k", "title": "x > y"}
    assert node["id"] == "k"
    assert node["classes"] == ["a", "b"]


def test_unclosed_quote_does_not_swallow_the_page():
    assert [n["tag"] for n in tree('<a title="x>y</a><b>z</b>')] == ["a", TEXT_TAG, "b", TEXT_TAG]


def test_ordinals():
    nodes = tree("<ul><li>a</li>t<b>x</b>u<li>c</li></ul>")
    assert [(n["tag"], n["nth"], n["nth_of_type"]) for n in nodes if n["text"] is None] == [
        ("ul", 1, 1), ("li", 1, 1), ("b", 2, 1), ("li", 3, 2),
    ]
    assert [(n["text"], n["nth"]) for n in nodes if n["parent"] == 0 and n["text"]] == [("t", 1), ("u", 2)]


def test_deep_nesting_keeps_its_levels():
    nodes = tree("<b>" * 5_000 + "end")
    assert [n["depth"] for n in nodes] == list(range(5_001))
    assert {n["last"] for n in nodes} == {5_000}
    assert nodes[-1]["text"] == "end"


@pytest.mark.parametrize("tag", ["<b>", "<p><object>", "<li><ul>", "<table><tr><td>", "<dl><dd>"])
def test_deep_nesting_costs_one_scan(tag):
    started = time.perf_counter()
    for html in (tag * 30_000 + "<p>" * 1_000 + "<li>" * 1_000 + "</i>" * 30_000, tag * 30_000 + "<p>x</p>" * 30_000):
        tree_of = _Trees()
        tree_of.parse(html)
    assert time.perf_counter() - started < 4


def test_pages_are_independent_and_empty_pages_have_no_nodes():
    trees = _Trees()
    for html in ("<p>a", "", "<i>b</i>c"):
        trees.parse(html)
    first, empty, last = trees.array().to_pylist()
    assert [n["tag"] for n in first] == ["p", TEXT_TAG]
    assert empty == []
    assert [(n["pre"], n["parent"], n["nth"]) for n in last] == [(0, -1, 1), (1, 0, 1), (2, -1, 1)]


def above_of(node: dict, nodes: list[dict]) -> list[int]:
    out = []
    while node["parent"] >= 0:
        out.append(node["parent"])
        node = nodes[node["parent"]]
    return out


MARKUP = st.lists(
    st.sampled_from(
        ["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "</table>", "<tr>", "<td>", "</td>",
         "<b>", "</b>", "<br>", "<a href=x>", "</a>", "text", "&amp;", "<!-- c -->", "<script>a<b</script>", "<", ">"]
    ),
    max_size=40,
)


@settings(max_examples=200, deadline=None)
@given(MARKUP)
def test_numbering_is_consistent(parts):
    nodes = tree("".join(parts))
    for i, n in enumerate(nodes):
        assert n["pre"] == i
        above = above_of(n, nodes)
        assert n["depth"] == len(above)
        for a in above:
            assert nodes[a]["pre"] < i <= nodes[a]["last"]
        inside = [m["pre"] for m in nodes if i in above_of(m, nodes)]
        assert n["last"] == (max(inside) if inside else i)
        kin = [m for m in nodes[: i + 1] if m["parent"] == n["parent"] and (m["text"] is None) == (n["text"] is None)]
        assert n["nth"] == len(kin)


def test_elements_and_texts(page):
    dom = page("<p id=a>x<b>y</b></p><script>no</script>", "<i>z</i>")
    assert rows(elements(dom), "page_id", "pre", "tag") == [(1, 0, "p"), (1, 2, "b"), (1, 4, "script"), (2, 0, "i")]
    assert rows(texts(dom), "page_id", "parent", "text") == [(1, 0, "x"), (1, 2, "y"), (2, 0, "z")]


def test_stored_trees_read_back_equal(spark, page, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p class=a>x"), (2, "v", None)], "page_id long, url string, html string")
    write_dom(pages, str(tmp_path / "dom"))
    stored = spark.read.parquet(str(tmp_path / "dom"))
    assert rows(elements(stored), "page_id", "tag") == rows(elements(shred(pages)), "page_id", "tag") == [(1, "p")]


def test_unclosed_tags_cost_one_scan():
    started = time.perf_counter()
    trees = _Trees()
    for html in ("<a " * 400_000, "</a " * 400_000, "x>" + "<a " * 400_000):
        trees.parse(html)
    assert time.perf_counter() - started < 2
    assert outline("a > b <!-- open <i>") == "0:'a > b '"


def test_fields_can_be_chosen(spark):
    pages = spark.createDataFrame([(1, "<p id=k class='a b' href=x>t")], "page_id long, html string")
    (row,) = shred(pages, ["tag", "classes", "pre"]).collect()
    assert [n.asDict() for n in row["nodes"]] == [
        {"pre": 0, "tag": "p", "classes": ["a", "b"]}, {"pre": 1, "tag": TEXT_TAG, "classes": []},
    ]
