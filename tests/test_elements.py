"""Signatures, uniqueness and inferred selectors, against brute force."""

import re
import time

import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st

from pageloom.operators import elements as E
from pageloom.operators import infer as I
from pageloom.operators import select as S
from pageloom.operators.shred import _Trees

PAGES = [
    "<html><body><div id=top class=box><p class='a b'>1</p><p class=b>2</p><p class='b a'>3</p></div>"
    "<div class=box><p class='b c'>4</p><ul><li>5</li><li><b>6</b></li></ul></div><p>7</p></body></html>",
    "<ul><li>1<li>2</ul><ul id=u><li>3</ul><ul><li><i>4</i></ul>",
    "<div><div><div><span>x</span></div></div><span>y</span></div><section><div><span>z</span></div></section>",
    "<b>only</b>",
]


def tree(html):
    made = _Trees()
    made.parse(html)
    return made.array().to_pylist()[0]


def trees():
    return map(tree, PAGES)


def ancestors(node, nodes):
    """The ancestors of a node, the nearest first."""
    out = []
    while node["parent"] >= 0:
        node = nodes[node["parent"]]
        out.append(node)
    return out


def part_matches(part: str, node: dict) -> bool:
    m = re.match(r"([\w-]*)(?:#([\w-]+))?((?:\.[\w-]+)*)(?::nth-child\((\d+)\))?$", part)
    tag, elem_id, classes, nth = m.groups()
    return (
        node["text"] is None
        and (not tag or node["tag"] == tag)
        and (not elem_id or node["id"] == elem_id)
        and set(filter(None, classes.split("."))) <= set(node["classes"])
        and (not nth or node["nth"] == int(nth))
    )


def selected(selector: str, nodes: list[dict]) -> list[int]:
    """Elements a selector of ' ' and ' > ' combinators picks, by trying every ancestor."""
    tokens = selector.replace(" > ", " >").split()

    def holds(node: dict, upto: int) -> bool:
        if not part_matches(tokens[upto].lstrip(">"), node):
            return False
        if upto == 0:
            return True
        if tokens[upto].startswith(">"):
            return node["parent"] >= 0 and holds(nodes[node["parent"]], upto - 1)
        return any(holds(a, upto - 1) for a in ancestors(node, nodes))

    return [n["pre"] for n in nodes if holds(n, len(tokens) - 1)]


def chain_selector(node: dict, nodes: list[dict], steps: int) -> str:
    def signature(n, own):
        if n["id"]:
            return f"{n['tag']}#{n['id']}" if own else f"#{n['id']}"
        return ".".join([n["tag"], *n["classes"]])

    upward = [node, *ancestors(node, nodes)][:steps]
    return " ".join(reversed([signature(n, i == 0) for i, n in enumerate(upward)]))


def test_unique_selectors_are_the_shortest_that_single_an_element_out(page):
    got = {(r["page_id"], r["pre"]): r["selector"] for r in I.unique_selectors(page(*PAGES)).collect()}
    seen = 0
    for page_id, nodes in enumerate(trees(), 1):
        for node in (n for n in nodes if n["text"] is None):
            seen += 1
            tries = (chain_selector(node, nodes, k) for k in range(1, node["depth"] + 2))
            expected = next((s for s in tries if selected(s, nodes) == [node["pre"]]), None)
            assert got[page_id, node["pre"]] == expected
    assert len(got) == seen


def test_ordinal_selectors_single_every_element_out(page):
    got = I.ordinal_selectors(page(*PAGES)).collect()
    nodes_of = dict(enumerate(trees(), 1))
    assert len(got) == sum(n["text"] is None for nodes in nodes_of.values() for n in nodes)
    for r in got:
        nodes = nodes_of[r["page_id"]]
        if r["selector"] is None:  # a top element whose like is nested inside: no chain tells them apart
            node = nodes[r["pre"]]
            whole = " > ".join(f"{n['tag']}:nth-child({n['nth']})" for n in [*reversed(ancestors(node, nodes)), node])
            assert len(selected(whole, nodes)) > 1
            continue
        assert selected(r["selector"], nodes) == [r["pre"]]
        shorter = r["selector"].split(" > ", 1)[1:]
        if shorter:  # tags and ordinals alone decide; one step less must be ambiguous on them
            bare = re.sub(r"(^|> )([\w-]+)[#.][^:]*", r"\1\2", shorter[0])
            assert len(selected(bare, nodes)) > 1


SHAPES = st.lists(
    st.sampled_from(["<div>", "<div class=a>", "<div class='a b'>", "<p id=k>", "<p>", "<b class=a>", "<b>", "</div>", "</p>", "</b>", "t"]),
    max_size=30,
)


@settings(max_examples=150, deadline=None)
@given(SHAPES)
def test_inferred_selectors_equal_trying_all(parts):
    nodes = tree("".join(parts))
    page = I._Page(*([n[c] for n in nodes] for c in ("tag", "id", "classes", "parent", "last", "nth")))
    unique, shortest = dict(zip(page.elements, I._unique(page))), dict(zip(*I._shortest_rows(page)))
    for node in (n for n in nodes if n["text"] is None):
        tries = (chain_selector(node, nodes, k) for k in range(1, node["depth"] + 2))
        assert unique[node["pre"]] == next((s for s in tries if selected(s, nodes) == [node["pre"]]), None)
        if shortest[node["pre"]] is not None:
            assert selected(shortest[node["pre"]], nodes) == [node["pre"]]
    names, matched, alone = I._signature_rows(page)
    assert all(len(selected(n, nodes)) == m and a == (m == 1) for n, m, a in zip(names, matched, alone))


def test_inference_needs_no_shuffle_and_keeps_columns(page):
    dom = page(*PAGES)
    for df in (I.similar(dom), I.signature_uniqueness(dom), I.shortest_selectors(dom)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.columns[:2] == ["page_id", "url"]


@pytest.mark.parametrize(
    "html",
    [
        "".join(f"<p id=e{i}>x</p>" for i in range(10_000)),
        "".join(f"<div id=r{i}><b class=a>x</b></div>" for i in range(5_000)),
        "<table>" + "<tr class=r><td class='c d'>x</td></tr>" * 5_000 + "</table>",
        "<div>" * 1_000 + "x",
    ],
)
def test_large_pages_take_seconds(html):
    nodes = tree(html)
    page = I._Page(*([n[c] for n in nodes] for c in ("tag", "id", "classes", "parent", "last", "nth")))
    started = time.perf_counter()
    found = I._shortest_rows(page)[1]
    assert time.perf_counter() - started < 5
    assert len(found) == sum(n["text"] is None for n in nodes)
    if "id=r" in html:
        assert found[1] == "#r0 b.a"


def test_ordinal_selectors_run_through_the_dialect(page):
    dom = page(PAGES[1])
    for r in I.ordinal_selectors(dom).collect():
        assert rows(S.select(dom, r["selector"]), "pre") == [(r["pre"],)]


def test_signature_counts_elements_with_more_classes(page):
    got = {r["signature"]: (r["matched"], r["is_selector"]) for r in I.signature_uniqueness(page(PAGES[0])).collect()}
    assert got["p.b"] == (4, False)
    assert got["p.a.b"] == (2, False)
    assert got["p.b.a"] == (2, False)
    assert got["p.b.c"] == (1, True)
    assert got["div#top"] == (1, True)
    assert got["p"] == (5, False)


def test_similar_groups_ignore_class_order(page):
    groups = I.similar(page(PAGES[0])).filter("n > 1")
    assert rows(groups, "tag", "classes", "n") == [("li", [], 2), ("p", ["a", "b"], 2)]
    assert rows(E.all_similar(page(PAGES[0], "<b>"), "p.a"), "page_id", "all_similar") == [(1, True)]
    assert rows(E.all_similar(page(PAGES[0]), "p"), "all_similar") == [(False,)]


def test_first_child_with_text(page):
    dom = page("<div><i></i><b> </b><u><s>x</s></u><p>y</p></div>", "<div>own<b></b></div>")
    assert rows(E.first_child_with_text(dom, "div"), "page_id", "child_tag") == [(1, "u")]


def test_match_sets(page):
    dom = page("<p class=a>1</p><p class='a b'>2</p>")
    a, b = S.select(dom, "p.a"), S.select(dom, "p.b")
    assert E.add_matches(a, b).count() == 2
    assert E.remove_matches(a, b).count() == 1
    assert rows(E.edited_matches(dom, ["p.a", "p.b"], ["p.b"]), "pre") == rows(E.remove_matches(a, b), "pre")


@pytest.mark.parametrize(
    "union, selector, added, removed",
    [("a, b", "c", "a, b, c", "a, b"), ("a, b", "b", "a, b", "a"), ("", "a", "a", ""), ("a.x, a", "a", "a.x, a", "a.x")],
)
def test_selector_unions(union, selector, added, removed):
    assert E.add_selector(union, selector) == added
    assert E.remove_selector(union, selector) == removed


FORM = """<form><input name=q value="a&amp;b"><input type=HIDDEN name=h value=1><input type=submit name=s><button name=go>Go</button>
<button type=button name=plain value=v></button><select name=c><option value=1>one<option selected>two</select>
<select name=d><option value=x>y</select><select name=e></select><textarea name=t>long text</textarea>
<input type=radio name=r value=1><input type=radio name=r value=2></form><form><input name=other></form>"""


def test_form_inventory(page):
    got = E.form_fields(page("<p>no form</p>", FORM))
    assert rows(got, "page_id", "name", "value", "type") == [
        (2, "c", "two", "select"), (2, "d", "x", "select"), (2, "e", "", "select"), (2, "plain", "v", "button"),
        (2, "q", "a&b", "text"), (2, "r", "2", "radio"), (2, "t", "long text", "textarea"),
    ]


def test_attribute_inventory(page):
    got = E.attributes(page("<a href=x id=k></a><b></b>"))
    assert rows(got, "tag", "name", "value") == [("a", "href", "x"), ("a", "id", "k")]


def test_pages_share_batches(spark, page):
    htmls = [f"<div id=i{i}><p class=c>x</p>{'<p>y</p>' * (i % 3)}</div>" if i % 5 else "" for i in range(200)]
    got = I.signature_uniqueness(page(*htmls))
    want = [
        (i + 1, *row)
        for i, html in enumerate(htmls)
        if html
        for row in [(f"div#i{i}", 1, True), ("p.c", 1, True), *([("p", 1 + i % 3, False)] if i % 3 else [])]
    ]
    assert rows(got, "page_id", "signature", "matched", "is_selector") == sorted(want, key=repr)
    assert got.select("page_id").mapInArrow(lambda parts: (p.slice(0, 1) for p in parts), "page_id long").count() < 10
