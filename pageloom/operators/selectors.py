"""Selector texts as column predicates over a page's node array.

The accepted forms are a fixed, small dialect. CSS: tag, ``#id``, ``.class``, descendant, ``>``,
``:nth-child(k)``, ``:nth-of-type(k)``, ``,``, ``::text``, ``::attr(x)`` and its short form ``::x``.
XPath: ``//tag``, ``/tag``, ``[@a='v']``, ``contains(@a,'v')``, ``starts-with(@a,'v')``, ``[k]``,
``[count(.//t) > k]``, ``/text()``, ``//text()``, ``/@a``, ``|``. Anything else is a ``ValueError``.

A path is a list of *groups*, runs of steps joined by ``>``. A group is a predicate on one node: its own tests, and the
tests of the steps above on its parents (index lookups). Groups are joined by intervals: what lies below a match
``m`` are the nodes ``m + 1 .. last``, matches nested in another match add nothing to that, and the outermost ones
are disjoint. So each group is one sweep over the nodes below the outermost matches of the group before, whatever the
depth of the page; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from pageloom.functions.binding import bind, running
from pageloom.functions.text import strip
from pageloom.model import CSS, TEXT_TAG, XPATH, FieldSelector
from pageloom.operators.shred import is_element

CSS_COMPOUND = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[#.][\w-]+|:nth-(?:child|of-type)\(\d+\))*)$")
CSS_PART = re.compile(r"([#.])([\w-]+)|:nth-(child|of-type)\((\d+)\)")
CSS_PROJECTION = re.compile(r"::(?:attr\(([\w-]+)\)|([\w-]+))$")
XPATH_STEP = re.compile(r"(//?)(?:(?P<text>text\(\))|@(?P<attr>[\w-]+)|(?P<tag>\*|[A-Za-z][\w-]*)(?P<preds>(?:\[[^\]]*\])*))")
XPATH_PREDICATES = (
    (re.compile(r"@([\w-]+)\s*=\s*(['\"])(.*)\2$"), lambda m: attr_equals(m[1], m[3])),
    (re.compile(r"contains\(\s*@([\w-]+)\s*,\s*(['\"])(.*)\2\s*\)$"), lambda m: attr_contains(m[1], m[3])),
    (re.compile(r"starts-with\(\s*@([\w-]+)\s*,\s*(['\"])(.*)\2\s*\)$"), lambda m: attr_starts(m[1], m[3])),
    (re.compile(r"count\(\s*\.//([\w-]+)\s*\)\s*>\s*(\d+)$"), lambda m: more_than(m[1], int(m[2]))),
)


@dataclass(frozen=True)
class Test:
    """A condition on a node of a page, and the node field it reads."""

    reads: str
    holds: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Step:
    """Tests on one element, and how it hangs below the step before it."""

    axis: str  # "descendant", "child" or (first step only) "root"
    tag: str | None
    tests: tuple[Test, ...]


@dataclass(frozen=True)
class Path:
    """Steps plus what to take: "element", "own_text", "all_text" or an attribute ("@name")."""

    steps: tuple[Step, ...]
    take: str = "element"


def has_id(value: str) -> Test:
    return Test("id", lambda n, _: n["id"] == value)


def has_class(value: str) -> Test:
    return Test("classes", lambda n, _: F.array_contains(n["classes"], value))


def nth_child(k: int) -> Test:
    return Test("nth", lambda n, _: n["nth"] == k)


def nth_of_type(k: int) -> Test:
    return Test("nth_of_type", lambda n, _: n["nth_of_type"] == k)


def attr_present(name: str) -> Test:
    return Test("attrs", lambda n, _: n["attrs"][name].isNotNull())


def attr_equals(name: str, value: str) -> Test:
    return Test("attrs", lambda n, _: n["attrs"][name] == value)


def attr_contains(name: str, value: str) -> Test:
    return Test("attrs", lambda n, _: F.contains(n["attrs"][name], F.lit(value)))


def attr_starts(name: str, value: str) -> Test:
    return Test("attrs", lambda n, _: F.startswith(n["attrs"][name], F.lit(value)))


def subtree(node: Column, nodes: Column) -> Column:
    """The nodes below ``node``, in document order, by index: the cost is theirs, not that of the page."""
    below = F.transform(F.sequence(node["pre"] + 1, node["last"]), lambda i: F.get(nodes, i))
    none = F.filter(F.array(node), lambda _: F.lit(False))
    return F.when(node["last"] > node["pre"], below).otherwise(none)


def more_than(tag: str, k: int) -> Test:
    return Test("last", lambda n, nodes: F.size(F.filter(subtree(n, nodes), lambda d: d["tag"] == tag.lower())) > k)


def _css_path(text: str) -> Path:
    take = "element"
    projection = CSS_PROJECTION.search(text)
    if projection:
        attr, short = projection.groups()
        take = f"@{attr}" if attr else "own_text" if short == "text" else f"@{short}"
        text = text[: projection.start()]
    words = re.sub(r"\s*>\s*", " > ", text.strip()).split() or ["*"]
    steps, axis = [], "descendant"
    for word in words:
        if word == ">":
            axis = "child"
            continue
        m = CSS_COMPOUND.match(word)
        if not m:
            raise ValueError(f"unsupported CSS selector: {text!r}")
        tests = []
        for mark, name, kind, k in CSS_PART.findall(m["rest"]):
            if mark:
                tests.append(has_id(name) if mark == "#" else has_class(name))
            else:
                tests.append(nth_child(int(k)) if kind == "child" else nth_of_type(int(k)))
        steps.append(Step(axis, m["tag"], tuple(tests)))
        axis = "descendant"
    if axis == "child":
        raise ValueError(f"unsupported CSS selector: {text!r}")
    return Path(tuple(steps), take)


def _xpath_path(text: str) -> Path:
    steps, take, pos = [], "element", 0
    while pos < len(text):
        m = XPATH_STEP.match(text, pos)
        if not m or take != "element":
            raise ValueError(f"unsupported XPath: {text!r}")
        pos = m.end()
        deep = m[1] == "//"
        if m["text"]:
            take = "all_text" if deep else "own_text"
        elif m["attr"]:
            take = f"@{m['attr']}"
            if deep:
                raise ValueError(f"unsupported XPath: {text!r}")
        else:
            axis = "descendant" if deep else "child" if steps else "root"
            tests = []
            for i, predicate in enumerate(re.findall(r"\[([^\]]*)\]", m["preds"])):
                predicate = predicate.strip()
                if predicate.isdigit() and i == 0:
                    tests.append(nth_child(int(predicate)) if m["tag"] == "*" else nth_of_type(int(predicate)))
                    continue
                made = next((make(hit) for rx, make in XPATH_PREDICATES if (hit := rx.match(predicate))), None)
                if made is None:
                    raise ValueError(f"unsupported XPath predicate: [{predicate}]")
                tests.append(made)
            steps.append(Step(axis, m["tag"], tuple(tests)))
    if not steps:
        if take == "all_text":
            return Path((Step("descendant", "*", ()),), take)
        raise ValueError(f"unsupported XPath: {text!r}")
    return Path(tuple(steps), take)


def paths(selector: FieldSelector | str) -> list[Path]:
    """The union members of a selector; plain strings are CSS."""
    if isinstance(selector, str):
        selector = FieldSelector(selector, CSS)
    if selector.kind == CSS:
        parts = selector.selector.split(",")
        if not all(part.strip() for part in parts):
            raise ValueError(f"empty member in CSS selector: {selector.selector!r}")
        return [_css_path(part) for part in parts]
    if selector.kind == XPATH:
        return [_xpath_path(part.strip()) for part in re.split(r"\|(?![^\[]*\])", selector.selector)]
    raise ValueError("only CSS and XPath selectors pick elements")


def node_fields(*selectors: FieldSelector | str) -> set[str]:
    """The node fields that picking these selectors' elements, texts or attributes reads."""
    out = {"pre", "last", "parent", "tag"}
    for selector in selectors:
        for path in paths(selector):
            out |= {test.reads for step in path.steps for test in step.tests}
            out |= {"attrs"} if path.take.startswith("@") else {"text"}
    return out


def _groups(path: Path) -> list[tuple[Step, ...]]:
    """Runs of steps joined by the child axis; texts and attributes are tests of the last one."""
    *before, last = path.steps
    if path.take == "own_text":
        steps = [*path.steps, Step("child", TEXT_TAG, ())]
    elif path.take == "all_text":
        steps = [*path.steps, Step("descendant", TEXT_TAG, ())]
    elif path.take == "element":
        steps = list(path.steps)
    else:
        steps = [*before, Step(last.axis, last.tag, (*last.tests, attr_present(path.take[1:])))]
    groups: list[list[Step]] = []
    for step in steps:
        if step.axis == "child" and groups:
            groups[-1].append(step)
        else:
            groups.append([step])
    return [tuple(group) for group in groups]


def _ends_group(node: Column, nodes: Column, steps: tuple[Step, ...]) -> Column:
    """Whether ``node`` ends a chain of children matching ``steps``."""
    *above, step = steps
    of_tag = is_element(node) if step.tag in (None, "*") else node["tag"] == step.tag.lower()
    cond = reduce(lambda acc, test: acc & test.holds(node, nodes), step.tests, of_tag)
    if above:
        # NULL at the top of a page, which matches nothing
        return cond & _ends_group(F.get(nodes, node["parent"]), nodes, tuple(above))
    return cond & (node["parent"] == -1) if step.axis == "root" else cond


def _head(node: Column, nodes: Column, steps: tuple[Step, ...]) -> Column:
    """Where the chain that ``node`` ends begins."""
    for _ in steps[1:]:
        node = F.get(nodes, node["parent"])
    return node["pre"]


def outermost(found: Column, nodes: Column) -> Column:
    """Of ascending node numbers, those that lie in no other's subtree."""

    def kept(own: Column) -> Column:
        ends = running(F.transform(own, lambda i: F.get(nodes, i)["last"]), F.greatest, F.lit(-1))
        free = bind(ends, lambda end: F.filter(own, lambda i, k: (k == 0) | (i > F.get(end, k - 1))))
        return F.when(F.size(own) < 2, own).otherwise(free)

    return bind(found, kept)


def _below(found: Column, nodes: Column, steps: tuple[Step, ...]) -> Column:
    """Numbers of the nodes that end ``steps`` below one of ``found``."""

    def inside(m: Column) -> Column:
        def ends(i: Column) -> Column:
            node = F.get(nodes, i)
            cond = _ends_group(node, nodes, steps)
            return cond & (_head(node, nodes, steps) > m) if len(steps) > 1 else cond

        last = F.get(nodes, m)["last"]
        return F.when(last > m, F.filter(F.sequence(m + 1, last), ends)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(outermost(found, nodes), inside))


def _numbers(nodes: Column, path: Path) -> Column:
    """Numbers of the nodes a path takes, ascending."""
    first, *rest = _groups(path)
    out = F.transform(F.filter(nodes, lambda n: _ends_group(n, nodes, first)), lambda n: n["pre"])
    return reduce(lambda found, steps: _below(found, nodes, steps), rest, out)


def picked(nodes: Column, found: list[Path]) -> Column:
    """Numbers of the nodes that any of the paths takes, ascending, each once."""
    flat = [_groups(p)[0] for p in found if len(_groups(p)) == 1]
    sets = [_numbers(nodes, p) for p in found if len(_groups(p)) > 1]
    if flat:  # one sweep for all
        any_of = lambda n: reduce(lambda a, b: a | b, [F.coalesce(_ends_group(n, nodes, g), F.lit(False)) for g in flat])
        sets.append(F.transform(F.filter(nodes, any_of), lambda n: n["pre"]))
    return sets[0] if len(sets) == 1 else F.array_sort(F.array_distinct(F.concat(*sets)))


def inside(node: Column, region: Column) -> Column:
    """``node`` lies within ``region``; a NULL region holds nothing."""
    return F.coalesce((node["pre"] >= region["pre"]) & (node["pre"] <= region["last"]), F.lit(False))


def _within(numbers: Column, region: Column | None) -> Column:
    if region is None:
        return numbers
    return F.filter(numbers, lambda i: F.coalesce((i >= region["pre"]) & (i <= region["last"]), F.lit(False)))


def select_nodes(nodes: Column, selector: FieldSelector | str, region: Column | None = None) -> Column:
    """Matching nodes in document order, each once."""
    return F.transform(_within(picked(nodes, paths(selector)), region), lambda i: F.get(nodes, i))


def first_node(nodes: Column, selector: FieldSelector | str) -> Column:
    """The first match, or NULL."""
    return F.get(nodes, F.get(picked(nodes, paths(selector)), 0))


def select_values(nodes: Column, selector: FieldSelector | str, region: Column | None = None) -> Column:
    """``array<struct<pre, value>>`` of a selector: texts, attribute values or element texts."""
    found = paths(selector)
    takes = dict.fromkeys(path.take for path in found)
    parts = [_values_of(nodes, [path for path in found if path.take == take], region) for take in takes]
    return parts[0] if len(parts) == 1 else F.array_sort(F.array_distinct(F.concat(*parts)))


def _values_of(nodes: Column, same: list[Path], region: Column | None) -> Column:
    """Values of union members that take the same thing."""
    take = same[0].take

    def value(node: Column) -> Column:
        if take in ("own_text", "all_text"):
            return node["text"]
        return element_text(node, nodes) if take == "element" else node["attrs"][take[1:]]

    return F.transform(
        _within(picked(nodes, same), region), lambda i: F.struct(i.alias("pre"), value(F.get(nodes, i)).alias("value"))
    )


def first_text(node: Column, nodes: Column) -> Column:
    """First text node of the subtree, stripped; ``''`` when there is none."""
    found = F.get(F.filter(subtree(node, nodes), lambda t: t["tag"] == TEXT_TAG), 0)["text"]
    return F.coalesce(strip(found), F.lit(""))


def element_text(node: Column, nodes: Column) -> Column:
    """:func:`first_text`, else all non-blank texts of the subtree joined with a space."""
    found = F.filter(subtree(node, nodes), lambda t: t["tag"] == TEXT_TAG)
    texts = F.transform(found, lambda t: strip(t["text"]))

    def text(all_texts: Column) -> Column:
        visible = F.filter(all_texts, lambda t: (t != "") & ~F.contains(t, F.lit("CDATA")))
        first = F.coalesce(F.get(all_texts, 0), F.lit(""))
        return F.when(first != "", first).otherwise(F.array_join(visible, " "))

    return bind(texts, text)
