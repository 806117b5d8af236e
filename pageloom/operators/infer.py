"""Selectors inferred from pages: groups of similar elements, signatures, shortest unique selectors.

A page stays in its row: one narrow Arrow stage reads the few node fields it needs and answers from inverted lists
(tag, id and class to elements) of that page. Nothing is shuffled, and no pair of elements is compared: a
selector is extended by one ancestor at a time and keeps only the elements below matches of the new step.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.model import RAW_TEXT_TAG, TEXT_TAG

_READ = ("tag", "id", "classes", "parent", "last", "nth")
_RUN_NODES = 50_000


class _Page:
    """The elements of one page, by number, and lists of those that carry a tag, an id or a class."""

    def __init__(self, tag: list, ids: list, classes: list, parent: list, last: list, nth: list) -> None:
        self.tag, self.id, self.parent, self.last, self.nth = tag, [i or "" for i in ids], parent, last, nth
        self.classes = [tuple(c or ()) for c in classes]
        self.elements = [i for i, t in enumerate(tag) if t != TEXT_TAG and t != RAW_TEXT_TAG]
        self.by_id, self.by_tag, self.by_class = defaultdict(list), defaultdict(list), defaultdict(list)
        for i in self.elements:
            self.by_tag[tag[i]].append(i)
            if self.id[i]:
                self.by_id[self.id[i]].append(i)
            for c in set(self.classes[i]):
                self.by_class[tag[i], c].append(i)
        self._found: dict[tuple, list[int]] = {}
        self._spans: dict[tuple, list[tuple[int, int]]] = {}
        self._nearest: dict[tuple, int] = {}

    # a step is ("id", id), ("tag id", tag, id) or ("classes", tag, classes)
    def own_step(self, i: int) -> tuple:
        return ("tag id", self.tag[i], self.id[i]) if self.id[i] else ("classes", self.tag[i], self.classes[i])

    def step_above(self, i: int) -> tuple:
        return ("id", self.id[i]) if self.id[i] else ("classes", self.tag[i], self.classes[i])

    def matches(self, step: tuple, i: int) -> bool:
        if step[0] == "id":
            return self.id[i] == step[1]
        if self.tag[i] != step[1]:
            return False
        return self.id[i] == step[2] if step[0] == "tag id" else set(step[2]) <= set(self.classes[i])

    def found(self, step: tuple) -> list[int]:
        """Elements a step selects, ascending: the shortest list that holds them, sifted."""
        if step not in self._found:
            if step[0] == "classes":
                lists = [self.by_class[step[1], c] for c in set(step[2])]
                least = min(lists, key=len, default=self.by_tag[step[1]])
                self._found[step] = least if len(lists) < 2 else [i for i in least if self.matches(step, i)]
            else:
                self._found[step] = [i for i in self.by_id[step[-1]] if self.matches(step, i)]
        return self._found[step]

    def spans(self, step: tuple) -> list[tuple[int, int]]:
        """What lies below elements of a step, as disjoint ranges."""
        if step not in self._spans:
            out: list[tuple[int, int]] = []
            for i in self.found(step):
                if not out or i > out[-1][1]:
                    out.append((i, self.last[i]))
            self._spans[step] = out
        return self._spans[step]

    def nearest(self, step: tuple, i: int) -> int:
        """The nearest ancestor of an element that a step selects, or -1."""
        walked = []
        while True:
            key = (step, i)
            if key in self._nearest:
                at = self._nearest[key]
                break
            walked.append(key)
            i = self.parent[i]
            if i < 0 or self.matches(step, i):
                at = i
                break
        for key in walked:
            self._nearest[key] = at
        return at

    def signature(self, i: int) -> str:
        return f"{self.tag[i]}#{self.id[i]}" if self.id[i] else ".".join((self.tag[i], *self.classes[i]))

    def text_above(self, i: int) -> str:
        return f"#{self.id[i]}" if self.id[i] else self.signature(i)


class _Chain:
    """A descendant selector read from its end: elements it selects, with the topmost element used for each."""

    def __init__(self, elements: list[int], tops: list[int]) -> None:
        self.elements, self.tops = elements, tops
        self.longer: dict[tuple, _Chain] = {}

    def under(self, page: _Page, step: tuple) -> _Chain:
        """The selector with one more step before it."""
        if step not in self.longer:
            elements, tops = [], []
            for start, last in page.spans(step):
                for k in range(bisect_right(self.elements, start), bisect_right(self.elements, last)):
                    # the nearest match leaves most room for further steps
                    top = page.nearest(step, self.tops[k])
                    if top >= 0:
                        elements.append(self.elements[k])
                        tops.append(top)
            self.longer[step] = _Chain(elements, tops)
        return self.longer[step]


def _unique(page: _Page) -> list[str | None]:
    """For each element the shortest descendant selector that selects it alone."""
    chains: dict[tuple, _Chain] = {}
    out = []
    for i in page.elements:
        step = page.own_step(i)
        if step not in chains:
            chains[step] = _Chain(page.found(step), page.found(step))
        chain, at, above = chains[step], i, []
        while len(chain.elements) > 1 and (at := page.parent[at]) >= 0:
            chain = chain.under(page, page.step_above(at))
            above.append(at)
        whole = [*(page.text_above(a) for a in reversed(above)), page.signature(i)]
        out.append(" ".join(whole) if len(chain.elements) == 1 else None)
    return out


def _ordinal(page: _Page) -> list[str | None]:
    """For each element the shortest chain of ``:nth-child`` steps that selects it alone.

    Elements are grouped by their last step, groups of several by the step above it, and so on.
    """
    step = {i: (page.tag[i], page.nth[i]) for i in page.elements}
    out: dict[int, str | None] = dict.fromkeys(page.elements)
    groups = [[(i, i) for i in page.elements]]
    length = 0
    while groups:
        length += 1
        parts: list[list[tuple[int, int]]] = []
        for group in groups:
            split = defaultdict(list)
            for i, at in group:
                split[step[at]].append((i, at))
            parts += split.values()
        groups = []
        for part in parts:
            if len(part) == 1:
                out[part[0][0]] = _ordinal_text(page, part[0][0], length)
            elif more := [(i, page.parent[at]) for i, at in part if page.parent[at] >= 0]:
                groups.append(more)
    return [out[i] for i in page.elements]


def _ordinal_text(page: _Page, i: int, length: int) -> str:
    steps = []
    for _ in range(length):
        steps.append(f"{page.signature(i)}:nth-child({page.nth[i]})")
        i = page.parent[i]
    return " > ".join(reversed(steps))


def _similar_rows(page: _Page) -> tuple[list, ...]:
    groups = defaultdict(list)
    for i in page.elements:
        groups[page.tag[i], page.id[i], tuple(sorted(page.classes[i]))].append(i)
    pres = list(groups.values())
    keys = list(zip(*groups)) or [(), (), ()]
    return (*map(list, keys), [len(p) for p in pres], [p[0] for p in pres], pres)


def _signature_rows(page: _Page) -> tuple[list, ...]:
    own = {(page.signature(i), page.own_step(i)): None for i in page.elements}
    seen = list(dict.fromkeys((name, len(page.found(step))) for name, step in own))
    return [name for name, _ in seen], [n for _, n in seen], [n == 1 for _, n in seen]


def _unique_rows(page: _Page) -> tuple[list, ...]:
    return page.elements, _unique(page)


def _ordinal_rows(page: _Page) -> tuple[list, ...]:
    return page.elements, _ordinal(page)


def _shortest_rows(page: _Page) -> tuple[list, ...]:
    unique = _unique(page)
    if None in unique:
        unique = [u or o for u, o in zip(unique, _ordinal(page))]
    return page.elements, unique


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of whole pages of about :data:`_RUN_NODES` nodes."""
    ends = np.cumsum(batch.column("_tag").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + _RUN_NODES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _values(array: pa.Array) -> list:
    if not pa.types.is_string(array.type):
        return array.to_numpy(zero_copy_only=False).tolist()
    coded = array.dictionary_encode()  # each string becomes one object
    known = [*coded.dictionary.to_pylist(), None]
    return [known[i] for i in coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False).tolist()]


def _lists(array: pa.Array) -> tuple[list, list[int]]:
    """The values of a column of lists, one after another, and where each list ends; a NULL is an empty list."""
    ends = np.cumsum(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    inner = array.flatten()
    if pa.types.is_list(inner.type):
        values, upto = _lists(inner)
        return [values[a:b] for a, b in zip([0, *upto], upto)], ends
    return _values(inner), ends


def _pages(part: pa.RecordBatch) -> Iterator[_Page]:
    columns = [_lists(part.column(f"_{c}")) for c in _READ]
    starts = [0] * len(columns)
    for r in range(part.num_rows):
        upto = [ends[r] for _, ends in columns]
        yield _Page(*(values[a:b] for (values, _), a, b in zip(columns, starts, upto)))
        starts = upto


def _inferred(dom: DataFrame, rows_of: Callable[[_Page], tuple[list, ...]], schema: str, types: list) -> DataFrame:
    """``rows_of`` every page, with the columns of ``dom`` other than ``nodes``."""
    keep = [c for c in dom.columns if c != "nodes"]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _runs(batch):
                made: list[list] = [[] for _ in names]
                counts = []
                for page in _pages(part):
                    columns = rows_of(page)
                    counts.append(len(columns[0]))
                    for out, column in zip(made, columns):
                        out.extend(column)
                carried = part.select(keep).take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                arrays = [pa.array(c, t) for c, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*carried.columns, *arrays], [*keep, *names])
        # workers live on: what Arrow keeps of a partition goes back with its end
        pa.default_memory_pool().release_unused()

    narrow = dom.select(*keep, *(F.col(f"nodes.{c}").alias(f"_{c}") for c in _READ))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dom.select(*keep).schema)
    return narrow.mapInArrow(run, f"{kept}, {schema}" if keep else schema)


_INT, _STRING = pa.int32(), pa.string()


def similar(dom: DataFrame) -> DataFrame:
    """Groups of elements of a page with the same tag, id and set of classes in any order.

    ``classes`` is sorted; ``pres`` lists the members.
    """
    return _inferred(
        dom,
        _similar_rows,
        "tag string, elem_id string, classes array<string>, n bigint, first_pre int, pres array<int>",
        [_STRING, _STRING, pa.list_(_STRING), pa.int64(), _INT, pa.list_(_INT)],
    )


def signature_uniqueness(dom: DataFrame) -> DataFrame:
    """Every signature of a page, how many elements it selects, and whether that makes it a selector.

    A class signature also selects elements that carry further classes.
    """
    return _inferred(
        dom, _signature_rows, "signature string, matched bigint, is_selector boolean", [_STRING, pa.int64(), pa.bool_()]
    )


def unique_selectors(dom: DataFrame) -> DataFrame:
    """The shortest descendant selector of every element that singles it out: ``pre, selector``.

    Steps are the element's signature and, before it, those of its ancestors, nearest first, an id by itself.
    Elements that their whole chain does not single out get a NULL.
    """
    return _inferred(dom, _unique_rows, "pre int, selector string", [_INT, _STRING])


def ordinal_selectors(dom: DataFrame) -> DataFrame:
    """The shortest chain of ``:nth-child`` steps that singles an element out: ``pre, selector``.

    A top element whose like is nested inside it has no such chain and gets NULL.
    """
    return _inferred(dom, _ordinal_rows, "pre int, selector string", [_INT, _STRING])


def shortest_selectors(dom: DataFrame) -> DataFrame:
    """:func:`unique_selectors`, with :func:`ordinal_selectors` for elements that those do not single out."""
    return _inferred(dom, _shortest_rows, "pre int, selector string", [_INT, _STRING])
