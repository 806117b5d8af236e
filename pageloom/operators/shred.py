"""HTML text to document trees: the only place where Python touches page content.

``shred`` turns each page row into one row holding the page's whole tree as an array of node
structs in document order. The tree is as large as the page that carried it, the map is narrow
(no shuffle), and every selector afterwards is a built-in expression over that array.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.model import NODE_FIELDS, RAW_TEXT_TAG, TEXT_TAG

# HTML element classes that decide where an element ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
ESCAPED_TEXT = frozenset(("title", "textarea"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# start tag -> (elements it ends, elements that shield them)
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
P_SHIELD = frozenset(("table", "td", "th", "caption", "button", "object"))
CELL_SHIELD = frozenset(("table", "td", "th"))
TABLE_PARTS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "body", "html"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<[!?/][^>]*>",
    re.S,
)
ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
END_OF = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | ESCAPED_TEXT}

_FLUSH_NODES = 100_000


class _Trees:
    """The trees of a run of pages: what only parsing can tell is listed here, the rest derived."""

    def __init__(self) -> None:
        # one entry per node; parents and last nodes are positions in these lists, -1 at the top of a page
        self.parent: list[int] = []
        self.last: list[int] = []
        self.depth: list[int] = []
        self.tags: list[str] = []
        self.texts: list[str | None] = []
        self.pages_at = [0]
        # one entry per element with attributes
        self.described: list[int] = []
        self.attr_counts: list[int] = []
        self.class_counts: list[int] = []
        self.elem_ids: list[str | None] = []
        self.names: list[str] = []
        self.values: list[str] = []
        self.classes: list[str] = []

    def _describe(self, node: int, source: str) -> None:
        """Append the attributes of a start tag, the first of each name."""
        elem_id, start, had = None, len(self.names), len(self.classes)
        for name, double, single, bare in ATTR.findall(source):
            name = name.lower()
            if name in self.names[start:]:
                continue
            value = double or single or bare
            if "&" in value:
                value = html_lib.unescape(value)
            self.names.append(name)
            self.values.append(value)
            if name == "id":
                elem_id = value
            elif name == "class":
                self.classes.extend(value.split())
        self.described.append(node)
        self.attr_counts.append(len(self.names) - start)
        self.class_counts.append(len(self.classes) - had)
        self.elem_ids.append(elem_id)

    def parse(self, source: str) -> None:
        """Append the nodes of one page."""
        parent, depth, tags, texts, last_of = self.parent, self.depth, self.tags, self.texts, self.last
        stack: list[int] = []
        open_tags: list[str] = []
        # the levels at which each tag is open, so that no end is searched for
        levels: dict[str, list[int]] = {}

        def add(tag: str, text: str | None) -> None:
            parent.append(stack[-1] if stack else -1)
            depth.append(len(stack))
            last_of.append(len(tags))
            tags.append(tag)
            texts.append(text)

        def cut(level: int) -> None:
            """End the open elements from a level on."""
            end = len(tags) - 1
            while len(stack) > level:
                last_of[stack.pop()] = end
                levels[open_tags.pop()].pop()

        def close(targets, shield, outermost: bool = False) -> None:
            """End an open element of ``targets`` that is not behind a shield, with all it contains."""
            if not any(map(levels.get, targets)):
                return
            shielded = max((levels[t][-1] for t in shield if t not in targets and levels.get(t)), default=-1)
            found = [own for t in targets if (own := levels.get(t)) and own[-1] > shielded]
            if found and outermost:
                cut(min(own[bisect_right(own, shielded)] for own in found))
            elif found:
                cut(max(own[-1] for own in found))

        pos, size = 0, len(source)
        # no tag ends behind the last ">", so nothing there need be tried as one
        last = source.rfind(">") + 1
        tokens = TAG.finditer(source, 0, last)
        while m := next(tokens, None):
            begin, upto = m.span()
            if begin > pos:
                text = source[pos:begin]
                add(TEXT_TAG, html_lib.unescape(text) if "&" in text else text)
            pos = upto
            if upto == last and source.startswith("<!--", begin) and not source.endswith("-->", begin, upto):
                pos = size  # a comment without end
                break
            start, attrs, end = m.groups()
            if end:
                tag = end.lower()
                if open_tags and open_tags[-1] == tag:
                    cut(len(stack) - 1)
                elif levels.get(tag):
                    close((tag,), () if tag in TABLE_PARTS else CELL_SHIELD)
            elif start:
                tag = start.lower()
                if tag in CLOSES_P and levels.get("p"):
                    close(("p",), P_SHIELD)
                if tag in IMPLIED_ENDS:
                    close(*IMPLIED_ENDS[tag], outermost=True)
                node = len(tags)
                add(tag, None)
                if attrs:
                    self._describe(node, attrs)
                if tag in VOID:
                    continue
                levels.setdefault(tag, []).append(len(stack))
                stack.append(node)
                open_tags.append(tag)
                if tag in END_OF:
                    # no markup until the end tag: take the content whole and scan on from there
                    stop = END_OF[tag].search(source, pos)
                    upto = stop.start() if stop else size
                    if upto > pos:
                        text = source[pos:upto]
                        add(*((RAW_TEXT_TAG, text) if tag in RAW else (TEXT_TAG, html_lib.unescape(text))))
                    pos = upto
                    tokens = TAG.finditer(source, pos, last)
        rest = source[pos:].partition("<!--")[0]
        if rest:
            add(TEXT_TAG, html_lib.unescape(rest))
        cut(0)
        self.pages_at.append(len(tags))

    def array(self, fields: tuple[str, ...] = tuple(NODE_FIELDS)) -> pa.Array:
        """One list of node structs, of the named fields, per parsed page."""
        n, pages_at = len(self.tags), np.asarray(self.pages_at)
        page = np.repeat(np.arange(len(pages_at) - 1), np.diff(pages_at))
        base = pages_at[:-1][page]
        parent = np.asarray(self.parent, "int64")
        tags = pa.array(self.tags, pa.string())
        columns = {
            "pre": lambda: _i32(np.arange(n) - base),
            "last": lambda: _i32(np.asarray(self.last, "int64") - base),
            "parent": lambda: _i32(np.where(parent >= 0, parent - base, -1)),
            "depth": lambda: _i32(np.asarray(self.depth, "int64")),
            "tag": lambda: tags,
            "id": lambda: pa.array(self._sparse(self.elem_ids), pa.string()),
            "classes": lambda: pa.ListArray.from_arrays(
                self._offsets(self.class_counts), pa.array(self.classes, pa.string())
            ),
            "attrs": lambda: pa.MapArray.from_arrays(
                self._offsets(self.attr_counts), pa.array(self.names, pa.string()), pa.array(self.values, pa.string())
            ),
            "text": lambda: pa.array(self.texts, pa.string()),
        }
        if "nth" in fields or "nth_of_type" in fields:
            codes = tags.dictionary_encode()
            kinds = np.asarray([t.as_py() in (TEXT_TAG, RAW_TEXT_TAG) for t in codes.dictionary], bool)
            code = codes.indices.to_numpy().astype("int64")
            is_text = kinds[code] if n else np.zeros(0, bool)
            # siblings share this key; the tops of a page are siblings too
            family = np.where(parent >= 0, parent, n + page)
            columns["nth"] = lambda: _i32(_ordinals(family, is_text.astype("int64")))
            columns["nth_of_type"] = lambda: _i32(np.where(is_text, 0, _ordinals(family, code)))
        return pa.ListArray.from_arrays(
            _i32(pages_at), pa.StructArray.from_arrays([columns[f]() for f in fields], list(fields))
        )

    def _sparse(self, values: list) -> list:
        full = [None] * len(self.tags)
        for node, value in zip(self.described, values):
            full[node] = value
        return full

    def _offsets(self, counts: list[int]) -> pa.Array:
        per_node = np.zeros(len(self.tags) + 1, "int64")
        per_node[np.asarray(self.described, "int64") + 1] = counts
        return _i32(np.cumsum(per_node))


def _i32(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype("int32"))


def _ordinals(family: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Position, from 1, of every node among the nodes of its family and kind."""
    n = len(family)
    order = np.lexsort((np.arange(n), kind, family))
    new_group = np.ones(n, bool)
    new_group[1:] = (np.diff(family[order]) != 0) | (np.diff(kind[order]) != 0)
    starts = np.maximum.accumulate(np.where(new_group, np.arange(n), 0))
    ordinals = np.empty(n, "int64")
    ordinals[order] = np.arange(n) - starts + 1
    return ordinals


def _shred_batches(fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("html")
            kept = [i for i in range(batch.num_columns) if i != where]
            sources = batch.column(where)
            trees, begin = _Trees(), 0
            for row in range(batch.num_rows):
                trees.parse(sources[row].as_py() or "")
                # bound the rows in flight by their nodes, not by their count
                if len(trees.tags) >= _FLUSH_NODES or row + 1 == batch.num_rows:
                    columns = [batch.column(i).slice(begin, row + 1 - begin) for i in kept] + [trees.array(fields)]
                    names = [batch.schema.names[i] for i in kept] + ["nodes"]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    trees, begin = _Trees(), row + 1

    return run


def shred(pages: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """Pages with an ``html`` column -> the same columns with ``nodes`` in its place.

    Filter and project before calling: predicates do not pass through the Python stage. ``fields`` names the
    node fields a plan reads (see :func:`pageloom.operators.selectors.node_fields`); all by default.
    """
    wanted = tuple(f for f in NODE_FIELDS if fields is None or f in fields)
    rest = [f for f in pages.schema.fields if f.name != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    node = ",".join(f"{f}:{NODE_FIELDS[f]}" for f in wanted)
    return pages.mapInArrow(_shred_batches(wanted), f"{schema}, nodes array<struct<{node}>>")


def is_element(node: Column) -> Column:
    return (node["tag"] != TEXT_TAG) & (node["tag"] != RAW_TEXT_TAG)


def _exploded(dom: DataFrame, keep, columns: list[str]) -> DataFrame:
    carry = [c for c in dom.columns if c != "nodes"]
    narrow = F.transform(F.filter("nodes", keep), lambda n: F.struct(*[n[c].alias(c) for c in columns]))
    return dom.select(*carry, F.inline(narrow))


def elements(dom: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per element, with all its columns or the named ones."""
    every = "pre last parent depth nth nth_of_type tag id classes attrs".split()
    return _exploded(dom, is_element, columns or every)


def texts(dom: DataFrame) -> DataFrame:
    """One row per visible text node."""
    return _exploded(dom, lambda n: n["tag"] == TEXT_TAG, "pre parent depth nth text".split())


def write_dom(pages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Shred once and store: later selectors scan Parquet instead of running Python again."""
    shred(pages).write.mode(mode).parquet(path)
