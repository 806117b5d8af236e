"""HTML tables to relations, computed inside each page's node array.

All functions with ``table`` and ``nodes`` columns are expressions over one page; the DataFrame
forms below them explode the result. A table is part of one page, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.binding import BLOCK, bind
from pageloom.functions.text import clean_key
from pageloom.model import TABLE_HHEADERS, TABLE_VHEADERS, FieldSelector, TableSelector
from pageloom.operators.selectors import element_text, select_nodes, subtree

PAIR = "array<struct<key:string,row:int,value:string>>"
SLOTS = "array<struct<col:int,rest:int,text:string>>"


def _below(node: Column, nodes: Column, tag: str) -> Column:
    return F.filter(subtree(node, nodes), lambda d: d["tag"] == tag)


def keys_left(table: Column, nodes: Column) -> Column:
    """Key/value cells side by side: ``array<struct<key, row, value>>``.

    Single-cell rows are titles, empty keys are dropped, a missing last value is ``''``.
    """

    def pairs(cells: Column, number: Column) -> Column:
        made = F.transform(
            F.sequence(F.lit(0), F.size(cells) - 1, F.lit(2)),
            lambda i: F.struct(
                clean_key(cells[i]).alias("key"),
                number.cast("int").alias("row"),
                F.coalesce(F.get(cells, i + 1), F.lit("")).alias("value"),
            ),
        )
        return F.when(F.size(cells) > 1, made).otherwise(F.array().cast(PAIR))

    texts = F.transform(
        _below(table, nodes, "tr"),
        lambda row: F.transform(_below(row, nodes, "td"), lambda c: element_text(c, nodes)),
    )
    return F.filter(F.flatten(F.transform(texts, pairs)), lambda p: p["key"] != "")


def _span(cell: Column, left: Column) -> Column:
    """Rows a cell covers: its ``rowspan``, 1 by default; 0 means all ``left`` rows of the table."""
    span = cell["attrs"]["rowspan"].try_cast("int")
    return F.when(span == 0, left).when(span > 0, span).otherwise(F.lit(1))


def grid(rows: Column, nodes: Column) -> Column:
    """Rows of cells laid out with row spans: ``array<array<string>>``.

    Each row first keeps the columns its predecessors' spans still cover, then fills the free
    columns with its own cells. Tables without spans skip the fold. Rows are swept in blocks: a fold copies what it
    appends to, so only a block's rows and one entry a block are copied, and the cost is linear in the rows.
    """
    cells_of = F.transform(
        rows,
        lambda r, i: F.transform(
            _below(r, nodes, "td"),
            lambda c: F.struct(_span(c, F.size(rows) - i).alias("span"), element_text(c, nodes).alias("text")),
        ),
    )

    def slots_of(carry: Column, cells: Column) -> Column:
        """Carried and own cells of a row with their columns, left to right."""

        def placed(columns: Column | None) -> Column:
            def slot(c: Column, j: Column) -> Column:
                col = j if columns is None else columns[j]
                return F.struct(col.alias("col"), c["span"].alias("rest"), c["text"].alias("text"))

            return F.transform(cells, slot)

        def beside(taken: Column) -> Column:
            # the free columns needed lie below this, whatever columns are taken
            reach = F.greatest(F.size(carry), F.coalesce(F.array_max(taken) + 1, F.lit(0))) + F.size(cells)
            free = F.array_except(F.sequence(F.lit(0), reach), taken)
            return F.array_sort(F.concat(carry, bind(free, placed)))

        return F.when(F.size(carry) == 0, placed(None)).otherwise(bind(F.transform(carry, lambda s: s["col"]), beside))

    def laid_out(slots: Column) -> Column:
        """The row's texts by column; columns nobody covers stay NULL."""
        texts = F.transform(slots, lambda s: s["text"])
        last = F.element_at(slots, -1)["col"]
        by_column = F.map_from_arrays(F.transform(slots, lambda s: s["col"]), texts)
        row = bind(by_column, lambda known: F.transform(F.sequence(F.lit(0), last), lambda c: known[c]))
        none = F.array().cast("array<string>")
        return F.when(F.size(slots) == 0, none).when(last == F.size(slots) - 1, texts).otherwise(row)

    def step(acc: Column, cells: Column) -> Column:
        def advance(slots: Column) -> Column:
            carry = F.transform(
                F.filter(slots, lambda s: s["rest"] > 1),
                lambda s: F.struct(s["col"].alias("col"), (s["rest"] - 1).alias("rest"), s["text"].alias("text")),
            )
            return F.struct(carry.alias("carry"), F.array_append(acc["out"], laid_out(slots)).alias("out"))

        return bind(slots_of(acc["carry"], cells), advance)

    def layout(rows_of_cells: Column) -> Column:
        count = F.size(rows_of_cells)
        none = F.array().cast("array<array<string>>")

        def sweep(acc: Column, block: Column) -> Column:
            """One block of rows, from the spans that reach into it."""
            own = F.transform(
                F.sequence(block * BLOCK, F.least(block * BLOCK + BLOCK, count) - 1), lambda i: F.get(rows_of_cells, i)
            )
            start = F.struct(acc["carry"].alias("carry"), none.alias("out"))
            swept = F.aggregate(own, start, step)
            return bind(
                swept, lambda s: F.struct(s["carry"].alias("carry"), F.array_append(acc["out"], s["out"]).alias("out"))
            )

        start = F.struct(F.array().cast(SLOTS).alias("carry"), F.array().cast("array<array<array<string>>>").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
        spanned = F.exists(rows_of_cells, lambda cells: F.exists(cells, lambda c: c["span"] > 1))
        plain = F.transform(rows_of_cells, lambda cells: F.transform(cells, lambda c: c["text"]))
        filled = F.flatten(F.aggregate(blocks, start, sweep, lambda acc: acc["out"]))
        return F.when(spanned, filled).otherwise(plain)

    return bind(cells_of, layout)


def keys_top(table: Column, nodes: Column) -> Column:
    """Keys from the first row with ``th``, values from the rows below it, by column.

    ``array<struct<key, row, value>>``, key by key; cells missing in short rows give no value.
    """

    def columns(keys: Column, body: Column) -> Column:
        def column(key: Column, i: Column) -> Column:
            made = F.transform(
                body,
                lambda cells, r: F.struct(
                    key.alias("key"), r.cast("int").alias("row"), F.get(cells, i).alias("value")
                ),
            )
            return F.filter(made, lambda p: p["value"].isNotNull())

        return F.coalesce(F.flatten(F.transform(keys, column)), F.array().cast(PAIR))

    def below_header(rows: Column, head: Column) -> Column:
        keys = F.transform(_below(head, nodes, "th"), lambda c: element_text(c, nodes))
        body = grid(F.filter(rows, lambda r: r["pre"] > head["last"]), nodes)
        return bind(body, lambda cells: columns(keys, cells))

    def read(rows: Column) -> Column:
        with_header = F.filter(rows, lambda r: F.exists(subtree(r, nodes), lambda d: d["tag"] == "th"))
        return bind(F.get(with_header, 0), lambda head: below_header(rows, head))

    return bind(_below(table, nodes, "tr"), read)


def table_pairs(nodes: Column, selector: TableSelector) -> Column:
    """Key/value pairs of the tables a selector picks, in page order."""
    read = {TABLE_HHEADERS: keys_left, TABLE_VHEADERS: keys_top}[selector.table_type]
    found = select_nodes(nodes, FieldSelector(selector.selector, selector.kind))
    return F.flatten(F.transform(found, lambda t: read(t, nodes)))


def tables(dom: DataFrame) -> DataFrame:
    """Every table of every page, indexed from 0, with its kind."""
    nodes = F.col("nodes")
    found = F.transform(
        F.filter(nodes, lambda n: n["tag"] == "table"),
        lambda t, i: F.struct(i.cast("int").alias("table_no"), t["pre"].alias("pre"), table_kind(t, nodes).alias("kind")),
    )
    return dom.select(*[c for c in dom.columns if c != "nodes"], F.inline(found))


def table_kind(table: Column, nodes: Column) -> Column:
    """Keys on top if the table holds any ``th``, else keys on the left."""
    has_th = F.exists(subtree(table, nodes), lambda d: d["tag"] == "th")
    return F.when(has_th, TABLE_VHEADERS).otherwise(TABLE_HHEADERS)


def table_rows(dom: DataFrame, selector: TableSelector) -> DataFrame:
    """Key/value rows of the selected tables: ``key, row, value``."""
    keep = [c for c in dom.columns if c != "nodes"]
    return dom.select(*keep, F.inline(table_pairs(F.col("nodes"), selector)))


def expanded_rows(dom: DataFrame, selector: FieldSelector | str) -> DataFrame:
    """Body rows of the selected tables with row spans filled in: ``table_no, row, cells``."""
    nodes = F.col("nodes")
    keep = [c for c in dom.columns if c != "nodes"]

    def has(row: Column, tag: str) -> Column:
        return F.exists(subtree(row, nodes), lambda d: d["tag"] == tag)

    # header rows are no body rows; empty rows are, spans run through them
    body = lambda t: F.filter(_below(t, nodes, "tr"), lambda r: has(r, "td") | ~has(r, "th"))
    per_table = F.transform(select_nodes(nodes, selector), lambda t: grid(body(t), nodes))
    found = dom.select(*keep, F.posexplode(per_table).alias("table_no", "_rows"))
    return found.select(*keep, "table_no", F.posexplode("_rows").alias("row", "cells"))
