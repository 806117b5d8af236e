"""Pages to fields, fields to items: everything about one page stays in its row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.binding import bind
from pageloom.functions.text import call_arg, strip
from pageloom.functions.urls import absolutise
from pageloom.model import (
    INVALID_KEY,
    RESERVED_FIELDS,
    ContentSelector,
    FieldSelector,
    ImageSelector,
    ItemSelector,
    KeyValueSelector,
    TableSelector,
)
from pageloom.operators.select import content_value
from pageloom.operators.selectors import first_node, node_fields, select_values
from pageloom.operators.tables import table_pairs

FIELD = "array<struct<selector_no:int,key:string,pos:int,value:string>>"
IMAGES = "image_urls"

Processor = Callable[[Column], Column]


def _field_key(nodes: Column, key: str | FieldSelector) -> Column:
    """A fixed key, or the first match of a key selector on the page."""
    if isinstance(key, str):
        return F.lit(key)
    first = F.get(select_values(nodes, key), 0)["value"]
    return F.coalesce(first, F.lit(INVALID_KEY))


def _entries(nodes: Column, regions: dict, number: int, spec: KeyValueSelector) -> Column:
    """Field entries of one selector: ``selector_no, key, pos, value`` in document order."""

    def entry(key: Column, pos: Column, value: Column) -> Column:
        return F.struct(
            F.lit(number).alias("selector_no"), key.alias("key"), pos.cast("int").alias("pos"), value.alias("value")
        )

    value = spec.value
    if isinstance(value, TableSelector):
        pairs = table_pairs(nodes, value)
        return F.transform(pairs, lambda p: entry(p["key"], p["row"], p["value"]))
    key = F.lit(IMAGES) if isinstance(value, ImageSelector) else _field_key(nodes, spec.key)
    if isinstance(value, ContentSelector):
        region = regions[value.restrict]
        one = F.array(entry(key, F.lit(0), content_value(nodes, region, value)))
        return F.when(region.isNotNull(), one).otherwise(F.array().cast(FIELD))
    return F.transform(select_values(nodes, value), lambda v: entry(key, v["pre"], v["value"]))


def fields_of(nodes: Column, spec: ItemSelector) -> Column:
    """Every value a spec finds on a page, selector by selector, tables last."""
    restricts = list(dict.fromkeys(s.value.restrict for s in spec.selectors if isinstance(s.value, ContentSelector)))
    plain = [(i, s) for i, s in enumerate(spec.selectors) if not isinstance(s.value, TableSelector)]
    tables = [(i, s) for i, s in enumerate(spec.selectors) if isinstance(s.value, TableSelector)]

    def build(left: list, regions: dict) -> Column:
        if left:
            return bind(first_node(nodes, left[0]), lambda region: build(left[1:], {**regions, left[0]: region}))
        return F.concat(*[_entries(nodes, regions, i, s) for i, s in plain + tables])

    return build(restricts, {})


def read_fields(spec: ItemSelector) -> set[str]:
    """The node fields :func:`fields_of` reads."""
    out = {"pre", "last", "parent", "tag", "text"}
    for s in spec.selectors:
        if isinstance(s.value, ContentSelector):
            out |= node_fields(s.value.restrict) | {"nth"}
        elif isinstance(s.value, TableSelector):
            out |= node_fields(FieldSelector(s.value.selector, s.value.kind)) | {"attrs"}
        else:
            out |= node_fields(s.value)
        if isinstance(s.key, FieldSelector):
            out |= node_fields(s.key)
    return out


def extract_fields(dom: DataFrame, spec: ItemSelector) -> DataFrame:
    """``fields``: every value a spec finds on a page, selector by selector, tables last."""
    keep = [c for c in dom.columns if c != "nodes"]
    return dom.select(*keep, fields_of(F.col("nodes"), spec).alias("fields"))


def field_rows(extracted: DataFrame, empty_pages: bool = False) -> DataFrame:
    """Long form: ``no`` (order on the page), ``selector_no, key, pos, value``.

    With ``empty_pages`` a page without fields is one row whose ``no`` is NULL, so it survives
    :func:`regroup_fields`.
    """
    keep = [c for c in extracted.columns if c != "fields"]
    explode = F.posexplode_outer if empty_pages else F.posexplode
    return extracted.select(*keep, explode("fields").alias("no", "_field")).select(*keep, "no", "_field.*")


def regroup_fields(rows: DataFrame) -> DataFrame:
    """Back from the long form, for values that went through a Python or pandas function.

    Groups are the fields of one page, so they are as small as the page.
    """
    keep = [c for c in rows.columns if c not in ("no", "selector_no", "key", "pos", "value")]
    field = F.when(F.col("no").isNotNull(), F.struct("no", "selector_no", "key", "pos", "value"))
    listed = rows.groupBy(*keep).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return listed.withColumn("fields", F.transform("fields", lambda f: f.dropFields("no")))


def processed(fields: Column, url: Column, processors: dict[str, list[Processor]] | None = None) -> Column:
    """Input processors per key, composed left to right; images are made absolute, others stripped."""
    chosen = {IMAGES: [lambda c: absolutise(c, url)], **(processors or {})}

    def clean(field: Column) -> Column:
        value = strip(field["value"])
        cases = None
        for key, functions in chosen.items():
            done = reduce(lambda acc, fn: fn(acc), functions, field["value"])
            hit = field["key"] == key
            cases = F.when(hit, done) if cases is None else cases.when(hit, done)
        return field.withField("value", cases.otherwise(value))

    return F.transform(fields, clean)


def process_fields(extracted: DataFrame, processors: dict[str, list[Processor]] | None = None) -> DataFrame:
    """:func:`processed` fields.

    ``processors`` maps a key to Column functions; the default set applies to all other keys.
    """
    return extracted.withColumn("fields", processed(F.col("fields"), F.col("url"), processors))


def process_by_site(extracted: DataFrame, processor: str = "processor", key: str = "Images") -> DataFrame:
    """The processor set named by each row's site parameters; ``car`` reads call arguments of ``key``."""

    def clean(field: Column) -> Column:
        called = (F.col(processor) == "car") & (field["key"] == key)
        value = (
            F.when(field["key"] == IMAGES, absolutise(field["value"], F.col("url")))
            .when(called, call_arg(field["value"]))
            .otherwise(strip(field["value"]))
        )
        return field.withField("value", value)

    return extracted.withColumn("fields", F.transform("fields", clean))


def values_of(fields: Column, outputs: dict[str, Processor] | None = None) -> Column:
    """Map of key to list of values, keys in the order of their first values.

    Fields are sorted by key once and cut where the key changes, so the cost does not grow with the number of keys.
    """
    named = F.transform(fields, lambda f, i: F.struct(f["key"].alias("key"), i.alias("no"), f["value"].alias("value")))

    def finished(key: Column, values: Column) -> Column:
        return reduce(lambda acc, kf: F.when(key == kf[0], kf[1](values)).otherwise(acc), (outputs or {}).items(), values)

    def cut(own: Column) -> Column:
        firsts = F.filter(
            F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (F.get(own, i)["key"] != F.get(own, i - 1)["key"])
        )

        def run(starts: Column) -> Column:
            def entry(start: Column, k: Column) -> Column:
                stop = F.coalesce(F.get(starts, k + 1), F.size(own))
                values = F.transform(F.sequence(start, stop - 1), lambda i: F.get(own, i)["value"])
                key = F.get(own, start)["key"]
                return F.struct(F.get(own, start)["no"].alias("no"), key.alias("key"), finished(key, values).alias("values"))

            return F.array_sort(F.transform(starts, entry))

        return bind(firsts, run)

    entries = F.transform(
        bind(F.array_sort(named), cut), lambda e: F.struct(e["key"].alias("key"), e["values"].alias("values"))
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    return F.when(F.size(fields) > 0, F.map_from_entries(entries)).otherwise(none)


def collect_fields(extracted: DataFrame, outputs: dict[str, Processor] | None = None) -> DataFrame:
    """``values``: key -> list of values, several selectors of a key appending to one list.

    ``outputs`` maps a key to a function of its list (an output processor); lists stay as they
    are by default.
    """
    keep = [c for c in extracted.columns if c != "fields"]
    return extracted.select(*keep, values_of(F.col("fields"), outputs).alias("values"))


def item_list(values: Column) -> Column:
    """The items :func:`expand_items` makes of a page's lists, ``array<struct<pos, record, image_urls>>``; NULL if none."""

    def made(own: Column, lists: Column) -> Column:
        count = F.array_max(F.transform(F.map_values(lists), lambda v: F.size(v)))

        def record(i: Column) -> Column:
            present = F.map_filter(lists, lambda k, v: F.size(v) > i)
            return F.struct(
                i.cast("int").alias("pos"),
                F.transform_values(present, lambda k, v: v[i]).alias("record"),
                F.when(i == 0, own[IMAGES]).alias(IMAGES),
            )

        # zero-length sequences do not exist, so pages without fields give no array at all
        return bind(count, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), record)))

    named = lambda k, v: (k != IMAGES) & ~F.startswith(k, F.lit("_"))
    return bind(values, lambda own: bind(F.map_filter(own, named), lambda lists: made(own, lists)))


def expand_items(collected: DataFrame) -> DataFrame:
    """Parallel lists to items: the i-th values form item i (``pos``, ``record``).

    The longest list sets the count, the image list does not; shorter lists leave their field
    absent. Image URLs come with item 0; a page with no other field has no item.
    """
    keep = [c for c in collected.columns if c != "values"]
    return collected.select(*keep, F.inline(item_list(F.col("values"))))


def with_provenance(items: DataFrame, job_id: int, job_name: str, job_type: str) -> DataFrame:
    """Job and page every item came from."""
    return items.select(
        "*",
        F.lit(job_id).alias("job_id"),
        F.lit(job_name).alias("job_name"),
        F.lit(job_type).alias("job_type"),
        F.col("url").alias("scraped_url"),
    )


def to_wide(items: DataFrame, keys: list[str]) -> DataFrame:
    """One column per key; absent fields are NULL."""
    keep = [c for c in items.columns if c != "record"]
    return items.select(*keep, *[F.col("record")[k].alias(k) for k in keys])


def to_records(items: DataFrame, keys: list[str]) -> DataFrame:
    """Wide items under their reserved names: the given fields, then job, page and image columns.

    ``items`` carry their provenance; ``_postinfo`` is part of the spec, not of the rows, and stays
    NULL.
    """
    values = (
        F.col("job_id"),
        F.col(IMAGES),
        F.col("images") if "images" in items.columns else F.lit(None).cast("array<struct<url:string,path:string>>"),
        F.lit(None).cast("string"),
        F.col("job_type"),
        F.col("scraped_url"),
        F.col("job_name"),
    )
    reserved = [value.alias(name) for name, value in zip(RESERVED_FIELDS, values)]
    return items.select(*[F.col("record")[k].alias(k) for k in keys], *reserved)


def attrs_matching(dom: DataFrame, tags: list[str], attrs: list[str], regex: str) -> DataFrame:
    """Given attributes of given tags whose value matches: ``pre, tag, attr, value``."""
    found = F.flatten(
        F.transform(
            F.filter("nodes", lambda n: n["tag"].isin(*tags)),
            lambda n: F.transform(
                F.array(*[F.lit(a) for a in attrs]),
                lambda a: F.struct(
                    n["pre"].alias("pre"), n["tag"].alias("tag"), a.alias("attr"), n["attrs"][a].alias("value")
                ),
            ),
        )
    )
    keep = [c for c in dom.columns if c != "nodes"]
    return dom.select(*keep, F.inline(F.filter(found, lambda f: f["value"].rlike(regex))))


def filter_pages(pages: DataFrame, predicate: Column | Callable | None) -> DataFrame:
    """Pages a predicate accepts; use it before shredding.

    A Column is evaluated in the JVM; a Python function of the page text runs as an Arrow UDF.
    """
    if predicate is None:
        return pages
    if isinstance(predicate, Column):
        return pages.filter(predicate)
    accepts = F.udf(lambda body: bool(predicate(body)), "boolean", useArrow=True)
    return pages.filter(accepts("html"))
