"""Record exports; every write is distributed and has a Spark save mode as overwrite guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pageloom.functions.binding import bind
from pageloom.functions.text import decode_text
from pageloom.functions.urls import file_name
from pageloom.plans.session import materialise_counted
from pageloom.sources.records import scan_without

FORMATS = ("CSV", "JSON")
# Cells as they are: quotes doubled inside quoted cells, edge spaces kept, empty text left empty.
CSV_OPTIONS = {
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def widest_columns(records: DataFrame, keys: Column, order: str) -> DataFrame:
    """Keys of the record with most keys, the first one on ties: one row, ``columns``."""
    return records.agg(F.max_by(keys, F.struct(F.size(keys), -F.col(order))).alias("columns"))


def wide_by_widest(records: DataFrame, record: str, order: str) -> DataFrame:
    """Map records as columns named by the widest record; other keys are dropped, missing ones empty.

    Only that one list of names reaches the driver.
    """
    columns = widest_columns(records, F.map_keys(record), order).first()["columns"] or []
    return records.select(*[F.coalesce(F.col(record)[c], F.lit("")).alias(c) for c in columns])


def decoded(value: Column, kind: T.DataType) -> Column:
    """A value with every binary in it as text: elements, keys and values of maps, fields of structs."""
    if isinstance(kind, T.BinaryType):
        return decode_text(value)
    if not _holds_binary(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: decoded(x, kind.elementType))
    if isinstance(kind, T.MapType):
        # of keys that decode to the same text the last counts
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(decoded(e["key"], kind.keyType).alias("key"), decoded(e["value"], kind.valueType).alias("value")),
        )
        last = F.filter(
            bind(entries, lambda es: F.transform(es, lambda e, i: F.struct(e.alias("e"), i.alias("i"), es.alias("es")))),
            lambda x: ~F.exists(F.slice(x["es"], x["i"] + 2, F.size(x["es"])), lambda o: o["key"] == x["e"]["key"]),
        )
        return F.map_from_entries(F.transform(last, lambda x: x["e"]))
    fields = [decoded(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
    return F.when(value.isNotNull(), F.struct(*fields))


def _holds_binary(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_binary(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_binary(kind.keyType) or _holds_binary(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_binary(f.dataType) for f in kind.fields)
    return isinstance(kind, T.BinaryType)


def decode_bytes(df: DataFrame) -> DataFrame:
    """Binary values as text, wherever they are nested."""
    found = {f.name: decoded(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if _holds_binary(f.dataType)}
    return df.withColumns(found) if found else df


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and records; missing cells are empty; no records give no header."""
    text = decode_bytes(df)
    text = text.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in text.columns])
    text, n = materialise_counted(text)  # the header hangs on the count: run the input once, not twice
    header = n > 0
    text.write.mode(mode).options(header=header, **CSV_OPTIONS).csv(path)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, UTF-8, absent fields left out."""
    decode_bytes(df).write.mode(mode).json(path)


def export(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported export format: <{fmt}>")
    (export_csv if fmt == "CSV" else export_json)(df, f"{path}.{fmt.lower()}", mode)


def export_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A stored collection without its key column as CSV."""
    export_csv(scan_without(df, "_id"), path, mode)


def export_all(tables: dict[str, DataFrame], folder: str, fmt: str, mode: str = "errorifexists", names=None) -> None:
    """Every named table (or those in ``names``) below ``folder`` under its lower-cased name."""
    for name in names or tables:
        if name not in tables:
            raise ValueError(f"no table named {name!r}")
        export(tables[name], f"{folder.rstrip('/')}/{name.lower()}", fmt, mode)


def image_manifest(
    items: DataFrame, root: str, folder: Column, existing: DataFrame | None = None, replace: bool = False
) -> DataFrame:
    """Where each image URL is stored: ``url, path, fetch``.

    A path listed in ``existing`` is reused (``fetch`` is false) unless ``replace``.
    """
    urls = items.select(F.explode("image_urls").alias("url"), folder.alias("_folder")).distinct()
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("_folder"), F.lit("/"), file_name(F.col("url")))
    manifest = urls.select("url", path.alias("path"))
    if existing is None or replace:
        return manifest.withColumn("fetch", F.lit(True))
    stored = existing.select("path").distinct().withColumn("_stored", F.lit(True))
    return manifest.join(stored, "path", "left").select("url", "path", F.col("_stored").isNull().alias("fetch"))


def append_visited(items: DataFrame, path: str, batch: str) -> None:
    """Record the page of every item in its job's progress.

    ``batch`` names the work that made the items: run again, it overwrites its own rows instead of doubling them.
    """
    rows = items.select("job_name", F.col("scraped_url").alias("url")).distinct()
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
