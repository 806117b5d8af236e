"""Queries over job tables and sinks that are read back."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from pageloom.functions.text import decode_text
from pageloom.functions.urls import netloc
from pageloom.model import UNIQUE_ONCLICK
from pageloom.operators import job_states, jobs as C, links as L
from pageloom.operators.shred import shred
from pageloom.plans.session import fresh_path, materialise, spread
from pageloom.sinks import export as K
from pageloom.sources.pages import generated_urls, numbered_urls, read_pages, url_list
from pageloom.sources.records import read_records, scan_without, site_params, site_params_from
from pageloom.workload.pages import HOST
from pageloom.workload.registry import customer_pages, part_pages, query, table


@query("collection_without_key", "SELECT c_name, c_nationkey, c_mktsegment FROM customer")
def collection_without_key(spark, sf):
    return scan_without(table(spark, sf, "customer").drop("c_acctbal"), "c_custkey")


def _params(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("url")
    host = netloc(F.col("url"))
    mobile = host.startswith("m.")
    return site_params_from(
        pages,
        F.col("url"),
        backend=F.when(mobile, "selenium"),
        delay_s=F.when(F.col("url").startswith("https"), 3),
    )


PARAMS = (
    f"SELECT {HOST} AS netloc, min(CASE WHEN starts_with({HOST}, 'm.') THEN 'selenium' END) AS backend, "
    f"CAST(min(CASE WHEN url LIKE 'https%' THEN 3 END) AS INTEGER) AS delay_s FROM pages GROUP BY 1"
)


@query("site_parameters", PARAMS)
def site_parameters(spark, sf):
    return _params(spark, sf)


@query(
    "pages_with_site_parameters",
    f"SELECT p.page_id, p.netloc, s.backend, s.delay_s FROM (SELECT page_id, {HOST} AS netloc FROM pages) p LEFT JOIN ({PARAMS}) s ON p.netloc = s.netloc",
)
def pages_with_site_parameters(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url")
    return C.with_params(pages, _params(spark, sf)).select("page_id", "netloc", "backend", "delay_s")


@query(
    "site_parameters_with_defaults",
    f"SELECT p.page_id, coalesce(s.backend, 'scrapy') AS backend, coalesce(s.delay_s, 1) AS delay_s FROM "
    f"(SELECT page_id, {HOST} AS netloc FROM pages) p LEFT JOIN ({PARAMS}) s ON p.netloc = s.netloc",
)
def site_parameters_with_defaults(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url")
    return C.with_defaults(C.with_params(pages, _params(spark, sf))).select("page_id", "backend", "delay_s")


SETTINGS = {
    "http://blog.tionsh.example.net/": {"PREFERRED_SCRAPER": "selenium", "REQUEST_DELAY": 3},
    "https://thther.example.org/list?page=1": {"REQUEST_DELAY": 2},
}


@query(
    "site_parameters_of_settings",
    f"SELECT page_id, CASE {HOST} WHEN 'blog.tionsh.example.net' THEN 'selenium' ELSE 'scrapy' END AS backend, "
    f"CAST(CASE {HOST} WHEN 'blog.tionsh.example.net' THEN 3 WHEN 'thther.example.org' THEN 2 ELSE 1 END AS INTEGER) AS delay_s "
    "FROM pages",
)
def site_parameters_of_settings(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url")
    return C.with_defaults(C.with_params(pages, site_params(spark, SETTINGS))).select("page_id", "backend", "delay_s")


def _jobs(spark, sf):
    """Orders as job specs; the order status stands for the backend."""
    backend = F.when(F.col("o_orderstatus") == "F", "selenium").when(F.col("o_orderstatus") == "O", "scrapy").otherwise("other")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), backend.alias("backend"), F.col("o_orderpriority").alias("name")
    )


JOBS = (
    "SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'selenium' WHEN 'O' THEN 'scrapy' ELSE 'other' END AS backend, "
    "o_orderpriority AS name FROM orders"
)


@query(
    "jobs_grouped_by_backend",
    f"SELECT backend, seq // 1000 AS part, CAST(count(*) AS INTEGER) AS size, string_agg(seq || ':' || name, '|' ORDER BY seq) AS jobs FROM ({JOBS}) GROUP BY 1, 2",
)
def jobs_grouped_by_backend(spark, sf):
    grouped = C.group_jobs(_jobs(spark, sf))
    text = F.array_join(F.transform("jobs", lambda j: F.concat_ws(":", j["seq"].cast("string"), j["name"])), "|")
    return grouped.select("backend", "part", "size", text.alias("jobs"))


@query(
    "job_ids_per_backend",
    f"SELECT seq, backend, row_number() OVER (PARTITION BY backend ORDER BY seq) - 1 + CASE WHEN backend = 'selenium' THEN 100 ELSE 0 END AS job_id FROM ({JOBS})",
)
def job_ids_per_backend(spark, sf):
    return C.assign_ids(_jobs(spark, sf), width=1000).select("seq", "backend", "job_id")


@query("next_job_id", "SELECT max(event_id) + 1 AS next_id FROM events")
def next_job_id(spark, sf):
    return C.next_id(table(spark, sf, "events"), "event_id")


@query("next_job_id_of_empty_table", "SELECT CAST(coalesce(max(event_id) + 1, 100) AS BIGINT) AS next_id FROM events WHERE event_type = 'none'")
def next_job_id_of_empty_table(spark, sf):
    return C.next_id(table(spark, sf, "events").filter("event_type = 'none'"), "event_id", first=100)


@query(
    "job_states_latest",
    "SELECT 'job' || user_id AS job_name, arg_max(event_type, event_id) AS job_type, max(event_id) AS version FROM events GROUP BY user_id",
)
def job_states_latest(spark, sf):
    events = table(spark, sf, "events")
    path = fresh_path(spark, "states")
    states = events.select(
        F.concat(F.lit("job"), "user_id").alias("job_name"),
        F.col("event_type").alias("job_type"),
        F.col("event_id").alias("version"),
    )
    states.write.parquet(f"{path}/states")
    return C.latest_states(spark, path).select("job_name", "job_type", "version")


@query("job_visited_urls", "SELECT DISTINCT url FROM pages")
def job_visited_urls(spark, sf):
    path = fresh_path(spark, "state")
    pages = read_pages(spark, f"{sf}/pages.parquet").select("url")
    C.init_state(spark, path, "shop", "scrapy")
    C.save_state(spark, path, "shop", pages.filter(F.col("url").contains("/en/")))
    C.save_state(spark, path, "shop", pages)
    return C.visited_urls(spark, path, "shop")


def _records(spark, sf):
    """Parts as records whose keys depend on the part."""
    c = F.col
    optional = F.array(
        F.when(c("p_size") > 10, "size"), F.when(c("p_type") == "ECONOMY", "cheap"), F.when(c("p_retailprice") > 905, "price")
    )
    keys = F.concat(F.array(F.lit("name"), F.lit("brand")), F.filter(optional, lambda k: k.isNotNull()))
    values = F.create_map(
        F.lit("name"), c("p_name"), F.lit("brand"), c("p_brand"), F.lit("size"), c("p_size").cast("string"),
        F.lit("cheap"), F.lit("yes"), F.lit("price"), F.lit("high"),
    )
    part = table(spark, sf, "part").select(c("p_partkey").alias("seq"), keys.alias("keys"), values.alias("all"))
    record = F.map_from_arrays("keys", F.transform("keys", lambda k: F.col("all")[k]))
    return part.select("seq", record.alias("record"))


RECORD_KEYS = (
    "SELECT p_partkey AS seq, list_concat(['name', 'brand'], list_filter([CASE WHEN p_size > 10 THEN 'size' END, "
    "CASE WHEN p_type = 'ECONOMY' THEN 'cheap' END, CASE WHEN p_retailprice > 905 THEN 'price' END], lambda k: k IS NOT NULL)) AS keys FROM part"
)


@query("widest_record_columns", f"SELECT array_to_string(keys, ',') AS columns FROM ({RECORD_KEYS}) ORDER BY len(keys) DESC, seq LIMIT 1")
def widest_record_columns(spark, sf):
    widest = K.widest_columns(_records(spark, sf), F.map_keys("record"), "seq")
    return widest.select(F.array_join("columns", ",").alias("columns"))


@query(
    "csv_export_of_records",
    "SELECT p_name AS name, p_brand AS brand, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size, "
    "CASE WHEN p_type = 'ECONOMY' THEN 'yes' ELSE '' END AS cheap, CASE WHEN p_retailprice > 905 THEN 'high' ELSE '' END AS price FROM part",
)
def csv_export_of_records(spark, sf):
    path = fresh_path(spark, "records")
    K.export(K.wide_by_widest(_records(spark, sf), "record", "seq"), path, "CSV")
    return spark.read.option("header", True).csv(f"{path}.csv").na.fill("")


@query("csv_export_of_texts", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_export_of_texts(spark, sf):
    path = fresh_path(spark, "texts")
    K.export_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return spark.read.options(header=True, multiLine=True, **K.CSV_OPTIONS).schema("doc_id string, text string").csv(path)


@query("json_export_of_documents", "SELECT doc_id, lang, text FROM documents")
def json_export_of_documents(spark, sf):
    path = fresh_path(spark, "documents")
    K.export(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "JSON")
    return read_records(spark, f"{path}.json", "doc_id long, lang string, text string", multi_line=False)


@query("collection_export", "SELECT c_name, c_mktsegment FROM customer")
def collection_export(spark, sf):
    path = fresh_path(spark, "customers")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id"), "c_name", "c_mktsegment")
    K.export_table(customers, path)
    return spark.read.option("header", True).csv(path)


@query(
    "batch_export",
    "SELECT 'customers' AS source, c_name AS name FROM customer UNION ALL SELECT 'suppliers', s_name FROM supplier",
)
def batch_export(spark, sf):
    folder = fresh_path(spark, "batch")
    tables = {
        "Customers": table(spark, sf, "customer").select(F.col("c_name").alias("name")),
        "Suppliers": table(spark, sf, "supplier").select(F.col("s_name").alias("name")),
    }
    K.export_all(tables, folder, "JSON")
    read = [
        spark.read.schema("name string").json(f"{folder}/{name}.json").select(F.lit(name).alias("source"), "name")
        for name in ("customers", "suppliers")
    ]
    return read[0].unionByName(read[1])


@query(
    "decoded_bytes",
    "SELECT doc_id, text FROM documents",
)
def decoded_bytes(spark, sf):
    # one half of the languages stored as Latin-1, the other as UTF-8
    raw = F.when(F.col("lang").isin("fr", "es"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", decode_text(raw).alias("text"))


@query("visited_pages_appended", "SELECT DISTINCT 'job' || user_id AS job_name, 'http://e.example.com/' || event_type AS url FROM events")
def visited_pages_appended(spark, sf):
    path = fresh_path(spark, "visited")
    items = table(spark, sf, "events").select(
        F.concat(F.lit("job"), "user_id").alias("job_name"),
        F.concat(F.lit("http://e.example.com/"), "event_type").alias("scraped_url"),
    )
    for batch in ("first", "second", "first"):  # the first is done again
        K.append_visited(items.filter((F.col("job_name") < "job5") == (batch == "first")), path, batch)
    return spark.read.schema("job_name string, url string").parquet(path).select("job_name", "url")


@query(
    "image_manifest",
    "SELECT 'http://img.example.com/' || p_brand || '/' || p_partkey || '.jpg' AS url, '/store/' || p_type || '/' || p_partkey || '.jpg' AS path, "
    "p_type <> 'ECONOMY' AS fetch FROM part",
)
def image_manifest(spark, sf):
    part = table(spark, sf, "part")
    url = F.concat(F.lit("http://img.example.com/"), "p_brand", F.lit("/"), "p_partkey", F.lit(".jpg"))
    items = part.select(F.array(url).alias("image_urls"), "p_type")
    stored = part.filter("p_type = 'ECONOMY'").select(
        F.concat(F.lit("/store/ECONOMY/"), "p_partkey", F.lit(".jpg")).alias("path")
    )
    return K.image_manifest(items, "/store", F.col("p_type"), stored)


@query(
    "urls_generated_per_seed",
    "SELECT c_custkey AS seed, n AS pos, 'http://shop.example.com/' || c_mktsegment || '?p=' || n AS url FROM customer, range(3) t(n)",
)
def urls_generated_per_seed(spark, sf):
    seeds = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("seed"), "c_mktsegment"), "seed")
    pages_of = lambda segment: (f"http://shop.example.com/{segment}?p={n}" for n in range(3))
    return generated_urls(seeds, "c_mktsegment", pages_of).select("seed", "pos", "url")


EVENT_URLS = "SELECT 'job' || user_id AS job_name, 'http://e.example.com/' || event_type || '/' || event_id % 7 AS url, event_id % 3 AS wave FROM events"


@query(
    "states_of_many_jobs",
    f"WITH e AS ({EVENT_URLS}), last AS (SELECT DISTINCT job_name, url FROM e WHERE wave = 2 AND job_name < 'job5'), "
    "kept AS (SELECT DISTINCT job_name, url FROM e WHERE job_name NOT IN (SELECT job_name FROM last) UNION SELECT * FROM last) "
    "SELECT k.job_name, t AS job_type, CAST(v AS BIGINT) AS version, url FROM kept k JOIN ("
    "SELECT job_name, min(event_type) AS t, max(CASE WHEN wave = 0 THEN 1 ELSE 0 END) + max(CASE WHEN wave = 1 THEN 1 ELSE 0 END) "
    "+ max(CASE WHEN wave = 2 THEN 1 ELSE 0 END) + max(CASE WHEN wave = 2 AND job_name < 'job5' THEN 1 ELSE 0 END) AS v "
    "FROM (SELECT 'job' || user_id AS job_name, event_type, event_id % 3 AS wave FROM events) GROUP BY 1) s ON s.job_name = k.job_name",
)
def states_of_many_jobs(spark, sf):
    """Jobs of all users: three saves, one that replaces the URLs of some, and a compaction."""
    path = fresh_path(spark, "states")
    events = table(spark, sf, "events").select(
        F.concat(F.lit("job"), "user_id").alias("job_name"),
        F.concat(F.lit("http://e.example.com/"), "event_type", F.lit("/"), F.col("event_id") % 7).alias("url"),
        F.col("event_type").alias("job_type"),
        (F.col("event_id") % 3).alias("wave"),
    )
    job_states.create(spark, path, events.select("job_name", "job_type"))
    for wave in range(3):
        job_states.save(spark, path, events.filter(F.col("wave") == wave))
    job_states.save(spark, path, events.filter("wave = 2 AND job_name < 'job5'"), replace=True)
    job_states.compact(spark, path, f"{path}-compact")
    path = f"{path}-compact"
    return job_states.states(spark, path).hint("merge").join(job_states.visited(spark, path), "job_name")


@query("decoded_nested_bytes", "SELECT doc_id, lang AS key, text, text[1:40] AS head, source FROM documents")
def decoded_nested_bytes(spark, sf):
    """Binary keys and values of maps, elements of arrays and fields of structs, in UTF-8 or Latin-1."""
    latin = F.col("lang").isin("fr", "es")
    raw = lambda c: F.when(latin, F.encode(c, "ISO-8859-1")).otherwise(F.encode(c, "UTF-8"))
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.create_map(raw(F.coalesce("lang", F.lit("?"))), F.array(raw(F.col("text")))).alias("m"),
        F.struct(raw(F.substring("text", 1, 40)).alias("head"), F.struct(F.encode("source", "UTF-8").alias("source")).alias("in")).alias("s"),
    )
    text = K.decode_bytes(docs)
    return text.select("doc_id", F.map_keys("m")[0].alias("key"), F.map_values("m")[0][0].alias("text"), "s.head", "s.in.source")


@query("records_from_json_arrays", "SELECT p_partkey, p_name, p_size FROM part")
def records_from_json_arrays(spark, sf):
    """Parts stored as JSON arrays of records, a file per slice, and read back."""
    path = fresh_path(spark, "arrays")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    # one array per slice of parts, of a bounded number of records
    arrays = part.groupBy(F.floor(F.col("p_partkey") / 500)).agg(F.to_json(F.collect_list(F.struct(*part.columns))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_records(spark, path, "p_partkey long, p_name string, p_size int")


@query(
    "guarded_exports",
    "SELECT 'first' AS run, count(*) AS rows FROM region UNION ALL SELECT 'refused', (SELECT count(*) FROM region) UNION ALL "
    "SELECT 'skipped', (SELECT count(*) FROM region) UNION ALL SELECT 'replaced', count(*) FROM nation",
)
def guarded_exports(spark, sf):
    """An existing export stops a second one, is left alone, or is replaced."""
    path = fresh_path(spark, "guarded")
    region, nation = (table(spark, sf, t).select(F.col(f"{t[0]}_name").alias("name")) for t in ("region", "nation"))
    seen = []

    def count(run: str) -> None:
        stored = materialise(spark.read.option("header", True).schema("name string").csv(f"{path}.csv"))
        seen.append(stored.agg(F.lit(run).alias("run"), F.count("*").alias("rows")))

    K.export(region, path, "CSV")
    count("first")
    try:
        K.export(nation, path, "CSV")
    except AnalysisException:
        count("refused")
    K.export(nation, path, "CSV", mode="ignore")
    count("skipped")
    K.export(nation, path, "CSV", mode="overwrite")
    count("replaced")
    return reduce(DataFrame.unionByName, seen)


@query(
    "numbered_urls_with_pages",
    "SELECT n AS seq, 'http://shop.example.com/customer/' || n AS url, c_custkey AS page_id FROM "
    "range(1, (SELECT max(c_custkey) + 51 FROM customer)) t(n) LEFT JOIN customer ON c_custkey = n",
)
def numbered_urls_with_pages(spark, sf):
    """URLs from a numbered template, beyond the last captured page."""
    last = table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    urls = numbered_urls(spark, "http://shop.example.com/customer/%d", last + 50)
    return url_list(urls, customer_pages(spark, sf).select("url", "page_id")).select("seq", "url", "page_id")


@query(
    "distinct_links_by_onclick",
    "SELECT p_partkey AS page_id, 'FillFullSize(1, http://img.example.com/' || p_partkey || '.jpg , 3)' AS key, CAST(1 AS BIGINT) AS uses FROM part",
)
def distinct_links_by_onclick(spark, sf):
    records = L.link_records(shred(part_pages(spark, sf)))
    return L.distinct_links(records, ["page_id"], UNIQUE_ONCLICK, "pre").select("page_id", "key", "uses")
