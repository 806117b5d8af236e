"""Fields, items and whole jobs on hand-written pages."""

import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.functions.text import call_arg, clean_key, decode_text, header, highlight, strip
from pageloom.model import (
    CSS,
    INVALID_KEY,
    TABLE_HHEADERS,
    TABLE_VHEADERS,
    WORDLIST,
    XPATH,
    ContentSelector,
    FieldSelector,
    ImageSelector,
    ItemSelector,
    Job,
    JobPath,
    KeyValueSelector,
    MainPage,
    Merge,
    TableSelector,
    Url,
    UrlSelector,
)
from pageloom.operators import fields as Fd
from pageloom.operators import tables as T
from pageloom.operators.post import post_process, run_chain, standard_chain
from pageloom.operators.shred import shred
from pageloom.plans.session import materialise
from pageloom.plans.crawl import crawl, crawl_list, job_table, run_jobs
from pageloom.sources.records import site_params


def css(text):
    return FieldSelector(text, CSS)


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, strip(lit("\t  a b  \n"))) == "a b"
    assert one(spark, strip(lit(5))) == "5"
    assert [one(spark, clean_key(lit(k))) for k in ("Key:", "Key::", "Ключ", "k_", "é)", "", "a\n")] == [
        "Key", "Key:", "Ключ", "k_", "é", "", "a",
    ]
    assert one(spark, call_arg(lit("FillFullSize(1, http://x/y.jpg ,2)"))) == "http://x/y.jpg"
    assert one(spark, call_arg(lit(" FillFullSize(1, 2)"))) == " FillFullSize(1, 2)"
    assert one(spark, call_arg(lit("FillFullSize"))) is None
    assert one(spark, header(lit("hELLO wORLD"))) == "Hello world"
    assert one(spark, highlight(lit("ab Ab ab"), " ab ")) == "<font color='red'><bold>ab</bold></font> Ab <font color='red'><bold>ab</bold></font>"
    assert one(spark, highlight(lit("ab"), "  ")) == "ab"


def test_bytes_decode_with_fallback(spark):
    df = spark.createDataFrame([(1, bytearray("né€", "utf-8")), (2, bytearray("né", "latin-1")), (3, bytearray(b""))], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(decode_text(F.col("b"))).collect()] == ["né€", "né", ""]


def items(page, spec, *sources):
    dom = page(*sources)
    return Fd.expand_items(Fd.collect_fields(Fd.process_fields(Fd.extract_fields(dom, spec))))


def test_parallel_lists_expand_to_the_longest_and_images_do_not_count(page):
    spec = ItemSelector(
        (
            KeyValueSelector("a", css("i::text")),
            KeyValueSelector("b", css("b::text")),
            KeyValueSelector("none", css("u::text")),
            KeyValueSelector("pic", ImageSelector("img::src", CSS)),
        )
    )
    html = "<i>1</i><i> 2 </i><i>3</i><b>x</b><b>y</b>" + "".join(f"<img src=p{i}.png>" for i in range(5))
    got = items(page, spec, html, "<img src=only.png>", "")
    assert rows(got, "page_id", "pos", "record") == [
        (1, 0, {"a": "1", "b": "x"}), (1, 1, {"a": "2", "b": "y"}), (1, 2, {"a": "3"}),
    ]
    images = {r["pos"]: r["image_urls"] for r in got.collect()}
    assert images == {0: [f"http://host.example:8080/p{i}.png" for i in range(5)], 1: None, 2: None}


def test_dynamic_keys_take_the_first_match(page):
    spec = ItemSelector((KeyValueSelector(css("th::text"), css("td::text")),))
    got = Fd.field_rows(Fd.extract_fields(page("<td>v", "<th>K</th><td>v", "<th>K</th><th>L</th><td>v"), spec))
    assert rows(got, "page_id", "key", "value") == [(1, INVALID_KEY, "v"), (2, "K", "v"), (3, "K", "v")]


def test_selectors_of_one_key_append_in_order_and_tables_come_last(page):
    spec = ItemSelector(
        (
            KeyValueSelector("t", TableSelector("table", CSS)),
            KeyValueSelector("k", css("b::text")),
            KeyValueSelector("k", FieldSelector("//i/text()", XPATH)),
        )
    )
    got = Fd.collect_fields(Fd.extract_fields(page("<i>1</i><b>2</b><b>3</b><table><tr><td>k<td>4</table>"), spec))
    assert got.first()["values"] == {"k": ["2", "3", "1", "4"]}


def test_output_processors_and_the_long_form(page):
    spec = ItemSelector((KeyValueSelector("k", css("b::text")), KeyValueSelector("m", css("i::text"))))
    fields = Fd.extract_fields(page("<b>1</b><i>2</i><b>3</b>"), spec)
    rows_back = Fd.regroup_fields(Fd.field_rows(fields).repartition(3))
    assert rows_back.first()["fields"] == fields.first()["fields"]
    first = Fd.collect_fields(fields, {"k": lambda v: F.slice(v, 1, 1)})
    assert first.first()["values"] == {"k": ["1"], "m": ["2"]}


def test_content_fields_skip_pages_without_region(page):
    spec = ItemSelector((KeyValueSelector("cpu", ContentSelector(FieldSelector("amd", WORDLIST), css("div"))),))
    got = Fd.field_rows(Fd.extract_fields(page("<div>AMD x</div>", "<div>x</div>", "<p>amd"), spec))
    assert rows(got, "page_id", "value") == [(1, "AMD x"), (2, "")]


def test_page_predicates(spark):
    pages = spark.createDataFrame([(1, "u", "yes"), (2, "v", "no"), (3, "w", None)], "page_id long, url string, html string")
    assert rows(Fd.filter_pages(pages, None), "page_id") == [(1,), (2,), (3,)]
    assert rows(Fd.filter_pages(pages, F.col("html") == "yes"), "page_id") == [(1,)]
    assert rows(Fd.filter_pages(pages, lambda body: body is not None and "y" in body), "page_id") == [(1,)]


KEYS_LEFT = """<table id=l><tr><td>Title</td></tr><tr><td>Make:</td><td>Acme</td><td> <b>Year:</b> </td><td><i>1</i></td></tr>
<tr><td>Odd</td><td>1</td><td>Last</td></tr><tr><td></td><td>lost</td></tr><tr><th>no</th></tr></table>"""
KEYS_TOP = """<table><tr><td>caption</td></tr><tr><th>A</th><th>B</th><th>C</th><th>D</th></tr>
<tr><td rowspan=3>a1</td><td>b1</td><td rowspan="2">c1</td><td>d1</td></tr><tr><td>b2</td><td>d2</td></tr>
<tr><td>b3</td><td>c3</td><td>d3</td></tr><tr><td>a4</td><td>b4</td></tr><tr></tr></table>"""


def test_keys_left_table(page):
    got = T.table_rows(page(KEYS_LEFT), TableSelector("#l", CSS, TABLE_HHEADERS)).collect()
    assert [(r["key"], r["value"]) for r in got] == [("Make", "Acme"), ("Year", "1"), ("Odd", "1"), ("Last", "")]


def test_keys_top_table_with_two_spans(page):
    got = {}
    for r in T.table_rows(page(KEYS_TOP), TableSelector("table", CSS, TABLE_VHEADERS)).collect():
        got.setdefault(r["key"], []).append(r["value"])
    assert got == {
        "A": ["a1", "a1", "a1", "a4"],
        "B": ["b1", "b2", "b3", "b4"],
        "C": ["c1", "c1", "c3"],
        "D": ["d1", "d2", "d3"],
    }


@pytest.mark.parametrize(
    "body, expected",
    [
        ("<tr><td rowspan=2>a<td>b<tr><td>c", [["a", "b"], ["a", "c"]]),
        ("<tr><td>a<td rowspan=2>b<tr><td>c<td>d", [["a", "b"], ["c", "b", "d"]]),
        ("<tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d", [["a", "b"], ["a", "c"], ["a", "d"]]),
        ("<tr><td rowspan=x>a<tr><td>b", [["a"], ["b"]]),
        ("<tr><td rowspan=3>a<td rowspan=2>b<tr><tr><td>c", [["a", "b"], ["a", "b"], ["a", "c"]]),
        ("<tr><td>p<td>q<td rowspan=2>r<tr><td>s", [["p", "q", "r"], ["s", None, "r"]]),
    ],
)
def test_row_spans(page, body, expected):
    got = T.expanded_rows(page(f"<table>{body}</table>"), "table").orderBy("row").collect()
    assert [r["cells"] for r in got] == expected


def test_table_kinds(page):
    got = T.tables(page(KEYS_LEFT.replace("<th>no</th>", "") + KEYS_TOP))
    assert rows(got, "table_no", "kind") == [(0, TABLE_HHEADERS), (1, TABLE_VHEADERS)]


def test_merges_follow_the_spec(spark):
    df = spark.createDataFrame([("10", "USD", None), (None, None, "x")], "value string, coin string, other string")
    done = post_process(df, [Merge(("value", "coin"), "price"), Merge(("price", "other"), "other", "-")])
    assert rows(done) == [("-x",), ("10USD",)]


def test_chain_runs_by_number(spark):
    df = spark.createDataFrame([(1, "a", "b", ["u"])], "_id int, x string, y string, image_urls array<string>")
    stages = standard_chain([Merge(("x", "y"), "z", "+")])
    stages[lambda d: d.filter("z = 'a+b'")] = 5
    assert rows(run_chain(df, stages)) == [(1, "a+b")]
    named = {"late": (2, lambda d: d.drop("y")), "early": (1, lambda d: d.withColumn("y", F.lit(1)))}
    assert run_chain(df, named).columns == ["_id", "x", "image_urls"]


SHOP = [
    (1, "http://shop.example/list", '<a class=item href="/i1">1</a><a class=item href="i2">2</a><a class=next href="/list?p=2">n</a>'),
    (2, "http://shop.example/list?p=2", '<a class=item href="/i2">2</a><a class=item href="http://cdn.example/i3">3</a><a class=next href="/list">n</a>'),
    (3, "http://shop.example/i1", "<h1>One</h1><b>5</b><b>EUR</b>"),
    (4, "http://shop.example/i2", "<h1>Two</h1><b>6</b><b>EUR</b>"),
    (5, "http://cdn.example/i3", "<h1>Three</h1>"),
    (6, "http://shop.example/other", "<h1>Never</h1>"),
]
MAIN = MainPage(
    UrlSelector("a.item", CSS),
    ItemSelector((KeyValueSelector("name", css("h1::text")),)),
    UrlSelector("a.next", CSS),
)


def test_whole_job(spark):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, html string")
    starts = spark.createDataFrame([("http://shop.example/list",)], "url string")
    got = Fd.to_wide(crawl(starts, MAIN, pages), ["name"])
    assert rows(got, "name") == [("One",), ("Three",), ("Two",)]
    visited = spark.createDataFrame([("http://shop.example/i1",)], "url string")
    assert rows(Fd.to_wide(crawl(starts, MAIN, pages, visited), ["name"]), "name") == [("Three",), ("Two",)]


def test_page_list_job(spark):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, html string")
    urls = spark.createDataFrame([(u,) for _, u, _ in SHOP[2:]] + [("http://gone.example/",)], "url string")
    got = crawl_list(urls, MAIN.items, pages, lambda body: "EUR" in body)
    assert rows(Fd.to_wide(got, ["name"]), "name") == [("One",), ("Two",)]


def test_job_table(spark):
    params = site_params(spark, {"http://a.example/": {"PREFERRED_SCRAPER": "selenium", "REQUEST_DELAY": 3}})
    paths = [JobPath().add(Url(f"http://{h}.example/x")).add(MAIN) for h in "abac"]
    jobs = [Job(i, f"j{i}", p) for i, p in enumerate(paths)]
    assert jobs[0].path.main_page is MAIN
    got = job_table(spark, jobs, params)
    assert rows(got, "job_name", "backend", "delay_s", "job_id") == [
        ("j0", "selenium", 3, 100), ("j1", "scrapy", 1, 0), ("j2", "selenium", 3, 101), ("j3", "scrapy", 1, 1),
    ]


def test_jobs_of_different_specs(spark):
    pages = spark.createDataFrame(SHOP, "page_id long, url string, html string")
    price = ItemSelector(
        (KeyValueSelector("name", css("h1::text")), KeyValueSelector("v", css("b:nth-of-type(1)::text")), KeyValueSelector("c", css("b:nth-of-type(2)::text"))),
        (Merge(("v", "c"), "price", " "),),
    )
    one_page = MainPage(UrlSelector("a", CSS), price, item_restrict=FieldSelector("a.item:nth-child(1)", CSS))
    jobs = [
        Job(0, "all", JobPath().add(Url("http://shop.example/list")).add(MAIN)),
        Job(1, "first", JobPath().add(Url("http://shop.example/list")).add(one_page)),
        Job(2, "gone", JobPath().add(Url("http://gone.example/")).add(MAIN)),
    ]
    params = site_params(spark, {"http://gone.example/": {"PREFERRED_SCRAPER": "selenium"}})
    got = run_jobs(jobs, pages, params).selectExpr("job_name", "job_id", "job_type", "to_json(record) AS r", "image_urls[0] AS i")
    icon = "http://shop.example/favicon.ico"
    assert rows(got) == sorted(
        [("all", 0, "scrapy", f'{{"name":"{n}"}}', None) for n in ("One", "Two", "Three")]
        + [("first", 1, "scrapy", '{"name":"One","price":"5 EUR"}', None)]
        + [("all", 0, "scrapy", "{}", icon), ("first", 1, "scrapy", "{}", icon)]
        + [("gone", 100, "selenium", "{}", "http://gone.example/favicon.ico")],
        key=repr,
    )


def test_edges_do_not_grow_with_jobs(spark, monkeypatch):
    from pageloom.plans import crawl as plan

    known, expand = [], plan.expand
    monkeypatch.setattr(plan, "expand", lambda start, edges, *a, **k: known.append(edges.count()) or expand(start, edges, *a, **k))
    pages = spark.createDataFrame(
        [(i, f"http://chain.example/{i}", f'<h1>n{i}</h1><a href="/{i + 1}">on</a>') for i in range(5)], "page_id long, url string, html string"
    )
    main = MainPage(None, ItemSelector((KeyValueSelector("name", css("h1::text")),)), UrlSelector("a", CSS))
    jobs = [Job(i, f"j{i}", JobPath().add(Url(f"http://chain.example/{i % 5}")).add(main)) for i in range(10)]
    got = run_jobs(jobs, pages, site_params(spark, {})).filter("page_id IS NOT NULL")
    assert rows(got, "job_name", "page_id") == sorted((f"j{i}", p) for i in range(10) for p in range(i % 5, 5))
    assert known == [5]


def test_start_pages_are_shredded_once_and_only_followers_have_a_frontier(spark, monkeypatch):
    from pageloom.plans import crawl as plan

    shred, expand, sent, seeds = plan.shred, plan.expand, [], []
    monkeypatch.setattr(plan, "shred", lambda pages, *a: sent.extend(rows(pages, "url")) or shred(pages, *a))
    monkeypatch.setattr(plan, "expand", lambda start, *a: seeds.extend(rows(start, "job_no")) or expand(start, *a))
    sources = ['<h1>a1</h1><a class="to" href="/2">x</a>', "<h1>a2</h1>", '<h1>b1</h1><a class="next" href="/2">x</a>', "<h1>b2</h1>"]
    urls = [f"http://{h}.example/{n}" for h in "ab" for n in (1, 2)]
    pages = spark.createDataFrame(list(zip(range(4), urls, sources)), "page_id long, url string, html string")
    spec = ItemSelector((KeyValueSelector("name", css("h1::text")),))
    merged = ItemSelector(spec.selectors, (Merge(("name", "name"), "twice", "+"),))
    mains = [MainPage(UrlSelector("a.to", CSS), spec), MainPage(None, merged), MainPage(None, spec, UrlSelector("a.next", CSS))]
    jobs = [Job(i, f"j{i}", JobPath().add(Url(urls[at])).add(main)) for i, (at, main) in enumerate(zip((0, 0, 2), mains))]

    def items(visited=None):
        got = run_jobs(jobs, pages, site_params(spark, {}), None, visited).filter("page_id IS NOT NULL")
        return rows(got.selectExpr("job_name", "page_id", "to_json(record) AS r"))

    followed = [("j2", 2, '{"name":"b1"}'), ("j2", 3, '{"name":"b2"}')]
    assert items() == [("j0", 1, '{"name":"a2"}'), ("j1", 0, '{"twice":"a1+a1"}'), *followed]
    assert sent.count((urls[0],)) == 1 and sent.count((urls[1],)) == 1
    assert seeds == [(2,)]
    assert items(spark.createDataFrame([(urls[0],)], "url string")) == [("j0", 1, '{"name":"a2"}'), *followed]


def test_repeated_jobs_keep_their_rows(spark):
    """A number may name several jobs: each is told of the pages and favicons of all."""
    from pageloom.plans.crawl import run_job_table

    pages = spark.createDataFrame([(1, "http://a.example/1", "<h1>x</h1>")], "page_id long, url string, html string")
    main = MainPage(None, ItemSelector((KeyValueSelector("name", css("h1::text")),)))
    table = [(0, "one", "http://a.example/1", 0), (0, "two", "http://a.example/1", 0), (5, "three", None, 0)]
    jobs = spark.createDataFrame(table, "seq long, job_name string, url string, spec int")
    got = run_job_table(jobs, [main], pages, site_params(spark, {})).select("job_name", "page_id")
    assert rows(got) == sorted([("three", None)] + [("one", 1), ("two", 1)] + 2 * [("one", None), ("two", None)], key=repr)


def seconds(df) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def test_spanned_rows_are_linear(spark):
    def dom(n: int):
        body = "<tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr>" * (n // 2)
        return materialise(shred(spark.createDataFrame([(n, f"<table>{body}</table>")], "page_id long, html string")))

    small, large = dom(2_000), dom(4_000)
    got = T.expanded_rows(small, "table").agg(F.count("*"), F.min(F.array_join("cells", "")), F.max(F.array_join("cells", ""))).first()
    assert tuple(got) == (2_000, "ab", "ac")
    seconds(T.expanded_rows(small, "table"))
    assert seconds(T.expanded_rows(large, "table")) < 3 * seconds(T.expanded_rows(small, "table")) + 1


def test_spans_cross_the_blocks_of_a_sweep(page):
    rows_ = ["<tr><td rowspan=70>s</td><td>0</td></tr>"] + [f"<tr><td>{i}</td></tr>" for i in range(1, 200)]
    got = T.expanded_rows(page(f"<table>{''.join(rows_)}</table>"), "table").orderBy("row").collect()
    assert [r["cells"] for r in got] == [["s", str(i)] for i in range(70)] + [[str(i)] for i in range(70, 200)]


def test_many_keys_are_linear(spark):
    fields = spark.range(1).select(
        F.transform(
            F.sequence(F.lit(0), F.lit(39_999)),
            lambda i: F.struct(
                F.lit(0).alias("selector_no"), F.concat(F.lit("k"), i % 20_000).alias("key"), i.alias("pos"), i.cast("string").alias("value")
            ),
        ).alias("fields")
    )
    got = Fd.collect_fields(fields).select(F.size("values"), F.col("values")["k7"], F.map_keys("values")[1]).first()
    assert tuple(got) == (20_000, ["7", "20007"], "k1")
    assert seconds(Fd.collect_fields(fields)) < 20
