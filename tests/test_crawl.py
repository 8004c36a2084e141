import pytest
from pyspark.sql import functions as F

from bindery.operators.fetch import classify, crawl_counters, fetch_urls, new_files, site_table
from bindery.operators.traverse import Runs, traverse_site
from bindery.sources.sinks import append_pages, read_page_store

LOG = "url string, status int, content_type string, body string"
ROOT = "https://site.example/docs/"


def page(*hrefs):
    return "<main><h1>P</h1>" + "".join(f'<a href="{h}">l</a>' for h in hrefs) + "</main>"


def answers(spark, site):
    rows = []
    for url, value in site.items():
        status, kind, body = value if isinstance(value, tuple) else (200, "text/html; charset=utf-8", value)
        rows.append((url, status, kind, body))
    return spark.createDataFrame(rows, LOG)


def walk(spark, site, start=ROOT, cached=None, **kw):
    crawl = traverse_site(answers(spark, site), start, cached=cached, **kw)
    return [tuple(r) for r in crawl.select("url", "depth", "outcome", "filename").orderBy("visit_seq").collect()]


def urls(rows):
    return [r[0] for r in rows]


def test_one_answer_counts_for_a_url(spark):
    rows = [
        (ROOT, 200, "text/html", page("a")), (ROOT + "a", 500, None, None), (ROOT + "a", 200, "text/html", page()),
        (ROOT + "a", 200, "text/html", page()), (ROOT + "b", 404, None, None), (ROOT + "b", 200, "image/png", None),
    ]
    log = spark.createDataFrame(rows, LOG)
    crawl = traverse_site(log, ROOT)
    assert [tuple(r) for r in crawl.select("url", "outcome").orderBy("visit_seq").collect()] == [
        (ROOT, "downloaded"), (ROOT + "a", "downloaded"),
    ]
    assert new_files(crawl, log).count() == 2
    asked = spark.createDataFrame([(ROOT + "a", 0), (ROOT + "b", 1)], "url string, visit_seq long")
    got = fetch_urls(asked, log, ROOT).orderBy("visit_seq").collect()
    assert [r.outcome for r in got] == ["downloaded", "non_html"]


def test_cycle_is_walked_once_in_breadth_first_order(spark):
    site = {
        ROOT: page("a", "b", "https://elsewhere.example/x", "mailto:m@x"),
        ROOT + "a": page(ROOT, "b", "c#top"),
        ROOT + "b": page("a?x=1", "./c"),
        ROOT + "c": page("/docs/"),
    }
    rows = walk(spark, site)
    assert urls(rows) == [ROOT, ROOT + "a", ROOT + "b", ROOT + "c"]
    assert [r[1] for r in rows] == [0, 1, 1, 2]
    assert {r[2] for r in rows} == {"downloaded"}


def test_broken_link_is_a_failure_and_pdf_is_not(spark):
    site = {
        ROOT: page("gone", "paper", "missing"),
        ROOT + "gone": (404, "text/html", page("never")),
        ROOT + "paper": (200, "application/pdf", "%PDF"),
    }
    assert [(r[0].removeprefix(ROOT), r[2]) for r in walk(spark, site)] == [
        ("", "downloaded"), ("gone", "failed"), ("paper", "non_html"), ("missing", "failed"),
    ]


@pytest.mark.parametrize("budget", [0, 1, 3, 5, 100])
def test_page_budget_counts_every_visit(spark, budget):
    site = {ROOT: page("a", "gone", "b", "c"), **{ROOT + x: page("d", "e") for x in "abc"}}
    full = ["", "a", "gone", "b", "c", "d", "e"]
    assert urls(walk(spark, site, max_pages=budget)) == [ROOT + x for x in full[:budget]]


def test_scope_prefix_and_start_outside_it(spark):
    site = {ROOT: page("/blog/x", "y"), "https://site.example/blog/x": page("z"), ROOT + "y": page()}
    assert urls(walk(spark, site)) == [ROOT, ROOT + "y"]
    assert urls(walk(spark, site, url_prefix="https://site.example/blog/")) == [
        ROOT, "https://site.example/blog/x", "https://site.example/blog/z",
    ]


def test_start_with_query_is_not_canonicalised(spark):
    start = ROOT + "?v=1"
    site = {start: page("/docs/"), ROOT: page("a"), ROOT + "a": page()}
    rows = walk(spark, site, start=start)
    # the plain URL maps to the same file name, so it is a cache hit showing the first page's content
    assert [(r[0], r[2]) for r in rows] == [(start, "downloaded"), (ROOT, "cached")]


def test_file_name_collision_shows_the_first_claimants_links(spark):
    site = {
        ROOT: page("a/b", "a_b"),
        ROOT + "a/b": page("one"),
        ROOT + "a_b": page("lost"),
        ROOT + "a/one": page(),
        ROOT + "one": page(),
    }
    rows = walk(spark, site)
    assert [(r[0].removeprefix(ROOT), r[2]) for r in rows] == [
        ("", "downloaded"), ("a/b", "downloaded"), ("a_b", "cached"), ("a/one", "downloaded"), ("one", "downloaded"),
    ]


def test_cached_page_is_not_fetched_but_still_yields_links(spark):
    site = {ROOT: (500, "text/html", ""), ROOT + "new": page(), ROOT + "old": page("ignored")}
    cached = spark.createDataFrame([("index.html", page("new", "old")), ("docs_old.html", page())], "filename string, html string")
    rows = walk(spark, site, cached=cached)
    assert [(r[0].removeprefix(ROOT), r[2]) for r in rows] == [("", "cached"), ("new", "downloaded"), ("old", "cached")]


def test_start_page_missing(spark):
    assert walk(spark, {ROOT + "x": page()}) == [(ROOT, 0, "failed", "index.html")]


def test_url_list_keeps_duplicates_and_follows_nothing(spark):
    site = answers(spark, {ROOT: page("a"), ROOT + "a": page("b"), ROOT + "p": (200, "application/pdf", "")})
    wanted = [ROOT + "a", ROOT + "a", ROOT + "zz", ROOT + "zz", ROOT + "p", ROOT + "k"]
    cached = spark.createDataFrame([("docs_k.html", page("q"))], "filename string, html string")
    asked = spark.createDataFrame([(u, i) for i, u in enumerate(wanted)], "url string, visit_seq long")
    crawl = fetch_urls(asked, site, ROOT, cached)
    got = [r.outcome for r in crawl.orderBy("visit_seq").collect()]
    assert got == ["downloaded", "cached", "failed", "failed", "non_html", "cached"]
    counts = crawl_counters(crawl).first().asDict()
    assert counts == {"file_count": 3, "skipped_count": 2, "downloaded_count": 1, "failure_count": 2}


def test_later_success_after_a_failure_of_the_same_name(spark):
    site = answers(spark, {ROOT + "a/b": (404, "", None), ROOT + "a_b": page(), ROOT + "a b": page()})
    asked = spark.createDataFrame([(ROOT + "a/b", 0), (ROOT + "a_b", 1), (ROOT + "a/b", 2)], "url string, visit_seq long")
    got = fetch_urls(asked, site, ROOT).orderBy("visit_seq").collect()
    assert [r.outcome for r in got] == ["failed", "downloaded", "cached"]


def test_page_store_keeps_the_first_version(spark, tmp_path):
    store = str(tmp_path / "store")
    log = answers(spark, {ROOT: page("a"), ROOT + "a": page()})
    assert read_page_store(spark, store).count() == 0
    append_pages(new_files(traverse_site(log, ROOT), log), store)
    append_pages(spark.createDataFrame([("index.html", ROOT, "other"), ("n.html", ROOT + "n", "new")], "filename string, url string, html string"), store)
    kept = {r.filename: r.html for r in read_page_store(spark, store).collect()}
    assert kept == {"index.html": page("a"), "docs_a.html": page(), "n.html": "new"}
    again = traverse_site(log, ROOT, cached=read_page_store(spark, store))
    assert [r.outcome for r in again.collect()] == ["cached", "cached"]


def test_hot_file_name_is_joined_without_a_window(spark):
    site = site_table(answers(spark, {f"https://h{i}.example/": page() for i in range(50)}))
    asked = site.select("url", F.regexp_extract("url", r"h(\d+)", 1).cast("long").alias("visit_seq"))
    stored = spark.createDataFrame([], "filename string, owner string")
    done = classify(asked, site, stored, F.lit("index.html"))
    assert crawl_counters(done).first().downloaded_count == 1
    assert done.select("owner").distinct().first().owner == "https://h0.example/"
    assert "Window" not in done._jdf.queryExecution().executedPlan().toString()


def test_few_tables_after_many_levels(spark):
    runs = Runs("visited")
    for i in range(70):
        runs.add(spark.range(i, i + 1))
    assert sum(map(len, runs.tiers)) <= 9
    assert sorted(r.id for r in runs.rows().collect()) == list(range(70))


def test_a_chain_of_levels_and_names_stored_along_it(spark):
    site = {ROOT: page("1", "1?again")} | {f"{ROOT}{i}": page(str(i + 1), "1") for i in range(1, 12)}
    rows = walk(spark, site)
    assert [r[1] for r in rows] == list(range(12)) + [12] and rows[-1][2] == "failed"


def test_a_large_level_does_not_move_the_site(spark):
    from bindery.session import materialize_bucketed

    site = materialize_bucketed(spark.range(1000).select(F.col("id").cast("string").alias("url"), F.lit("x").alias("response")), "site", "url")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.range(50).select(F.col("id").cast("string").alias("url")).join(site, "url", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.filter("response = 'x'").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
