import time
from urllib.parse import urljoin

from pyspark.sql import functions as F

from bindery.functions import urls as u
from bindery.functions.html import anchor_hrefs
from bindery.functions.markdown import balanced, html_to_markdown
from bindery.operators.links import discover_links

BASES = ["http://h/a/b/c", "https://h.x/", "http://h", "http://h/a/b/?q=1#f", "http://h/a;p?x", "http://h/a//b/../c/d.html"]
HREFS = [
    "", "x", "./x", "../x", "../../x", "../../../x", "/x", "//o/p", "?q", "#f", "x?q=1#z", "..", ".", "../", "x/",
    "/a/../b", "/./b", "/a//b", "a//b", "http://h/z", "https://o/p?x#y", "HTTP://H/a/../b", "mailto:x@y", " x", "\tx",
    "x\ny", "g;x=1/../y", ";x", "g;", "a;b?c", "//", "///p", "http:g", "http:", "x:y", "1:y", "/a/.b", "/..", "日本",
    "/a b", "?", "#", "http://h;", "javascript:void(0)", "..;x", "a/..", "a/.", "//o", "//o?x", "//o#x",
]


def test_resolution_agrees_with_urljoin(spark):
    rows = [(b, h, urljoin(b, h)) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string, want string")
    wrong = df.withColumn("got", u.resolve_url("base", "href")).filter("not got <=> want").collect()
    assert wrong == []


def test_url_prefix(spark):
    cases = {
        "https://h/docs/": "https://h/docs/",
        "https://h/docs/index.html": "https://h/docs/",
        "https://h": "https://h",
        "https://h/": "https://h/",
        "https://h/a/b?q=/x#y": "https://h/a/",
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert df.filter(u.derive_url_prefix("url") != F.col("want")).count() == 0
    explicit = df.select(u.scope_prefix("https://h/z/", F.col("url")).alias("a"), u.scope_prefix("", F.col("url")).alias("b"))
    assert {r.a for r in explicit.collect()} == {"https://h/z/"}
    assert sorted(r.b for r in explicit.collect()) == sorted(cases.values())


def test_file_names(spark):
    base = "https://h/docs/"
    cases = {
        "https://h/docs/": "index.html",
        "https://h/docs": "index.html",
        "https://h/": "index.html",
        "https://h/docs/guide/start": "docs_guide_start.html",
        "https://h/docs/page.html?x=1": "docs_page.html",
        "https://h/a b/ç+ü": "a_b_ç_ü.html",
        "https://h/日本/x²": "日本_x².html",
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    got = {r.url: r.name for r in df.select("url", u.url_to_filename("url", F.lit(base)).alias("name")).collect()}
    assert got == cases


def test_anchor_extraction_reads_only_live_anchors(spark):
    cases = {
        '<a href="x">': ["x"],
        "<A HREF='y&amp;z' >": ["y&z"],
        "<a class=q href=u/v>": ["u/v"],
        '<a title=" href=no" href="yes">': ["yes"],
        '<a data-href="n">': [],
        "<a href>": [""],
        '<a href="">': [""],
        '<a\nhref = "sp">': ["sp"],
        '<abbr href="n">': [],
        '<!-- <a href="c"> --><a href="d"/>': ["d"],
        "<script>\"<a href='s'>\"</script><a href=k>": ["k"],
        '<a href="&lt;&#233;&#xe9;&eacute;&copy&nope;&#128512;">': ["<ééé©&nope;😀"],
        '<a href="a>b">': ["a>b"],
        "no markup": [],
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want array<string>")
    assert df.filter(~(anchor_hrefs("html") == F.col("want"))).count() == 0


def test_long_tags_and_many_quotes_do_not_exhaust_the_matcher(spark):
    html = "<a " + " ".join(f'd{i}="{"v" * 50}"' for i in range(3000)) + ' href="end">' + "<a " * 2000
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(anchor_hrefs("html").alias("h")).first().h == ["end"]


BROKEN = ('<a x="', "<a ", "<script ", "<!", "<a '", "<a \"'>'\"", "<title", "<a class" + " " * 50)


def test_broken_megabytes_are_read_once(spark):
    pages = [(i, unit * (1_000_000 // len(unit)) + end) for i, unit in enumerate(BROKEN) for end in ("", ">")]
    df = spark.createDataFrame(pages, "id int, html string").repartition(8).cache()
    df.count()
    began = time.monotonic()
    df.select(F.sum(F.size(anchor_hrefs("html")))).collect()
    assert time.monotonic() - began < 20
    for _, page in pages:
        began = time.monotonic()
        balanced(page)
        assert time.monotonic() - began < 3, page[:20]


def test_a_tag_is_one_anchor(spark):
    html = '<a href=x title="<a href=y>">1</a><a class=z href="w"'
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(anchor_hrefs("html").alias("h")).first().h == ["x", "w"]


def test_discovered_links_are_canonical_scoped_and_distinct(spark):
    html = (
        '<a href="/one">1</a><a href="/two?x=1">2</a><a href="https://else.example/o">3</a>'
        '<a href="/one#part">4</a><a href="mailto:m@h">5</a><a href="tel:1">6</a><a href="javascript:x">7</a>'
    )
    pages = spark.createDataFrame([("https://h/", html)], "url string, html string")
    got = discover_links(pages, "https://h/").orderBy("pos").collect()
    assert [(r.src_url, r.pos, r.url) for r in got] == [("https://h/", 0, "https://h/one"), ("https://h/", 1, "https://h/two")]


def test_main_region_priority(spark):
    cases = {
        "<article>a</article><main>m</main>": "main",
        "<div role='main'>r</div><article>a</article>": "article",
        '<div class="x" role="main">r</div>': "role",
        "<mainframe>x</mainframe>": "document",
        "<!-- <main> --><p>x": "document",
        '<div role="Main">x</div>': "document",
        '<p title="<main >">x<article>y</article>': "article",
    }
    df = spark.createDataFrame(list(cases.items()), "html string, want string")
    assert df.filter(html_to_markdown("html")["region"] != F.col("want")).count() == 0


def test_every_named_reference_is_decoded(spark):
    import html.entities

    from bindery.functions.html import unescape_entities

    rows = [(f"a&{name}",) for name in html.entities.html5] + [("&nosuchname;",), ("&",), ("&;",)]
    got = spark.createDataFrame(rows, "t string").select("t", unescape_entities(F.col("t")).alias("u")).collect()
    assert len(got) == len(rows) > 2000
    assert all(r.u == "a" + html.entities.html5[r.t[2:]] for r in got if r.t[0] == "a")
    assert {r.u for r in got if r.t[0] != "a"} == {"&nosuchname;", "&", "&;"}
