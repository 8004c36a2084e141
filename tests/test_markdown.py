import pyarrow as pa
import pytest

from bindery.functions import markdown
from bindery.functions.markdown import clean_html
from bindery.operators.convert import convert_pages

GOLDEN = {
    "article in main": (
        "<html><head><title>T</title></head><body><nav><a href='/n'>Nav</a></nav><header><h1>Site</h1></header>"
        "<main>\n <article>\n <h1>Hello  There</h1>\n<p>Some <strong>bold</strong> and <em>soft</em> words.</p>"
        "<ul>\n<li>One</li>\n<li>Two</li>\n</ul></article></main><aside class='sidebar'>Side</aside>"
        "<footer>Foot</footer><script>log('x')</script><style>p{}</style></body></html>",
        "# Hello There\n\nSome **bold** and *soft* words.\n\n* One\n* Two\n",
        "main",
    ),
    "no main": (
        "<title>Kept</title><nav>gone</nav><div><h2>Part</h2><p>Body.</p></div><footer>gone</footer>",
        "Kept\n\n## Part\n\nBody.\n",
        "document",
    ),
    "images and svg": ("<main><p>Before <img src=a.png alt=Alt> x</p><svg><text>v</text></svg><p>After</p></main>", "Before x\n\nAfter\n", "main"),
    "role": ('<div>out</div><div role="main"><h3>In</h3></div>', "### In\n", "role"),
    "header inside main": ("<main><header><h1>Lost</h1></header><p>x</p></main>", "x\n", "main"),
    "links": ('<p>see <a href="/x?a=1&amp;b=2">the *doc*</a> or <a href="http://h/">http://h/</a></p>', "see [the \\*doc\\*](/x?a=1&b=2) or <http://h/>\n", "document"),
    "nested lists": ("<ul><li>a<ol start=3><li>x<li>y</ol><li>b</ul>", "* a\n  3. x\n  4. y\n* b\n", "document"),
    "code": ("<p>Run <code>a*b_c</code></p><pre>  x\n    y &lt;z&gt;</pre>", "Run `a*b_c`\n\n```\n  x\n    y <z>\n```\n", "document"),
    "quote": ("<blockquote><p>one</p><p>two</p></blockquote><p>after</p>", "> one\n>\n> two\n\nafter\n", "document"),
    "table": ("<table><tr><th>A<th>B|C<tr><td>1<td>2</table>", "| A | B\\|C |\n| --- | --- |\n| 1 | 2 |\n", "document"),
    "breaks and rules": ("<p>a<br>b</p><hr><p>c</p>", "a  \nb\n\n---\n\nc\n", "document"),
    "unclosed": ("<article><h1>T</h1><p><b>Lead.<br><p>Next &amp &amp;lt; &am</p></article>", "# T\n\n**Lead.**\n\nNext & &lt; &am\n", "article"),
    "greedy class": ('<body class="has-sidebar"><p>x</p></body>', "\n", "document"),
    "class substring": ('<div class="stock">gone</div><div class="Top-NavBar x">gone</div><p class="lead">kept</p>', "kept\n", "document"),
    "blank lines": ("<pre>a\n\n\n\n\nb</pre>", "```\na\n\nb\n```\n", "document"),
    "empty": ("", "\n", "document"),
    "comments": ("<!-- <main>no</main> --><!doctype html><p>a < b</p>", "a < b\n", "document"),
}


@pytest.fixture(scope="module")
def converted(spark):
    pages = spark.createDataFrame([(k, v[0]) for k, v in GOLDEN.items()], "url string, html string")
    return {r.key: r for r in convert_pages(pages).collect()}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(converted, name):
    row, (_, markdown, region) = converted[name], GOLDEN[name]
    assert (row.markdown, row.region, row.status, row.error) == (markdown, region, "ok", None)
    assert (row.n_words, row.n_bytes) == (len(markdown.split()), len(markdown.encode()))


def test_missing_text_is_a_failed_row(spark):
    pages = spark.createDataFrame([("a", None), ("b", "<p>x")], "url string, html string")
    rows = {r.key: r for r in convert_pages(pages).collect()}
    assert (rows["a"].status, rows["a"].markdown, rows["a"].n_words) == ("failed", None, None)
    assert rows["b"].markdown == "x\n"


def test_custom_tags_and_class_patterns(spark):
    pages = spark.createDataFrame([("a", "<div class='my-ad'>ad</div><nav>n</nav><p>p</p><em>e</em>")], "url string, html string")
    row = convert_pages(pages, strip_tags=["em"], strip_classes=["^my-"]).first()
    assert row.markdown == "n\n\np\n"


def test_cleaned_html_loses_styling_and_boilerplate(spark):
    html = '<main class="c" id=i><p style="x" title="t">a &lt; b<br></p><div class=menu>m</div><nav>n</nav></main>'
    pages = spark.createDataFrame([(html,)], "html string")
    got = pages.select(clean_html("html").alias("c")).first().c
    assert got == '<main id=i><p title="t">a &lt; b<br></p></main>'


def test_deep_nesting_does_not_recurse(spark):
    html = "<div>" * 20000 + "deep" + "</div>" * 20000
    pages = spark.createDataFrame([("a", html)], "url string, html string")
    row = convert_pages(pages).first()
    assert (row.status, row.markdown) == ("ok", "deep\n")


def test_pages_of_a_batch_are_converted_some_at_a_time():
    pages = [None, "", "<p>é", "x" * 3 * markdown._SLICE, *["<p>" + "y" * 10_000] * 500, None]
    seen = []
    got = markdown._by_slices(pa.array(pages), lambda some: seen.append(some) or pa.array([p and p[:3] for p in some], pa.string()))
    assert got.to_pylist() == [p and p[:3] for p in pages] and [p for some in seen for p in some] == pages
    assert all(sum(len(p or "") for p in some) <= markdown._SLICE for some in seen if len(some) > 1) and len(seen) > 5
    assert len(markdown._by_slices(pa.array([], pa.string()), lambda some: pa.array(some, pa.string()))) == 0
