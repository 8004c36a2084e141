"""Registered queries: every operator over the whole of the driver's tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as t
from bindery.functions import urls as u
from bindery.functions.markdown import clean_html
from bindery.operators.combine import (
    SEPARATOR,
    assign_chunks,
    build_sections,
    bundle_pieces,
    combine,
    corpus_words,
    gather_chunks,
)
from bindery.operators.convert import convert_files, convert_pages
from bindery.operators.fetch import crawl_counters, fetch_urls
from bindery.operators.links import discover_links
from bindery.operators.order import ranked, with_ordinal
from bindery.operators.report import (
    COMBINE_STEP,
    CRAWL_STEP,
    failure_keys,
    line_failures,
    parse_report,
    pipeline_report,
    pipeline_summary,
    report_json,
    select_retry,
    step_result,
    step_summary,
)
from bindery.operators.report_document import read_report_document, write_report_document
from bindery.operators.traverse import traverse_site
from bindery.plans.pipeline import markdown_chunks, run_pipeline
from bindery.plans.steps import combine_step, convert_step, crawl_step
from bindery.session import materialize, scratch_root
from bindery.sources.files import read_html_dir, read_html_files, read_markdown_dir, read_zip
from bindery.sources.sinks import append_pages, export_files, read_page_store
from bindery.streaming.fetched import FETCHED, store_fetched_pages
from bindery.streaming.incremental import convert_new_files, read_converted

START = "https://blog.tionsh.example.net/es/533/"
BUDGET = 5_000
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- inputs derived from the tables -------------------------------------------------


def fetch_log(pages: DataFrame) -> DataFrame:
    """Pages as fetch answers: feed links are dead, folder-like URLs answer with a PDF."""
    return pages.select(
        "page_id",
        "url",
        F.when(F.contains("url", F.lit("utm_source=feed")), F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(F.endswith("url", F.lit("/")), F.lit("application/pdf"))
        .otherwise(F.lit("text/html; charset=utf-8"))
        .alias("content_type"),
        F.col("html").alias("body"),
    )


def page_cache(pages: DataFrame) -> DataFrame:
    """Stored pages: those once fetched through a ``#top`` link."""
    stored = pages.filter(F.endswith("url", F.lit("#top")))
    named = stored.select(u.url_to_filename("url", F.lit(START)).alias("filename"), "page_id", "html")
    return named.groupBy("filename").agg(F.min_by("html", "page_id").alias("html"))


def document_site(documents: DataFrame) -> DataFrame:
    """Document *i* as a page linking to *2i+1*, *2i+2* and *i-1* where those exist."""
    n = documents.count()
    i = F.col("doc_id")
    targets = F.filter(F.array(i * 2 + 1, i * 2 + 2, i - 1), lambda x: (x >= 0) & (x < n))
    anchors = F.transform(targets, lambda x: F.format_string('<a href="/d/%d">next</a>', x))
    return documents.select(
        F.format_string("https://docs.example/d/%d", i).alias("url"),
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.concat(F.lit("<main>"), F.array_join(anchors, " "), F.lit("</main>")).alias("body"),
    )


def document_path() -> Column:
    return F.format_string("%s/doc_%08d.md", "lang", "doc_id")


def mixed_path() -> Column:
    """Paths whose part-wise order differs from plain string order."""
    joint = F.element_at(F.array(F.lit("/"), F.lit("-"), F.lit(".")), (F.col("n_chars") % 3 + 1).cast("int"))
    return F.concat(F.col("lang"), joint, F.format_string("%d.html", "doc_id"))


def document_sections(documents: DataFrame, corpus: Column) -> DataFrame:
    return build_sections(documents, corpus, document_path(), F.col("text"))


def page_files(spark: SparkSession, pages: DataFrame) -> str:
    """Every page written to its own HTML file below a fresh shared folder."""
    root = f"{scratch_root(spark)}/html-{uuid.uuid4().hex}"
    name = F.format_string("p/%d%s", "page_id", F.when(F.startswith("url", F.lit("https")), ".html").otherwise(".htm"))
    export_files(pages.select(name.alias("name"), "html"), "name", "html", root)
    return root


def page_archives(spark: SparkSession, pages: DataFrame, root: str | None = None) -> str:
    """Pages in ZIP archives of a hundred, each page with two entries to be refused; one file is no archive.

    Pages with feed links end in a byte that is not UTF-8.
    """
    root = root or f"{scratch_root(spark)}/zip-{uuid.uuid4().hex}"
    html = F.encode("html", "UTF-8")
    damaged = F.when(F.contains("url", F.lit("utm_source=feed")), F.concat(html, F.unhex(F.lit("FF")))).otherwise(html)
    names = (("p/%d.html", damaged), ("__MACOSX/%d.html", html), ("p/%d.txt", html))
    parts = F.array(*[F.struct(F.format_string(n, "page_id").alias("entry"), c.alias("content")) for n, c in names])
    entries = pages.select(F.floor(F.col("page_id") / 100).alias("archive"), F.inline(parts))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for entry, content in zip(group["entry"], group["content"], strict=True):
                z.writestr(entry, bytes(content))
        return pd.DataFrame({"name": [f"{group['archive'].iloc[0]}.zip"], "content": [out.getvalue()]})

    archives = entries.groupBy("archive").applyInPandas(pack, "name string, content binary")
    broken = pages.agg(F.lit("broken.zip").alias("name"), F.encode(F.max("url"), "UTF-8").alias("content"))
    export_files(archives.unionByName(broken), "name", "content", root)
    return root


# ---- URLs and links -----------------------------------------------------------------


@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = u.url_parts("url")
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in zip(parts._fields, parts)])


@query
def url_prefix(spark: SparkSession, sf: str) -> DataFrame:
    explicit = F.when(F.startswith("url", F.lit("http:")), F.lit("http://"))
    return table(spark, sf, "pages").select(
        "page_id",
        u.derive_url_prefix("url").alias("prefix"),
        u.scope_prefix(explicit, F.col("url")).alias("scope"),
    )


@query
def page_filename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", u.url_to_filename("url", F.lit(START)).alias("filename"))


@query
def filename_collisions(spark: SparkSession, sf: str) -> DataFrame:
    named = page_filename(spark, sf)
    claims = named.groupBy("filename").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_claims"))
    return named.join(claims, "filename").select(
        "page_id", "filename", "n_claims", (F.col("page_id") == F.col("first_id")).cast("int").alias("is_first")
    )


@query
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return discover_links(table(spark, sf, "pages"), "http", keep=["page_id"])


@query
def links_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    scope = F.concat(u.origin("url"), F.lit("/e"))
    return discover_links(table(spark, sf, "pages"), scope, keep=["page_id"])


@query
def links_by_scheme(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors with and without a followable scheme, appended to every page."""
    extra = F.concat(
        F.lit('<a href="mailto:x@y.example">m</a><a href="tel:1">t</a><a href="javascript:go()">j</a>'),
        F.lit('<a name="here">n</a><a href="//cdn.example/lib">c</a><a href="MAILTO:z">u</a>'),
    )
    pages = table(spark, sf, "pages").withColumn("html", F.concat("html", extra))
    found = discover_links(pages, "", keep=["page_id"])
    return found.groupBy("page_id").agg(
        F.count("*").alias("n_links"),
        F.count_if(F.col("url").rlike("^(mailto|tel|javascript):")).alias("n_skippable"),
        F.count_if(F.startswith("url", F.lit("MAILTO:"))).alias("n_upper"),
    )


@query
def link_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of relative reference, resolved against every page URL."""
    hrefs = ["../up", "./here", "deep/er", "?q=1", "#frag", "", "//o.example/p", "/r/../s", "../../../x/./y/.."]
    pairs = table(spark, sf, "pages").select(
        "page_id", "url", F.posexplode(F.array(*map(F.lit, hrefs))).alias("pos", "href")
    )
    return pairs.select("page_id", "pos", u.canonical_url(u.resolve_url("url", "href")).alias("link"))


@query
def frontier_unfetched(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    wanted = discover_links(pages, "http", keep=["page_id"]).groupBy("url").agg(F.count("*").alias("n_sources"))
    return wanted.join(pages.select("url"), "url", "left_anti")


# ---- fetching and traversal -----------------------------------------------------------


@query
def fetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    wanted = pages.select("url", F.col("page_id").alias("visit_seq"))
    return fetch_urls(wanted, fetch_log(pages), START, page_cache(pages)).select(
        "visit_seq", "url", "filename", "outcome"
    )


@query
def crawl_counts(spark: SparkSession, sf: str) -> DataFrame:
    return crawl_counters(fetch_outcomes(spark, sf))


@query
def fetch_url_list(spark: SparkSession, sf: str) -> DataFrame:
    """All page URLs twice over, and all link targets, which nobody answers."""
    pages = table(spark, sf, "pages")
    once = pages.select("url", (F.col("page_id") * 1000).alias("visit_seq"))
    again = pages.select("url", (F.col("page_id") * 1000 + 999).alias("visit_seq"))
    links = discover_links(pages, "http", keep=["page_id"]).select(
        "url", (F.col("page_id") * 1000 + F.col("pos") + 1).alias("visit_seq")
    )
    wanted = once.unionByName(again).unionByName(links)
    return fetch_urls(wanted, fetch_log(pages), START).select("visit_seq", "url", "filename", "outcome")


@query
def site_reach(spark: SparkSession, sf: str) -> DataFrame:
    site = document_site(table(spark, sf, "documents"))
    return traverse_site(site, "https://docs.example/d/0", max_pages=1 << 40).select(
        "url", "visit_seq", "depth", "filename", "outcome"
    )


@query
def site_reach_limited(spark: SparkSession, sf: str) -> DataFrame:
    site = document_site(table(spark, sf, "documents"))
    return traverse_site(site, "https://docs.example/d/0", max_pages=50).select("url", "visit_seq", "depth")


def linked_site(pages: DataFrame) -> DataFrame:
    """A site that answers every link of ``pages`` with one of them, whole; which one, the link's letters say."""
    root = "https://site.example"
    found = discover_links(pages.withColumn("url", F.lit(f"{root}/")), f"{root}/", keep=["page_id"])
    urls = found.select("url").distinct()
    word = F.substring("url", F.lit(len(root) + 2), F.length("url"))
    letters = F.ascii(word) * 131 + F.ascii(F.reverse(word)) * 17 + F.length(word) * 7
    chosen = urls.withColumn("page_id", (letters % pages.count()).cast("long"))
    answered = chosen.join(pages.select("page_id", "html"), "page_id")
    return answered.select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))


@query
def page_site_reach(spark: SparkSession, sf: str) -> DataFrame:
    """Everything within reach over the pages' own links and bodies."""
    reached = traverse_site(linked_site(table(spark, sf, "pages")), "https://site.example/the", max_pages=1 << 40)
    return reached.select("url", "depth", "outcome")


# ---- conversion -----------------------------------------------------------------------


@query
def page_region(spark: SparkSession, sf: str) -> DataFrame:
    """Region that conversion takes; by page number the main element is article, main, a role or none."""
    element = F.element_at(F.array(*map(F.lit, ("article", "main", 'div role="main"', "section"))), (F.col("page_id") % 4 + 1).cast("int"))
    html = F.regexp_replace("html", F.lit("<article>"), F.concat(F.lit("<"), element, F.lit(">")))
    pages = convert_pages(table(spark, sf, "pages"), "page_id", html)
    return pages.select(F.col("key").alias("page_id"), "region")


@query
def strip_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", clean_html("html").alias("cleaned"))


@query
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    done = convert_pages(table(spark, sf, "pages"), "page_id")
    return done.select(F.col("key").alias("page_id"), "markdown", "n_words", "n_bytes")


@query
def convert_status(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files; feed pages carry a byte that is not UTF-8 and must fail alone."""
    broken = F.when(F.contains("url", F.lit("utm_source=feed")), F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    files = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("key"),
        F.format_string("p/%d.html", "page_id").alias("rel_path"),
        F.concat(F.encode("html", "UTF-8"), broken).alias("content"),
        F.lit(True).alias("is_text_file"),
    )
    return convert_files(files).select("key", "md_path", "status", F.col("error").isNotNull().cast("int").alias("bad"))


@query
def utf8_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as bytes: some cut inside a character, some with a byte order mark."""
    content = F.encode("text", "UTF-8")
    cut = F.when(F.col("lang") == "fr", F.concat(content, F.unhex(F.lit("C3"))))
    marked = F.when(F.col("lang") == "de", F.concat(F.unhex(F.lit("EFBBBF")), content))
    text = t.decode_utf8(F.coalesce(cut, marked, content))
    return table(spark, sf, "documents").select(
        "doc_id", text.isNotNull().cast("int").alias("valid"), F.char_length(text).alias("n_chars_read")
    )


@query
def html_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    root = page_files(spark, table(spark, sf, "pages"))
    return read_html_dir(spark, root).select(
        "rel_path", t.markdown_path("rel_path").alias("md_path"), F.octet_length("content").alias("n_bytes")
    )


@query
def path_list(spark: SparkSession, sf: str) -> DataFrame:
    """Every page asked for under the suffix of only some: found files are converted, the others missing."""
    pages = table(spark, sf, "pages")
    root = page_files(spark, pages)
    name = F.format_string("p/%d.html", "page_id")
    wanted = pages.select(F.concat(F.lit(f"{root}/"), name).alias("key"), name.alias("rel_path"))
    found, missing = read_html_files(read_html_dir(spark, root), wanted)
    done = convert_files(found).select(_below_root("key").alias("rel_path"), "status", "markdown")
    return done.unionByName(missing.select("rel_path", F.lit("missing").alias("status")), allowMissingColumns=True)


@query
def zip_convert(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of archives by name: refused ones are absent, damaged ones and a broken archive failed."""
    root = page_archives(spark, table(spark, sf, "pages"))
    entry = F.regexp_extract("key", r"([^/]+\.zip.*)$", 1)
    return convert_files(read_zip(spark, root)).select(entry.alias("entry"), "status", "markdown")


@query
def strip_inside_region(spark: SparkSession, sf: str) -> DataFrame:
    """Tags, drawings, classes and images inside the main region leave no trace."""
    extra = (
        '<aside>side</aside><header><h2>top</h2></header><svg><text>drawn</text></svg>'
        '<div class="Stock x"><p>list</p></div><img src="a.png" alt="seen">'
    )
    html = F.replace("html", F.lit("</article>"), F.lit(f"{extra}</article>"))
    done = convert_pages(table(spark, sf, "pages"), "page_id", html)
    return done.select(F.col("key").alias("page_id"), "markdown", "n_words", "n_bytes")


@query
def page_store(spark: SparkSession, sf: str) -> DataFrame:
    """Page store after two runs: https pages first, then all."""
    path = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    pages = table(spark, sf, "pages").select(u.url_to_filename("url", F.lit(START)).alias("filename"), "url", "html")
    append_pages(pages.filter(F.startswith("url", F.lit("https:"))), path)
    append_pages(pages, path)
    return read_page_store(spark, path)


@query
def page_store_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Page store after two runs of a stream on a fetch log: answers of even pages arrive first, then the others."""
    root = f"{scratch_root(spark)}/fetched-{uuid.uuid4().hex}"
    log = fetch_log(table(spark, sf, "pages")).withColumnRenamed("page_id", "seq")
    log = log.select(*[c.split()[0] for c in FETCHED.split(", ")])
    for rest in (0, 1):
        log.filter(F.col("seq") % 2 == rest).write.mode("append").parquet(root)
        store_fetched_pages(spark, root, f"{root}.pages", f"{root}.state", START)
    return read_page_store(spark, f"{root}.pages")


@query
def incremental_convert(spark: SparkSession, sf: str) -> DataFrame:
    """Files written by two jobs, picked up by two runs of a stream; late files take over shared names."""
    pages = table(spark, sf, "pages")
    root = f"{scratch_root(spark)}/html-{uuid.uuid4().hex}"
    for suffix, arrived in ((".html", pages), (".htm", pages.filter(F.startswith("url", F.lit("https"))))):
        name = F.format_string(f"p/%d{suffix}", "page_id")
        export_files(arrived.select(name.alias("name"), "html"), "name", "html", root)
        convert_new_files(spark, root, f"{root}.md", f"{root}.state")
    return read_converted(spark, f"{root}.md").select(_below_root("key").alias("rel_path"), "md_path", "status", "markdown")


def _below_root(key: str) -> Column:
    return F.regexp_extract(key, "(p/[^/]+)$", 1)


# ---- text and sections ----------------------------------------------------------------


@query
def normalize_whitespace(spark: SparkSession, sf: str) -> DataFrame:
    spread = F.regexp_replace("text", "\n", "\n\n\n")
    padded = F.concat(F.lit("　\n"), spread, F.lit(" \x85\x1c "))
    return table(spark, sf, "documents").select("doc_id", t.normalize_whitespace(padded).alias("clean"))


@query
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.word_count("text").alias("n_words"))


@query
def source_sections(spark: SparkSession, sf: str) -> DataFrame:
    return document_sections(table(spark, sf, "documents"), F.lit("docs")).select("rel_path", "section", "n_words")


@query
def combine_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of each conversation in order; a conversation over the limit becomes several bundles."""
    turns = table(spark, sf, "conversations")
    name = F.format_string("turn_%08d.md", "turn")
    sections = build_sections(turns, F.col("conv_id").cast("string"), name, F.col("text"), add_source_header=False)
    return combine(sections, max_words=BUDGET // 10, stem="talk")


@query
def path_order(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "documents").select("doc_id", mixed_path().alias("path"))
    return with_ordinal(ranked(paths, [t.path_order("path")], "paths"), "nth")


@query
def zip_name_order(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select("doc_id", mixed_path().alias("name"))
    return with_ordinal(ranked(names, [F.col("name")], "names"), "nth")


# ---- chunking -------------------------------------------------------------------------


@query
def chunk_assign(spark: SparkSession, sf: str) -> DataFrame:
    sections = document_sections(table(spark, sf, "documents"), F.lit("docs"))
    return assign_chunks(sections, max_words=BUDGET).select("rel_path", "n_words", "chunk_no")


@query
def chunk_assign_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Same result through many tiny blocks and several levels of summaries."""
    sections = document_sections(table(spark, sf, "documents"), F.lit("docs"))
    done = assign_chunks(sections, max_words=BUDGET, block_rows_log2=4, fan_in=4)
    return done.select("rel_path", "n_words", "chunk_no")


@query
def chunk_assign_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    sections = document_sections(table(spark, sf, "documents"), F.col("lang"))
    return assign_chunks(sections, max_words=BUDGET).select("corpus", "rel_path", "chunk_no")


@query
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    sections = document_sections(table(spark, sf, "documents"), F.col("lang"))
    chunks = assign_chunks(sections, max_words=BUDGET).groupBy("corpus", "chunk_no")
    return chunks.agg(
        F.count("*").alias("n_sections"),
        (F.sum("n_words") + F.count("*") - 1).alias("n_words"),
        F.min("rel_path").alias("first_path"),
    )


@query
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    sections = document_sections(table(spark, sf, "documents"), F.lit("docs"))
    return gather_chunks(sections, assign_chunks(sections, max_words=BUDGET)).select("chunk_no", "text", "n_sections")


@query
def bundle_files(spark: SparkSession, sf: str) -> DataFrame:
    """Many corpora, small and large, and corpora without any section."""
    documents = table(spark, sf, "documents")
    name = F.concat_ws("-", "lang", "source")
    corpora = documents.select(name.alias("corpus")).union(documents.select("source")).distinct()
    return combine(document_sections(documents, name), max_words=BUDGET, stem="bundle", corpora=corpora)


@query
def bundle_export(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles written to files under their own names and read back; Spark lists no empty file, so those show by size."""
    root = f"{scratch_root(spark)}/export-{uuid.uuid4().hex}"
    named = bundle_files(spark, sf).select(F.concat_ws("/", "corpus", "file_name").alias("name"), "text")
    written = export_files(named, "name", "text", root)
    back = written.join(read_markdown_dir(spark, root), "rel_path", "full")
    return back.select("rel_path", F.when(F.col("n_bytes") == 0, F.lit("")).otherwise(F.col("body")).alias("body"))


@query
def empty_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of zero bytes among others: a page becomes an empty line, a Markdown file a section of its header."""
    pages, documents = table(spark, sf, "pages"), table(spark, sf, "documents")
    emptied = F.when(F.startswith("url", F.lit("https")), F.col("html")).otherwise(F.lit(""))
    read = read_html_dir(spark, page_files(spark, pages.withColumn("html", emptied)))
    done = convert_files(read).select(_below_root("key").alias("name"), "status", F.col("markdown").alias("text"))
    root = f"{scratch_root(spark)}/md-{uuid.uuid4().hex}"
    body = F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("text"))
    export_files(documents.select(document_path().alias("name"), body.alias("body")), "name", "body", root)
    files = read_markdown_dir(spark, root)
    sections = build_sections(files, F.lit("docs"), F.col("rel_path"), F.col("body"))
    return done.unionByName(sections.select(F.col("rel_path").alias("name"), F.lit("section").alias("status"), F.col("section").alias("text")))


@query
def bundle_pieces_export(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles written piece by piece, most of them larger than a piece, and read back; every fiftieth text has no blank.

    A first export with more chunks leaves no file behind.
    """
    documents = table(spark, sf, "documents")
    name = F.concat_ws("-", "lang", "source")
    solid = F.when(F.col("doc_id") % 50 == 0, F.regexp_replace("text", r"\s+", "")).otherwise(F.col("text"))
    sections = build_sections(documents, name, document_path(), solid)
    corpora = documents.select(name.alias("corpus")).union(documents.select("source")).distinct()
    root = f"{scratch_root(spark)}/export-{uuid.uuid4().hex}"
    for words in (BUDGET // 5, BUDGET):
        step = combine_step(sections, root, max_words=words, stem="bundle", corpora=corpora, piece_chars=5_000)
    back = read_markdown_dir(spark, root).select("rel_path", "body")
    return back.join(step.result.select("rel_path", "n_words", "n_sections", "n_bytes"), "rel_path", "full")


@query
def newline_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the line ends of other systems read like their own."""
    crlf, cr = (F.replace("text", F.lit("\n"), F.lit(end)) for end in ("\r\n", "\r"))
    return table(spark, sf, "documents").select(
        "doc_id", t.universal_newlines(crlf).alias("crlf"), t.universal_newlines(cr).alias("cr")
    )


@query
def joined_word_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each joined corpus for separators that touch, or do not touch, their neighbours."""
    documents = table(spark, sf, "documents")
    plain = build_sections(documents, F.col("lang"), document_path(), F.col("text"), add_source_header=False)
    parts = [
        corpus_words(plain, F.col("rel_path"), sep).select(F.lit(name).alias("separator"), "corpus", "total_words")
        for name, sep in (("default", SEPARATOR), ("tight", "X"), ("right", "X "), ("none", ""))
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def page_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: pages to Markdown to word-budgeted bundles."""
    return markdown_chunks(table(spark, sf, "pages"), BUDGET)


# ---- reports --------------------------------------------------------------------------


@query
def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        "doc_id",
        t.format_bytes(n).alias("small"),
        t.format_bytes(n * n).alias("middle"),
        t.format_bytes(n * n * n).alias("large"),
    )


def _steps(spark: SparkSession, sf: str) -> tuple[list[DataFrame], DataFrame]:
    """Two step results, and the outcomes that the first one counts."""
    outcomes = materialize(fetch_outcomes(spark, sf), "outcomes")
    crawl = step_result(
        table(spark, sf, "pages"),
        CRAWL_STEP,
        "out\\html",
        n_bytes=F.octet_length("html"),
        elapsed_seconds=45.25,
        counters=crawl_counters(outcomes),
    )
    # names, words and bytes of the bundles, without their texts
    sections = document_sections(table(spark, sf, "documents"), F.col("lang"))
    files = bundle_pieces(sections, max_words=BUDGET).files
    joined = step_result(files, COMBINE_STEP, "out/c.md", word_counts=("rel_path", "n_words"))
    return [crawl, joined], outcomes


def _failed(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("outcome = 'failed'").select(F.col("url").alias("key"))


@query
def step_summaries(spark: SparkSession, sf: str) -> DataFrame:
    (first, second), _ = _steps(spark, sf)
    return first.union(second).select("step_name", step_summary().alias("summary"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    steps, outcomes = _steps(spark, sf)
    return pipeline_report(steps, 47.75, crawl_failures=_failed(outcomes), command="pipeline")


@query
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Report to JSON text and back, one row per step and output file."""
    text = _report(spark, sf).select(report_json().alias("json"))
    back = text.select(parse_report(F.col("json")).alias("report"))
    steps = back.select(
        F.col("report.total_elapsed_seconds").alias("total_seconds"),
        F.size("report.crawl_failures").alias("n_failures"),
        pipeline_summary(F.col("report")).alias("summary"),
        F.posexplode("report.steps").alias("nth", "step"),
    )
    return steps.select(
        "total_seconds",
        "n_failures",
        F.substring_index("summary", "\n", -1).alias("last_line"),
        "nth",
        "step.step_name",
        "step.file_count",
        "step.skipped_count",
        F.explode_outer("step.output_word_counts").alias("file_name", "n_words"),
    )


@query
def retry_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of a report against a later fetch that only answers https URLs."""
    pages = table(spark, sf, "pages")
    wanted = failure_keys(_report(spark, sf), "crawl")
    answered = fetch_log(pages).filter(F.startswith("url", F.lit("https:"))).select("url")
    again, missing = select_retry(answered, wanted, "url")
    return again.select("key", "ordinal", F.lit("again").alias("action")).union(
        missing.select("key", "ordinal", F.lit("missing").alias("action"))
    )


def _written_report(spark: SparkSession, sf: str, convert_failures: DataFrame | None = None) -> str:
    """A report file of two steps with every word count and failure."""
    (crawl, joined), outcomes = _steps(spark, sf)
    failed = {"crawl": _failed(outcomes)}
    if convert_failures is not None:
        failed["convert"] = convert_failures
    words = joined.select(F.explode("output_word_counts").alias("key", "n_words"))
    path = f"{scratch_root(spark)}/report-{uuid.uuid4().hex}/report.json"
    write_report_document(path, [crawl, joined], {COMBINE_STEP: words}, failed, 47.75, "pipeline")
    return path


@query
def report_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every step, word count and failure of a report file that no row or task holds whole."""
    report, lines = read_report_document(spark, _written_report(spark, sf))
    return lines.select(
        "kind",
        "step_name",
        "key",
        "n_words",
        F.get_json_object("step", "$.file_count").cast("long").alias("file_count"),
        F.lit(report["command"]).alias("command"),
        F.lit(report["total_elapsed_seconds"]).cast("double").alias("total_seconds"),
    )


@query
def retry_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of both kinds from a report file: URLs against a later fetch, archive entries against mended archives."""
    pages = table(spark, sf, "pages")
    root = page_archives(spark, pages)
    first = convert_step(spark, zip_paths=root)
    _, lines = read_report_document(spark, _written_report(spark, sf, first.failures))
    answered = fetch_log(pages).filter(F.startswith("url", F.lit("https:"))).select("url")
    again, missing = select_retry(answered, line_failures(lines, "crawl"), "url")
    crawled = again.select("key", F.lit("again").alias("action")).union(missing.select("key", F.lit("missing").alias("action")))
    # pages are whole now, but for a page that is in no archive any more
    mended = pages.withColumn("url", F.regexp_replace("url", "utm_source=feed", "x")).filter("page_id % 9 <> 0")
    page_archives(spark, mended, root)
    second = convert_step(spark, zip_paths=root, retry=line_failures(lines, "convert"))
    entry = F.regexp_extract("key", r"([^/]+\.zip.*)$", 1).alias("key")
    done = second.result.select(entry, F.concat(F.lit("convert "), F.col("status")).alias("action"))
    gone = second.failures.filter("error = 'not found'").select(entry, F.lit("convert missing").alias("action"))
    return crawled.unionByName(done).unionByName(gone)


@query
def step_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three steps run one by one, and the command, as their report file gives them back."""
    pages = table(spark, sf, "pages")
    asked = pages.select(F.col("url").alias("key"), F.col("page_id").alias("ordinal"))
    cache = page_cache(pages)
    steps = [crawl_step(fetch_log(pages), START, "out\\html", retry=asked, cached=cache)]
    markdown = f"{scratch_root(spark)}/markdown-{uuid.uuid4().hex}"
    steps.append(convert_step(spark, zip_paths=page_archives(spark, pages), output="out/md", table=markdown))
    texts = spark.read.parquet(markdown)
    sections = build_sections(texts, F.lit("pages"), F.col("md_path"), F.col("markdown"))
    steps.append(combine_step(sections, f"{scratch_root(spark)}/joined-{uuid.uuid4().hex}", max_words=BUDGET))
    path = f"{scratch_root(spark)}/report-{uuid.uuid4().hex}/report.json"
    words = steps[2].result.select(F.col("rel_path").alias("key"), "n_words")
    failed = {"crawl": steps[0].failures, "convert": steps[1].failures}
    write_report_document(path, [s.row for s in steps], {COMBINE_STEP: words}, failed, command="pipeline out")
    report, lines = read_report_document(spark, path)
    number = lambda f: F.get_json_object("step", f"$.{f}").cast("long").alias(f)
    counts = ("file_count", "total_bytes", "skipped_count", "downloaded_count", "failure_count")
    rows = lines.filter("kind = '1 step'").select(
        "step_name", *map(number, counts), F.get_json_object("step", "$.output_path").alias("output_path")
    )
    listed = lines.filter("kind <> '1 step'").groupBy("kind").agg(F.count("*").alias("file_count"))
    listed = listed.select(F.col("kind").alias("step_name"), "file_count")
    return rows.unionByName(listed, allowMissingColumns=True).withColumn("command", F.lit(report["command"]))


@query
def site_run(spark: SparkSession, sf: str) -> DataFrame:
    """Traverse, convert and combine the document site in one run."""
    site = materialize(document_site(table(spark, sf, "documents")), "site")
    run = run_pipeline(site, "https://docs.example/d/0", max_pages=site.count() + 1, max_words=100)
    return run.bundles.select("file_name", "n_words", "n_sections")


@query
def word_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Words and bytes of the sections of each language."""
    sections = document_sections(table(spark, sf, "documents"), F.col("lang"))
    return sections.groupBy("corpus").agg(
        F.sum("n_words").alias("n_words"), F.sum(F.octet_length("section")).alias("n_bytes")
    )
