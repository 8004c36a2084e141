"""Listing, pieces, report documents and steps."""

import json
import os
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bindery.operators.combine import build_sections, bundle_pieces, combine
from bindery.operators.order import prefix_sums, ranked
from bindery.operators.report import line_failures, report_json, select_retry, step_row
from bindery.operators.report_document import read_report_document, write_report_document
from bindery.plans import steps
from bindery.plans.pipeline import run_pipeline
from bindery.plans.steps import combine_step, convert_step, crawl_step
from bindery.sources import storage
from bindery.sources.files import read_html_dir, read_markdown_dir, read_report
from bindery.sources.sinks import export_bundles
from bindery.sources.storage import list_files, write_pieces
from tests.test_crawl import ROOT, answers
from tests.test_files import put
from tests.test_pipeline import SITE


# ---- listing --------------------------------------------------------------------------------


def test_every_file_is_listed_whatever_its_size_or_name(spark, tmp_path):
    names = {"a.html": "x", "empty.html": "", "d/e/f/deep.htm": "", ".hidden.html": "h", "_under/x.html": "u", "n.txt": "", "d/A.HTML": ""}
    root = put(tmp_path / "in put", names)
    (tmp_path / "in put" / "none").mkdir()
    want = {n: len(c) for n, c in names.items() if n.endswith((".html", ".htm"))}
    assert {r.rel_path: r.n_bytes for r in list_files(spark, root, (".html", ".htm")).collect()} == want
    got = {r.rel_path: bytes(r.content).decode() for r in read_html_dir(spark, root).collect()}
    assert got == {n: names[n] for n in want}
    assert len({r.key.split(":")[0] for r in read_html_dir(spark, root).collect()}) == 1


def test_empty_page_and_empty_markdown(spark, tmp_path):
    done = convert_step(spark, put(tmp_path / "h", {"a.html": "", "b.html": "<p>b"})).result
    assert {r.md_path: r.markdown for r in done.collect()} == {"a.md": "\n", "b.md": "b\n"}
    files = read_markdown_dir(spark, put(tmp_path / "m", {"a.md": "", "x/b.md": "b\r\n"}))
    sections = build_sections(files, F.lit("c"), F.col("rel_path"), F.col("body"))
    assert sorted(r.section for r in sections.collect()) == ["Source: a.md\n\n", "Source: x/b.md\n\nb"]


# ---- pieces -----------------------------------------------------------------------------------


def test_prefix_sums_over_many_ranges(spark):
    rows = ranked(spark.range(1000).withColumn("v", F.col("id") % 7), [F.desc("id")], "r")
    got = {r.id: r.s for r in prefix_sums(rows, "v", "s").collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1, 1000)) for i in range(1000)}


@pytest.mark.parametrize("separator", ["\n\n---\n\n", "", "X", "é "])
@pytest.mark.parametrize("max_words", [12, 10_000])
def test_pieces_are_the_bundles(spark, tmp_path, separator, max_words):
    rnd = random.Random(len(separator) * max_words)
    texts = [" ".join(rnd.choice(["a", "éé", "𝄞x"]) for _ in range(rnd.randint(0, 9))) for _ in range(40)] + ["ü" * 999]
    rows = [(f"c{rnd.randrange(3)}", f"d/{i:03d}.md", x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "corpus string, rel_path string, body string")
    sections = build_sections(docs, F.col("corpus"), F.col("rel_path"), F.col("body"), add_source_header=False)
    corpora = spark.createDataFrame([("none",), ("c1",)], "corpus string")
    how = {"separator": separator, "max_words": max_words, "corpora": corpora, "stem": "s"}
    want = {f"{r.corpus}/{r.file_name}": r for r in combine(sections, **how).collect()}
    bundles = bundle_pieces(sections, piece_chars=7, **how)
    assert bundles.pieces.select(F.max(F.char_length("text"))).first()[0] <= 7
    export_bundles(bundles, str(tmp_path / "out"))
    got = {r.rel_path: r for r in bundles.files.collect()}
    assert got.keys() == want.keys()
    for name, r in got.items():
        data = (tmp_path / "out" / name).read_bytes()
        assert data.decode() == want[name].text and r.n_bytes == len(data)
        assert (r.n_words, r.n_sections, r.chunk_no) == (want[name].n_words, want[name].n_sections, want[name].chunk_no)
    left = {f for _, _, fs in os.walk(tmp_path / "out") for f in fs if f.endswith(".md") or ".md." in f}
    assert left == {n.split("/")[1] for n in want}


def test_streams_and_offsets_write_the_same(spark, tmp_path, monkeypatch):
    rows = [("a/x.md", 0, "één"), ("a/x.md", 5, " two"), ("b.md", 0, "b")]
    pieces = spark.createDataFrame(rows, "rel_path string, offset long, text string").repartition(3)
    files = spark.createDataFrame([("a/x.md", 9), ("b.md", 1), ("c/none.md", 0)], "rel_path string, n_bytes long")
    write_pieces(files, pieces, str(tmp_path / "one"))
    storage._as_streams(files, pieces, str(tmp_path / "two"), "t")
    for name, text in (("a/x.md", "één two"), ("b.md", "b"), ("c/none.md", "")):
        assert (tmp_path / "one" / name).read_text() == (tmp_path / "two" / name).read_text() == text


def test_a_file_that_lacks_a_piece_never_appears(spark, tmp_path):
    pieces = spark.createDataFrame([("x.md", 4, "late")], "rel_path string, offset long, text string")
    files = spark.createDataFrame([("x.md", 8)], "rel_path string, n_bytes long")
    for write in (write_pieces, lambda f, p, r: storage._as_streams(f, p, r, "t")):
        with pytest.raises(Exception, match="4 of 8 bytes"):
            write(files, pieces, str(tmp_path))
    assert not (tmp_path / "x.md").exists()


def test_export_with_fewer_chunks_leaves_no_stale_file(spark, tmp_path):
    rows = [(c, f"{i}.md", "one two three") for c in "ab" for i in range(6)]
    docs = spark.createDataFrame(rows, "corpus string, rel_path string, body string")
    sections = build_sections(docs, F.col("corpus"), F.col("rel_path"), F.col("body"), add_source_header=False)
    put(tmp_path, {"a/combined-009.md": "mine", "a/notes.md": "mine"})
    names = lambda c: {p.name for p in (tmp_path / c).iterdir()}
    combine_step(sections, str(tmp_path), max_words=4)
    assert names("b") == {f"combined-{i:03d}.md" for i in range(1, 7)}
    combine_step(sections.filter("corpus = 'a'"), str(tmp_path), max_words=11)
    assert names("a") == {"combined-001.md", "combined-002.md", "combined-009.md", "notes.md"} and len(names("b")) == 6
    combine_step(sections, str(tmp_path))
    assert names("a") == {"combined.md", "combined-009.md", "notes.md"} and names("b") == {"combined.md"}


# ---- report documents ---------------------------------------------------------------------------


def _keys(spark, n, name="k"):
    return spark.range(n).select(F.format_string(f'{name}"é\\%04d,\n', "id").alias("key"), F.col("id").alias("n_words"))


@pytest.mark.parametrize("n", [0, 1, 700])
def test_document_is_the_json_that_python_writes(spark, tmp_path, n):
    steps = [step_row(spark, name, "o\\p", 1.25, file_count=n) for name in ("one", "two")]
    path = str(tmp_path / "sub" / "report.json")
    write_report_document(path, steps, {"two": _keys(spark, n)}, {"convert": _keys(spark, n)}, 3.0, 'a "b"')
    text = open(path, encoding="utf-8").read()
    data = json.loads(text)
    assert text == json.dumps(data, ensure_ascii=False, indent=2) + "\n"
    keys = [f'k"é\\{i:04d},\n' for i in range(n)]
    assert data["convert_failures"] == keys and data["crawl_failures"] == [] and data["command"] == 'a "b"'
    assert data["steps"][1]["output_word_counts"] == {k: i for i, k in enumerate(keys)}
    assert data["steps"][0]["output_word_counts"] == {} and data["steps"][0]["output_path"] == "o/p"
    report, lines = read_report_document(spark, path)
    assert [s["file_count"] for s in report["steps"]] == [n, n] and report["total_elapsed_seconds"] == 3.0
    rows = lines.orderBy("ordinal").collect()
    assert [r.key for r in rows if r.kind == "3 convert failure"] == keys
    assert [(r.step_name, r.key, r.n_words) for r in rows if r.kind == "2 words"] == [("two", k, i) for i, k in enumerate(keys)]
    assert read_report(spark, path).select("report.convert_failures").first()[0] == keys


def test_reading_gives_defaults_and_asks_for_required_fields(spark, tmp_path):
    step = {"step_name": "s", "file_count": 1, "total_bytes": 2, "elapsed_seconds": 0.5, "output_path": "p"}
    write = lambda name, data: put(tmp_path, {name: json.dumps(data, indent=2)}) + f"/{name}"
    report, lines = read_report_document(spark, write("a.json", {"steps": [step], "total_elapsed_seconds": 1.0}))
    assert (report["command"], report["crawl_failures"]) == ("", [])
    body = json.loads(lines.filter("kind = '1 step'").first().step)
    assert (body["skipped_count"], body["downloaded_count"], body["failure_count"]) == (0, 0, 0) and lines.count() == 1
    for bad in ({"steps": [step]}, {"total_elapsed_seconds": 1.0}, {"steps": [{"step_name": "s"}], "total_elapsed_seconds": 1.0}):
        with pytest.raises(ValueError):
            read_report_document(spark, write("b.json", bad))


def test_run_writes_its_report_and_a_retry_reads_it(spark, tmp_path):
    first = run_pipeline(answers(spark, SITE), ROOT, command="pipeline")
    path = str(tmp_path / "report.json")
    first.write_report(path)
    data, one = json.load(open(path)), json.loads(first.report.select(report_json()).first()[0])
    assert data == one
    _, lines = read_report_document(spark, path)
    later = answers(spark, {**SITE, ROOT + "gone": "<main>back</main>"})
    again = {"retry_crawl": line_failures(lines, "crawl"), "retry_convert": line_failures(lines, "convert")}
    run = run_pipeline(later, ROOT, cached=first.pages, markdown=first.markdown, **again)
    assert [(r.url, r.outcome) for r in run.crawl.collect()] == [(ROOT + "gone", "downloaded")]
    assert "back" in run.bundles.first().text and run.bundles.first().n_sections == 4
    assert run.lines.filter("kind = '3 crawl failure'").count() == 0


# ---- steps -----------------------------------------------------------------------------------------


def test_inputs_go_retry_before_archives_before_folder(spark, tmp_path):
    html = put(tmp_path / "html", {"a.html": "<p>folder", "b.html": "<p>b"})
    os.makedirs(tmp_path / "zip")
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / "zip" / f"{n}.zip", "w") as z:
            z.writestr("e.html", "<p>entry" if n == 1 else b"\xff")
            z.writestr("f.html", "<p>f")
    archives = str(tmp_path / "zip")
    md = lambda step: sorted((r.md_path, r.markdown) for r in step.result.collect())
    assert md(convert_step(spark, html)) == [("a.md", "folder\n"), ("b.md", "b\n")]
    both = convert_step(spark, html, zip_paths=f"{archives}/1.zip")
    assert md(both) == [("e.md", "entry\n"), ("f.md", "f\n")]
    first = convert_step(spark, zip_paths=f"{archives}/2.zip")
    assert [r.key.rsplit("/", 1)[1] for r in first.failures.collect()] == ["2.zip!e.html"]
    (tmp_path / "zip" / "1.zip").write_bytes(b"not opened, as nothing in it is wanted")
    with zipfile.ZipFile(tmp_path / "zip" / "2.zip", "w") as z:
        z.writestr("e.html", "<p>mended")
    gone = spark.createDataFrame([(f"file:{archives}/2.zip!f.html",), (f"file:{html}/b.html",), ("/no/such.html",)], "key string")
    retry = first.failures.select("key").unionByName(gone)
    step = convert_step(spark, html, zip_paths=archives, retry=retry)
    assert md(step) == [("b.md", "b\n"), ("e.md", "mended\n")]
    assert sorted(r.key.rsplit("/", 1)[1] for r in step.failures.collect()) == ["2.zip!f.html", "such.html"]
    row = step.row.first()
    assert (row.file_count, row.total_bytes, row.failure_count) == (2, len("b\nmended\n"), 2)
    with pytest.raises(ValueError):
        convert_step(spark)


def test_a_whole_archive_can_be_retried(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(b"broken")
    first = convert_step(spark, zip_paths=str(tmp_path))
    assert first.row.first().failure_count == 1
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.html", "<p>a")
        z.writestr("b.html", "<p>b")
    again = convert_step(spark, zip_paths=str(tmp_path), retry=first.failures)
    assert sorted(r.md_path for r in again.result.collect()) == ["a.md", "b.md"] and again.failures.count() == 0


def test_crawl_step_counts_stored_bytes_and_strip_tags_are_passed_on(spark, tmp_path):
    step = crawl_step(answers(spark, SITE), ROOT)
    row = step.row.first()
    assert (row.file_count, row.downloaded_count, row.failure_count) == (3, 3, 1)
    assert row.total_bytes == sum(len(v.encode()) for v in SITE.values())
    assert [r.key for r in step.failures.collect()] == [ROOT + "gone"]
    html = put(tmp_path, {"a.html": "<p>kept</p><blockquote>cut</blockquote>"})
    done = convert_step(spark, html, strip_tags=["blockquote"], table=str(tmp_path / "md")).result.first()
    assert done.markdown == "kept\n" and spark.read.parquet(str(tmp_path / "md")).first().markdown == "kept\n"


def test_retry_selection_from_a_document_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "r.json")
    write_report_document(path, [step_row(spark, "s", "o")], failures={"crawl": _keys(spark, 5)})
    wanted = line_failures(read_report_document(spark, path)[1], "crawl")
    again, missing = select_retry(_keys(spark, 3).select("key"), wanted)
    assert (again.count(), missing.count()) == (3, 2)


def test_files_are_sent_to_the_converter_in_small_batches(spark, monkeypatch):
    @F.arrow_udf("long")
    def sent(contents: pa.Array) -> pa.Array:
        return pa.array([contents.nbytes] * len(contents), pa.int64())

    none = F.lit(None).cast("string")
    columns = ("key", sent("content").alias("n_bytes"), F.lit("ok").alias("status"), none.alias("error"))
    monkeypatch.setattr(steps, "convert_files", lambda files, tags: files.select(*columns))
    files = spark.range(0, 40, 1, 1).select(F.col("id").alias("key"), F.encode(F.repeat(F.lit("x"), F.lit(300_000)), "UTF-8").alias("content"))
    got = steps.convert_table(files).result
    # twelve megabytes were one batch
    assert got.count() == 40 and max(r["n_bytes"] for r in got.collect()) <= 5 << 20
