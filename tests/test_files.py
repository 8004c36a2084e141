import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bindery.functions import text as t
from bindery.operators.combine import build_sections, combine
from bindery.operators.convert import convert_files, converted, failures
from bindery.operators.report import failure_keys, report_json, select_retry, step_summary, pipeline_summary
from bindery.session import materialize
from bindery.sources import sinks, storage
from bindery.sources.files import read_html_dir, read_html_files, read_markdown_dir, read_report, read_zip
from bindery.sources.sinks import append_pages, export_files, read_page_store, write_markdown, write_report
from bindery.streaming import incremental
from bindery.streaming.fetched import FETCHED, store_fetched_pages
from bindery.streaming.incremental import convert_new_files, read_converted
from bindery.streaming.names import stream_settings


def put(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


def test_html_folder_scan_and_conversion(spark, tmp_path):
    root = put(tmp_path / "in put", {
        "index.html": "<p>é</p>", "guide/start.html": "<pre>a\r\nb</pre>", "guide/page.htm": "<p>h", "UP.HTML": "x",
        "note.txt": "x", "bad.html": b"<p>\xff", "same.html": "<p>html", "same.htm": "<p>htm",
    })
    files = read_html_dir(spark, root)
    assert sorted(r.rel_path for r in files.collect()) == sorted(
        ["index.html", "guide/start.html", "guide/page.htm", "bad.html", "same.html", "same.htm"]
    )
    done = {r.key.rsplit("/", 1)[1]: r for r in convert_files(files).collect()}
    assert done["start.html"].markdown == "```\na\nb\n```\n"
    assert (done["page.htm"].md_path, done["page.htm"].markdown) == ("guide/page.md", "h\n")
    assert (done["bad.html"].status, done["bad.html"].markdown) == ("failed", None)
    assert (done["same.htm"].status, done["same.html"].status) == ("ok", "duplicate")
    assert failures(convert_files(files)).count() == 1


def test_empty_folder_is_an_empty_table(spark, tmp_path):
    root = put(tmp_path / "none", {"a.txt": "x"})
    assert convert_files(read_html_dir(spark, root)).count() == 0


def test_retry_list_reports_missing_paths(spark, tmp_path):
    root = put(tmp_path / "html", {"a.html": "<p>a", "b.html": "<p>b"})
    wanted = spark.createDataFrame([(f"{root}/b.html", 0), (f"{root}/gone.html", 1)], "key string, ordinal int")
    found, missing = read_html_files(read_html_dir(spark, root), wanted)
    assert [r.rel_path for r in found.collect()] == ["b.html"]
    assert [r.key for r in missing.collect()] == [f"{root}/gone.html"]


def test_broken_archive_is_a_failed_row(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive" * 10)
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a.html", "<p>a")
    done = {r.md_path: r for r in convert_files(read_zip(spark, str(tmp_path))).collect()}
    assert (done["a.md"].status, done["a.md"].markdown) == ("ok", "a\n")
    (bad,) = [r for name, r in done.items() if name != "a.md"]
    assert bad.status == "failed" and "BadZipFile" in bad.error and bad.key.endswith("bad.zip")


def test_page_store_keeps_one_page_a_name(spark, tmp_path):
    rows = [("f.html", "u2", "x"), ("f.html", "u1", "y"), ("g.html", "u3", "z")]
    for _ in range(2):
        append_pages(spark.createDataFrame(rows, "filename string, url string, html string"), str(tmp_path / "store"))
    got = sorted(tuple(r) for r in read_page_store(spark, str(tmp_path / "store")).collect())
    assert got == [("f.html", "u1", "y"), ("g.html", "u3", "z")]


def test_zip_entries_fail_one_by_one(spark, tmp_path):
    for n in (1, 2):
        with zipfile.ZipFile(tmp_path / f"site{n}.zip", "w") as z:
            z.writestr("docs/b.html", "<main><h1>B</h1></main>")
            z.writestr("docs/a.htm", "<pre>x\r\ny</pre>")
            z.writestr("__MACOSX/b.html", "junk")
            z.writestr("readme.txt", "junk")
            z.writestr("bad.html", b"<p>\xff\xfe")
    entries = read_zip(spark, str(tmp_path / "site1.zip"))
    assert [r.rel_path for r in entries.orderBy("rel_path").collect()] == ["bad.html", "docs/a.htm", "docs/b.html"]
    done = {r.md_path: r for r in convert_files(entries).collect()}
    assert done["docs/b.md"].markdown == "# B\n"
    assert done["docs/a.md"].markdown == "```\nx\r\ny\n```\n"
    assert done["bad.md"].status == "failed" and done["bad.md"].key.endswith("site1.zip!bad.html")
    assert read_zip(spark, str(tmp_path)).groupBy("archive").count().filter("count = 3").count() == 2


def test_markdown_folder_to_bundle(spark, tmp_path):
    html = put(tmp_path / "html", {"b.html": "<p>bee", "a/x.html": "<h1>ex</h1>", "a-b.html": "<p>dash"})
    done = converted(convert_files(read_html_dir(spark, html)))
    out = str(tmp_path / "md")
    sizes = {r.rel_path: r.n_bytes for r in export_files(done, "md_path", "markdown", out).collect()}
    assert sizes == {"b.md": 4, "a/x.md": 5, "a-b.md": 5}
    docs = read_markdown_dir(spark, out)
    sections = build_sections(docs, F.lit("site"), F.col("rel_path"), F.col("body"))
    bundles = combine(sections, stem="all")
    text = bundles.first().text
    assert text == "Source: a/x.md\n\n# ex\n\n---\n\nSource: a-b.md\n\ndash\n\n---\n\nSource: b.md\n\nbee\n"
    export_files(bundles, "file_name", "text", str(tmp_path / "out"))
    assert (tmp_path / "out" / "all.md").read_text() == text
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["all.md"]
    write_markdown(done, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


STEP = {"step_name": "変換", "file_count": 2, "total_bytes": 2560, "elapsed_seconds": 2.25, "output_path": "out/md"}
REPORT = {"steps": [STEP, {**STEP, "output_word_counts": {"a.md": 7}, "failure_count": 1}], "total_elapsed_seconds": 3.5}


def report_file(tmp_path, data):
    (tmp_path / "r.json").write_text(data if isinstance(data, str) else json.dumps(data, indent=2), encoding="utf-8")
    return str(tmp_path / "r.json")


def test_report_defaults_and_summaries(spark, tmp_path):
    rows = read_report(spark, report_file(tmp_path, REPORT))
    r = rows.first().report
    assert (r.crawl_failures, r.convert_failures, r.command) == ([], [], "")
    assert r.steps[0].output_word_counts == {} and r.steps[0].skipped_count == 0
    assert r.steps[1].output_word_counts == {"a.md": 7} and r.steps[1].failure_count == 1
    line = "変換: 2 ファイル (2.5 KB), 2.2 秒 → out/md"
    assert rows.select(step_summary(F.col("report.steps")[0]).alias("s")).first().s == line
    total = rows.select(pipeline_summary(F.col("report")).alias("s")).first().s
    assert total == f"{line}\n{line}\n合計: 3.5 秒, 2 ステップ"


@pytest.mark.parametrize("broken", [
    {"steps": [STEP]}, {"total_elapsed_seconds": 1.0}, "not json", {"steps": [{"step_name": "x"}], "total_elapsed_seconds": 1.0},
])
def test_unusable_report_is_refused(spark, tmp_path, broken):
    with pytest.raises(Exception, match="report"):
        read_report(spark, report_file(tmp_path, broken)).collect()


def test_report_round_trip_and_retry(spark, tmp_path):
    full = {**REPORT, "crawl_failures": ["u1", "u2", "u1"], "convert_failures": ["ü.html"], "command": "run"}
    rows = read_report(spark, report_file(tmp_path, full))
    write_report(rows, str(tmp_path / "back"))
    text = next((tmp_path / "back").glob("part*")).read_text(encoding="utf-8")
    assert "ü.html" in text and text.endswith("}\n") and not text.endswith("\n\n")
    assert json.loads(text)["crawl_failures"] == ["u1", "u2", "u1"]
    assert read_report(spark, str(tmp_path / "back")).first() == rows.first()
    assert rows.select(report_json().alias("j")).first().j == text
    again, missing = select_retry(
        spark.createDataFrame([("u2", 1), ("u3", 2)], "key string, v int"), failure_keys(rows, "crawl")
    )
    assert [(r.key, r.v) for r in again.collect()] == [("u2", 1)]
    assert [(r.key, r.ordinal) for r in missing.collect()] == [("u1", 0)]


def test_stream_converts_only_new_files(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(root, {"a.html": "<p>a", "d/b.htm": "<p>b"})
    convert_new_files(spark, str(root), out, state)
    put(root, {"c.html": "<p>c", "a.htm": "<p>late"})
    convert_new_files(spark, str(root), out, state)
    convert_new_files(spark, str(root), out, state)
    rows = sorted((r.md_path, r.status, r.markdown, r.batch) for r in read_converted(spark, out).collect())
    assert [r[:3] for r in rows if r[1] == "ok"] == [("a.md", "ok", "late\n"), ("c.md", "ok", "c\n"), ("d/b.md", "ok", "b\n")]
    assert [r[:3] for r in rows if r[1] != "ok"] == [("a.md", "duplicate", None)]
    assert {r[3] for r in rows} == {0, 1}


def test_batches_do_not_decide_who_keeps_a_name(spark, tmp_path):
    root = put(tmp_path / "in", {"a.html": "<p>1", "a.htm": "<p>2", "b/x.htm": "<p>3", "b/x.html": "<p>4", "c.html": b"\xff"})
    found = []
    for size in (1, 2, 100):
        out = str(tmp_path / f"out{size}")
        convert_new_files(spark, root, out, str(tmp_path / f"state{size}"), max_files_per_batch=size)
        rows = read_converted(spark, out).drop("batch").collect()
        found.append(sorted((r.key, r.md_path, r.status, r.markdown or "", r.error or "") for r in rows))
    assert found[0] == found[1] == found[2]
    assert [r[2] for r in found[0]] == ["ok", "duplicate", "ok", "duplicate", "failed"]


def test_a_name_changes_hands_between_runs(spark, tmp_path):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    put(root, {"a.html": "<p>1", "b.htm": "<p>2"})
    convert_new_files(spark, str(root), out, state)
    put(root, {"a.htm": "<p>3", "b.html": "<p>4", "c.htm": b"\xff"})
    convert_new_files(spark, str(root), out, state)
    put(root, {"c.html": "<p>5"})  # the failed file keeps the name
    convert_new_files(spark, str(root), out, state)
    rows = {r.key.rsplit("/", 1)[1]: (r.status, r.markdown) for r in read_converted(spark, out).collect()}
    lost = ("duplicate", None)
    assert rows == {"a.html": lost, "a.htm": ("ok", "3\n"), "b.htm": ("ok", "2\n"), "b.html": lost, "c.htm": ("failed", None), "c.html": lost}
    assert "instead" not in read_converted(spark, out).columns


def _converted(spark, out):
    return sorted((r.key.split("in put/")[1], r.status, r.markdown or "") for r in read_converted(spark, out).collect())


def test_the_driver_keeps_a_name_for_each_batch_not_for_each_file(spark, tmp_path):
    root, out, state = put(tmp_path / "in put", {f"p/{i}.html": f"<p>{i}" for i in range(12)}), str(tmp_path / "out"), tmp_path / "state"
    convert_new_files(spark, root, out, str(state), max_files_per_batch=5)
    log = [x for f in (state / "sources" / "0").iterdir() if f.name.isdigit() for x in f.read_text().splitlines()[1:]]
    assert len(log) == 3 and not [x for x in log if ".html" in x]
    assert sorted(r["count"] for r in read_converted(spark, out).groupBy("batch").count().collect()) == [2, 5, 5]
    assert _converted(spark, out) == sorted((f"p/{i}.html", "ok", f"{i}\n") for i in range(12))


def test_only_files_that_hold_their_names_are_read(spark, tmp_path):
    root = put(tmp_path, {"a.html": "<p>a", "none.html": ""})
    rows = [(7, f"file:{root}/a.html", 4), (8, f"file:{root}/gone.html", None), (9, f"file:{root}/none.html", 0)]
    listed = spark.createDataFrame(rows, "id int, path string, n_bytes long")
    assert sorted((r.id, r.content) for r in storage.with_content(listed, root).collect()) == [(7, b"<p>a"), (8, None), (9, b"")]


def test_names_that_a_broken_run_noted_are_converted_once(spark, tmp_path):
    root, out, state = tmp_path / "in put", str(tmp_path / "out"), str(tmp_path / "state")
    assert incremental.note_new_files(spark, put(root, {"a.txt": "x"}), state, 5) is None
    convert_new_files(spark, str(root), out, state)
    assert read_converted(spark, out) is None
    put(root, {"a.html": "<p>a"})
    incremental.note_new_files(spark, str(root), state, 5)
    put(root, {"b.html": "<p>b"})
    for _ in range(2):
        convert_new_files(spark, str(root), out, state)
    assert _converted(spark, out) == [("a.html", "ok", "a\n"), ("b.html", "ok", "b\n")]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        convert_new_files(spark, str(tmp_path / "gone"), out, state)


def test_a_listing_finds_what_the_file_source_finds_and_goes_on_from_it(spark, tmp_path, monkeypatch):
    odd = {"a b+c%41.html": "<p>1", "é/x=1/y.htm": "<p>2", "empty.html": "", ".h.html": "h", "_u/v.html": "u", "_k=1/v.html": "<p>3", "UP.HTML": "x"}
    late = {"empty.html": "<p>late", "a b+c%41.htm": "<p>4", "z.html": b"\xff"}
    want = [("_k=1/v.html", "ok", "3\n"), ("a b+c%41.htm", "ok", "4\n"), ("a b+c%41.html", "duplicate", ""), ("z.html", "failed", ""), ("é/x=1/y.htm", "ok", "2\n")]
    for case, by_name in enumerate([(False, False), (False, True), (True, True)]):
        root, out, state = tmp_path / str(case) / "in put", str(tmp_path / f"{case}.out"), str(tmp_path / f"{case}.state")
        for files, known in zip((odd, late), by_name, strict=True):
            monkeypatch.setattr(incremental, "reached", lambda path, known=known: known)
            convert_new_files(spark, put(root, files), out, state)
        assert _converted(spark, out) == want, by_name


def _answers(spark, rows, log):
    spark.createDataFrame(rows, FETCHED).coalesce(1).write.mode("append").parquet(log)


def test_fetch_log_stream_stores_pages_once(spark, tmp_path):
    log, html = str(tmp_path / "log"), "text/html"
    site = "https://s.example/"
    rows = [
        (0, f"{site}a", 200, html, "first"), (1, f"{site}a?x", 200, html, "same name"), (2, f"{site}b", 404, html, "gone"),
        (3, f"{site}c", 200, "application/pdf", "%PDF"), (4, f"{site}b", 200, html, "second try"), (5, f"{site}a", 200, html, "again"),
        (None, f"{site}e", 200, html, None), (7, None, 200, html, "no url"), (8, f"{site}f", None, None, None),
    ]
    want = [("a.html", f"{site}a", "first"), ("b.html", f"{site}b", "second try"), ("e.html", f"{site}e", None)]
    stored = lambda store: sorted(tuple(r) for r in read_page_store(spark, store).collect())
    _answers(spark, rows, log)
    store_fetched_pages(spark, log, str(tmp_path / "one"), str(tmp_path / "one.state"), site)
    assert stored(str(tmp_path / "one")) == want
    cut, store, state = str(tmp_path / "cut"), str(tmp_path / "two"), tmp_path / "two.state"
    for part in (rows[:2], rows[2:5], rows[5:]):
        _answers(spark, part, cut)
        store_fetched_pages(spark, cut, store, str(state), site)
        assert len(stored(store)) == len({name for name, *_ in stored(store)})
    assert stored(store) == want
    # a batch whose commit was lost runs again and adds nothing
    last = max((p for p in (state / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    store_fetched_pages(spark, cut, store, str(state), site)
    assert stored(store) == want
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert before != "500"


def test_path_key_is_posix(spark):
    assert spark.range(1).select(t.posix_path(F.lit("a\\b")).alias("p")).first().p == "a/b"


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    root = put(tmp_path / "many", {f"p/{i}.html": "" if i % 3 == 0 else f"<p>{i}" for i in range(300)} | {"p/.h.html": "<p>h"})
    files = read_html_dir(spark, root)
    # Spark's file source takes 32 small files a task
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {r.rel_path: bytes(r.content).decode() for r in files.collect()}
    assert got == {f"p/{i}.html": "" if i % 3 == 0 else f"<p>{i}" for i in range(300)} | {"p/.h.html": "<p>h"}


def test_contents_leave_a_worker_some_at_a_time(monkeypatch):
    monkeypatch.setattr(storage, "_BYTES_HELD", 100)
    rows = [(str(i), bytes(30)) for i in range(20)] + [("big", bytes(1000)), ("none", None), ("last", b"")]
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    out = list(storage.some_at_a_time(iter(rows), 1, schema))
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == rows
    assert all(sum(len(c or b"") for c in b.column(1).to_pylist()[:-1]) < 100 for b in out) and len(out) > 5
    assert list(storage.some_at_a_time(iter([]), 1, schema)) == []


def test_files_are_sent_to_their_writer_in_small_batches(spark, tmp_path, monkeypatch):
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(sinks, "materialize", lambda df, label: seen.append(spark.conf.get(key)) or materialize(df, label))
    before = spark.conf.get(key)
    texts = spark.createDataFrame([("a/1.bin", b"\xff"), ("a/2.bin", b"")], "name string, content binary")
    assert sorted(map(tuple, export_files(texts, "name", "content", str(tmp_path)).collect())) == [("a/1.bin", 1), ("a/2.bin", 0)]
    assert [int(v) for v in seen] == [4 << 20] and spark.conf.get(key) == before
    assert (tmp_path / "a" / "1.bin").read_bytes() == b"\xff"


def test_a_folder_that_is_not_there_is_no_empty_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_html_dir(spark, str(tmp_path / "gone"))


def test_a_stream_lists_new_files_in_few_tasks(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    with stream_settings(spark):
        # one task a file otherwise
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
        assert int(spark.conf.get("spark.sql.files.openCostInBytes").rstrip("b")) == 65536
    assert (spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")) == before
