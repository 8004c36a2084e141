import json

from pyspark.sql import functions as F

from bindery.operators.report import failure_keys, report_json
from bindery.plans.pipeline import run_pipeline
from tests.test_crawl import ROOT, answers, page

SITE = {ROOT: page("a", "gone", "b"), ROOT + "a": page("b"), ROOT + "b": "<main><p>bee</p></main>"}


def outline(run):
    return {r.file_name: (r.n_words, r.n_sections) for r in run.bundles.collect()}


def test_whole_run_and_report(spark):
    run = run_pipeline(answers(spark, SITE), ROOT, command="pipeline")
    assert {r.md_path for r in run.markdown.collect()} == {"index.md", "docs_a.md", "docs_b.md"}
    text = run.bundles.first().text
    assert text.startswith("Source: docs_a.md\n\n# P\n\n[l](b)\n\n---\n\nSource: docs_b.md\n\nbee\n")
    data = json.loads(run.report.select(report_json().alias("j")).first().j)
    assert [s["step_name"] for s in data["steps"]] == ["クロール", "変換", "結合"]
    crawl, convert, joined = data["steps"]
    assert (crawl["file_count"], crawl["downloaded_count"], crawl["failure_count"]) == (3, 3, 1)
    assert (convert["file_count"], convert["failure_count"]) == (3, 0)
    assert joined["output_word_counts"] == {"combined.md": len(text.split())}
    assert joined["total_bytes"] == len(text.encode())
    assert (data["crawl_failures"], data["command"]) == ([ROOT + "gone"], "pipeline")


def test_retry_takes_only_the_failures(spark):
    first = run_pipeline(answers(spark, SITE), ROOT)
    later = answers(spark, {**SITE, ROOT + "gone": "<main>back</main>"})
    run = run_pipeline(
        later,
        ROOT,
        cached=first.pages,
        retry_crawl=failure_keys(first.report, "crawl"),
        retry_convert=failure_keys(first.report, "convert"),
        markdown=first.markdown,
    )
    assert [(r.url, r.outcome) for r in run.crawl.collect()] == [(ROOT + "gone", "downloaded")]
    assert run.crawl_failures.count() == 0
    assert outline(run)["combined.md"][1] == 4
    assert "back" in run.bundles.first().text


def test_retry_of_a_vanished_page_stays_failed(spark):
    none = spark.createDataFrame([], "key string, ordinal int")
    lost = spark.createDataFrame([("nowhere.html", 0)], "key string, ordinal int")
    run = run_pipeline(answers(spark, SITE), ROOT, retry_crawl=none, retry_convert=lost)
    assert [r.key for r in run.convert_failures.collect()] == ["nowhere.html"]
    assert outline(run) == {"combined.md": (0, 0)}
    assert run.report.select(F.col("report.convert_failures").alias("f")).first().f == ["nowhere.html"]
