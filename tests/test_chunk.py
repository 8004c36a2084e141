import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.operators.chunk import block_assign, block_step
from bindery.operators.combine import assign_chunks, build_sections, combine, corpus_words
from bindery.sources.sinks import write_bundles


def fold(words, limit, sep):
    held, chunk, out = None, 0, []
    for w in words:
        if held is None or held + sep + w > limit:
            chunk, held = chunk + 1, w
        else:
            held += sep + w
        out.append(chunk)
    return out


def test_steps_compose_to_the_plain_fold():
    rng = np.random.default_rng(7)
    for _ in range(1500):
        n, limit, sep = int(rng.integers(1, 60)), int(rng.integers(0, 40)), int(rng.integers(0, 3))
        words = rng.integers(0, int(rng.integers(1, 50)), n)
        cuts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 5))))
        blocks = [b for b in np.split(words, cuts) if len(b)]
        steps = [block_step(b, limit, sep) for b in blocks]
        whole = steps[0]
        for s in steps[1:]:
            whole = whole.then(s)
        carry, chunks, out = limit + 1, 0, []
        for b, s in zip(blocks, steps, strict=True):
            out += list(chunks + block_assign(b, limit, sep, carry))
            after, opened = s(carry)
            carry, chunks = min(int(after), limit + 1), chunks + int(opened)
        assert out == fold(words, limit, sep)
        after, opened = whole(limit + 1)
        assert (min(int(after), limit + 1), int(opened)) == (carry, chunks)


@pytest.mark.parametrize(("block_rows_log2", "fan_in"), [(16, 64), (3, 2), (0, 3)])
def test_one_hot_corpus_and_many_small_ones(spark, block_rows_log2, fan_in):
    rng = np.random.default_rng(block_rows_log2)
    data = {"hot": rng.integers(0, 30, 700), "two": rng.integers(0, 90, 40), "zero": np.zeros(20, dtype=int)}
    data |= {f"s{i}": rng.integers(0, 200, int(rng.integers(1, 6))) for i in range(15)}
    rows = [(c, i, int(w)) for c, ws in data.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "corpus string, rel_path int, n_words long").repartition(3)
    done = assign_chunks(df, [F.col("rel_path")], max_words=100, block_rows_log2=block_rows_log2, fan_in=fan_in)
    got = {}
    for r in done.orderBy("corpus", "rel_path").collect():
        got.setdefault(r.corpus, []).append(r.chunk_no)
    assert got == {c: fold(ws, 100, 1) for c, ws in data.items()}


def sections(spark, texts, header=False, corpus="c"):
    df = spark.createDataFrame([(corpus, p, b) for p, b in texts.items()], "corpus string, path string, body string")
    return build_sections(df, F.col("corpus"), F.col("path"), F.col("body"), header)


def bundle(spark, texts, header=False, **kw):
    return combine(sections(spark, texts, header), **kw).orderBy("corpus", "chunk_no").collect()


def test_order_is_part_wise_and_header_is_optional(spark):
    texts = {"b.md": " two \n", "a-b.md": "dash", "a/b.md": "　deep"}
    row = bundle(spark, texts)[0]
    assert (row.file_name, row.text, row.n_words, row.n_sections) == (
        "combined.md", "deep\n\n---\n\ndash\n\n---\n\ntwo\n", 5, 3,
    )
    row = bundle(spark, {"guide/start.md": "x y"}, header=True)[0]
    assert (row.text, row.n_words) == ("Source: guide/start.md\n\nx y\n", 4)


def test_separator_is_free(spark):
    assert bundle(spark, {"a.md": "x", "b.md": "y"}, separator="\n***\n")[0].text == "x\n***\ny\n"


def test_corpus_without_sections_gives_one_empty_bundle(spark):
    corpora = spark.createDataFrame([("c",), ("void",)], "corpus string")
    rows = combine(sections(spark, {"a.md": "x"}), corpora=corpora).orderBy("corpus").collect()
    assert [(r.corpus, r.file_name, r.text, r.n_words, r.n_sections) for r in rows] == [
        ("c", "combined.md", "x\n", 1, 1), ("void", "combined.md", "", 0, 0),
    ]
    empty = combine(sections(spark, {}, corpus="c"), corpora=corpora)
    assert empty.count() == 2


def test_default_limit_splits_large_sections(spark):
    big = " ".join(["w"] * 300_000)
    rows = bundle(spark, {"a.md": big, "b.md": big}, header=True, stem="out")
    assert [(r.file_name, r.n_words) for r in rows] == [("out-001.md", 300_002), ("out-002.md", 300_002)]
    many = {f"{i}.md": " ".join(["w"] * 100_000) for i in range(6)}
    assert [r.n_sections for r in bundle(spark, many)] == [4, 2]
    assert [r.file_name for r in bundle(spark, {"a.md": "w " * 100, "b.md": "w " * 100})] == ["combined.md"]


def test_one_oversize_section_is_numbered(spark):
    assert [r.file_name for r in bundle(spark, {"a.md": "w " * 20}, max_words=10)] == ["combined-001.md"]


@pytest.mark.parametrize("separator", ["\n\n---\n\n", "X", "X ", " X", "", " ", "\n", "a b"])
@pytest.mark.parametrize("header", [True, False])
def test_joined_word_total_is_exact_for_any_separator(spark, separator, header):
    cases = [["x y", "z"], ["", "a", ""], ["", "", "b"], ["c"], [""], ["a", "", "b c", "d"], ["", ""]]
    for bodies in cases:
        texts = {f"{i}.md": b for i, b in enumerate(bodies)}
        got = corpus_words(sections(spark, texts, header), F.col("rel_path"), separator).first().total_words
        parts = [f"Source: {p}\n\n{b}" if header else b for p, b in texts.items()]
        assert got == len((separator.join(parts) + "\n").split()), (separator, header, bodies)


def test_touching_separator_decides_by_the_joined_text(spark):
    # six sections of one word joined by "X" are one single word
    rows = bundle(spark, {f"{i}.md": "w" for i in range(6)}, separator="X", max_words=3)
    assert [(r.file_name, r.n_words) for r in rows] == [("combined.md", 1)]


def test_rerun_replaces_a_corpus_whole(spark, tmp_path):
    out = str(tmp_path / "bundles")
    write_bundles(combine(sections(spark, {"a.md": "x " * 9, "b.md": "y " * 9}), max_words=10), out)
    write_bundles(combine(sections(spark, {"k.md": "other"}, corpus="d")), out)
    assert spark.read.parquet(out).count() == 3
    write_bundles(combine(sections(spark, {"a.md": "x"})), out)
    rows = spark.read.parquet(out).orderBy("corpus").collect()
    assert [(r.corpus, r.file_name, r.text) for r in rows] == [("c", "combined.md", "x\n"), ("d", "combined.md", "other\n")]


def test_repeated_path_is_refused(spark):
    twice = sections(spark, {"a.md": "x"}).union(sections(spark, {"a.md": "y"}))
    with pytest.raises(Exception, match="repeated path"):
        combine(twice).collect()
