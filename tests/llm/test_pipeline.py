import corpus_pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        path = str(tmp_path / f"s{len(list(tmp_path.iterdir()))}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} <= {r["doc_id"] for r in before.collect()}
    assert sum(r["length"] for r in packed) > 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, whole string, repeated int, before long, _pos int"
    prose = lambda *w: " ".join(f"{a}{b} {b}{a}" for a in w for b in "abcdefgh")
    a, b, c = prose("the", "ing"), prose("and", "ost"), prose("wer", "sch")
    long = " ".join(f"w{i:06d}" for i in range(40_000))
    texts = [(1, a), (2, None), (3, ""), (4, "12 ."), (5, b), (5, b), (6, a), (None, c), (7, a[:200] + " " + c), (8, long), (9, b + " x")]
    rows = [(i, t, "en", "s" if i else None, 0, 1.0, "w", 2, 3, 4) for i, t in texts]
    docs = spark.createDataFrame(rows, schema)
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / f"s{n}"))
        docs = spark.read.parquet(str(tmp_path / f"s{n}"))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            assert {(r["score"], r["whole"], r["repeated"], r["before"], r["_pos"]) for r in docs.collect()} == {(1.0, "w", 2, 3, 4)}
        seen.append(docs.collect())
    ids = [sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in s) for s in seen]
    assert ids[0] == [-1, 1, 5, 5, 6, 7, 8, 9] and ids[1] == [-1, 1, 5, 7, 8]
    cut = {r["doc_id"]: r for r in seen[2]}
    # of document 7 the passage of document 1 goes, and what is left begins where it ends
    assert cut[1]["text"] == a and cut[7]["text"] == " " + c and cut[7]["n_chars"] == len(c) + 1 and cut[None]["text"] == c
    assert {r["doc_id"] for r in seen[4]} == {r["doc_id"] for r in seen[3]}
