"""Whitening, hard negatives and quality scores against brute force and held-out labels."""

import math
import random
import zlib

import numpy as np
import pytest

from bindery.llm import negatives, quality, whitening
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, n long, row long, windows string"


def _vectors(n=400, width=12):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((10, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 10))
        rows.append((i, (base[label] + 0.5 * rng.standard_normal(width)).astype(np.float32).tolist(), label))
    rows += [(n, None, 1), (n + 1, [1.0] * (width - 1) + [math.nan], 1), (n + 2, [1.0] * (width - 1) + [None], 2)]
    rows += [(n + 3, [math.inf] * width, 3), (n + 4, rows[3][1], None), (None, rows[4][1], 4), (n + 5, [0.0] * width, 5)]
    rows += [rows[50], rows[50], (n + 6, [1.0, 2.0], 2), (n + 7, [], 2), (n + 8, [1e30] * width, 2)]
    return [(*r, 1, 2, "x") for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(_vectors(), VECTORS).repartition(7).cache()


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], VECTORS)


def _usable(rows, width):
    fine = lambda v: v is not None and len(v) == width and all(x is not None and abs(x) < 1e10 for x in v)
    return [r for r in rows if fine(r[1])]


# ---- whitening ----------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_singular_vectors_of_hard_triangles(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    kinds = [
        lambda: rng.standard_normal((d, d)),
        lambda: np.round(rng.standard_normal((d, d))),  # zero and equal singular values
        lambda: rng.standard_normal((d, d)) * 10.0 ** rng.uniform(-9, 9, (d, 1)),
        lambda: np.diag(rng.integers(0, 3, d).astype(float)),
        lambda: np.outer(rng.standard_normal(d), rng.standard_normal(d)),
    ]
    r = kinds[seed % 5]()
    value, vector = whitening.principal(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert len(value) >= (want > 1e-20 * want[0]).sum() if want[0] else not len(value)
    assert np.abs(value - want[: len(value)]).max(initial=0) <= 1e-12 * want[0]
    assert np.abs(vector.T @ vector - np.eye(len(value))).max(initial=0) < 1e-8
    assert np.abs(r.T @ (r @ vector) - vector * value).max(initial=0) <= 1e-12 * want[0]


def test_dqds_finds_tiny_singular_values_to_high_relative_accuracy():
    diagonal, above = 10.0 ** -np.arange(30.0), np.full(29, 0.0)
    assert np.allclose(whitening.dqds(diagonal, above), diagonal**2, rtol=1e-13)
    # graded: the product of the diagonal is the product of the singular values, whatever stands above
    above = diagonal[1:] * 0.3
    assert math.isclose(np.log(whitening.dqds(diagonal, above)).sum(), 2 * np.log(diagonal).sum(), rel_tol=1e-12)


def test_cluster_of_nearly_equal_singular_values_gets_orthogonal_vectors():
    n = 21  # Wilkinson's matrix shifted to be definite: pairs that agree to many digits
    t = np.diag(np.abs(np.arange(n) - 10.0) + 2) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    r = np.linalg.cholesky(t).T
    value, vector = whitening.principal(r)
    assert np.allclose(value, np.linalg.eigvalsh(t)[::-1], rtol=1e-13)
    assert np.abs(vector.T @ vector - np.eye(n)).max() < 1e-9
    assert np.abs(t @ vector - vector * value).max() < 1e-9


def test_whitening_against_eigenvectors(vectors):
    got = whitening.whiten(vectors).collect()
    rows = _usable(_vectors(), 12)
    x = np.floor(64 * np.array([r[1] for r in rows], np.float64)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == n * 12
    want = centred @ q / np.sqrt(e)
    deviation = ((n * x - s) ** 2).sum(1)
    by_component = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-9)
        by_component.setdefault(r["component"], []).append((-1 if r["vec_id"] is None else r["vec_id"], r["whitened"], r["deviation"]))
    ids = [-1 if r[0] is None else r[0] for r in rows]
    for c, found in by_component.items():
        mine = sorted((i, d, w) for i, w, d in found)
        theirs = sorted((i, int(d), w) for i, d, w in zip(ids, deviation, want[:, c - 1]))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening_keeps_at_most_its_components_and_other_keys(vectors):
    named = vectors.withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id")))
    got = whitening.whiten(named, components=3)
    assert dict(got.dtypes)["vec_id"] == "string"
    assert {r["component"] for r in got.select("component").distinct().collect()} == {1, 2, 3}


def test_whitening_without_variance(spark, no_vectors):
    assert whitening.whiten(no_vectors).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, 1, 1, "") for i in range(5)], VECTORS)
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1, 1, 1, "") for i in range(5)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and math.isclose(got[0]["explained"], 1.0)


def test_deviations_beyond_64_bits_are_exact_or_null():
    model = whitening.Whitening(3, np.array([3 << 40]), np.eye(1), np.ones(1), 1.0, 64, 0, 1 << 40)
    x = np.array([[(1 << 40) + 5], [(1 << 40) - (1 << 29)], [0]])
    assert whitening._deviations(x, model) == [225, (3 << 29) ** 2, None]


# ---- hard negatives -------------------------------------------------------------------------


def _mined(rows, anchor, label, positives=5, count=3, low=50, high=95):
    rows = [(i, label(i, lab), [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None]
    out = []
    for k, (i, lab, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for n, (j, m, w) in enumerate(rows) if n != k and len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            fits = sorted(s for s in scored if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p)
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m, _) in enumerate(fits[:count])]
    return sorted(out)


def _moved(i, label):
    return (label + 1) % 10 if i % 7 == 0 else label


@pytest.mark.parametrize("blocks", [(8192, 8192, 512), (5, 37, 3)])
def test_hard_negatives_against_brute_force(vectors, monkeypatch, blocks):
    for name, size in zip(("ANCHORS", "ROWS", "STRIDE"), blocks):
        monkeypatch.setattr(negatives, name, size)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(vectors, F.col("vec_id") % 50 == 0, label)
    rows = _usable(_vectors(), 12) + [r for r in _vectors() if r[1] == [1.0, 2.0]]
    want = _mined(rows, lambda i: i % 50 == 0, _moved)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_hard_negatives_with_ties_and_scores_of_zero_and_below(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], rnd.randrange(3), 1, 1, "") for i in range(120)]
    got = negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 4 == 0, n_positives=20, n_negatives=7)
    want = _mined(rows, lambda i: i % 4 == 0, lambda _, lab: lab, 20, 7)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[4] == 0 for r in want)


def test_hard_negatives_of_nothing(vectors, no_vectors):
    assert negatives.mine(no_vectors, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(vectors, F.col("vec_id") < 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(vectors, F.lit(True), window=(95, 120))


def test_large_components_are_scored_exactly(spark):
    big = float((1 << 24) / 256 - 1)
    rows = [(0, [big] * 8, 1), (1, [big] * 8, 1), (2, [big * 0.9] * 8, 2), (3, [big * 100] * 8, 2)]
    got = negatives.mine(spark.createDataFrame([(*r, 1, 1, "") for r in rows], VECTORS), F.col("vec_id") == 0).collect()
    v, w = math.floor(256 * big), math.floor(256 * float(np.float32(big * 0.9)))
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 8 * v * v, 8 * v * w)]


# ---- quality ----------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, score double, held_out string, quality int"


def _docs(n=600):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 9))) for _ in range(200)]
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        text = [rnd.choice(words) for _ in range(rnd.randint(30, 90))]
        if not good:
            text = [w + "$$$" for w in text] if i % 2 else [w for w in text[:4] for _ in range(12)]
        rows.append((i, " ".join(text)))
        marks.append((i, int(good)))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (None, rows[1][1]), (n + 3, rows[1][1]), (n + 3, rows[1][1])]
    rows += [(n + 4, " ".join(rnd.choice(words) for _ in range(60_000))), (n + 5, "x" * 300_000)]
    marks += [(n, 1), (7, 0), (7, 1), (8, None), (None, 1), (10_000, 0)]
    return [(*r, "en", 3.0, "no", 9) for r in rows], marks


@pytest.fixture(scope="module")
def graded(spark):
    docs, marks = _docs()
    return spark.createDataFrame(docs, DOCS).repartition(5).cache(), spark.createDataFrame(marks, "doc_id long, quality int")


def test_quality_of_held_out_documents(graded):
    docs, labels = graded
    model = quality.train(docs, labels)
    got = quality.score(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["score"]) == r["score"]
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held]
    assert len(held) > 100 and sum(right) / len(right) > 0.97


def test_quality_model_ignores_labels_of_held_out_rows_and_row_order(graded):
    docs, labels = graded
    model = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs.repartition(3), flipped.repartition(2))
    for a, b in zip(model[:-1], again[:-1]):
        assert np.array_equal(a, b)


def test_word_vectors_against_plain_sums(graded, monkeypatch):
    docs, _ = graded
    monkeypatch.setattr(quality, "STRETCH", 310_000)
    got = quality.word_vectors(docs)
    place, sign = quality._index()
    total = np.zeros((quality.WORDS, quality.DIM))
    for r in docs.collect():
        words = [zlib.crc32(w.encode()) % quality.WORDS for w in quality._PARTS.findall(r["text"] or "")]
        for i, w in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    np.add.at(total[w], place[:, words[j]], sign[:, words[j]])
    known = total.any(1)
    unit = quality._unit(total)
    unit[known] = quality._unit(unit[known] - unit[known].mean(0))
    assert np.abs(got - unit).max() < 1e-6


def test_pooling_in_strides(monkeypatch):
    rng = np.random.default_rng(0)
    vectors, words = rng.standard_normal((quality.WORDS, quality.DIM)).astype(np.float32), rng.integers(0, quality.WORDS, 1000)
    whole = quality.pooled(words, vectors)
    monkeypatch.setattr(quality, "STRIDE", 7)
    assert np.allclose(whole, quality.pooled(words, vectors), atol=1e-6)
    assert not quality.pooled(words[:0], vectors).any()


def test_quality_without_labels_or_documents(spark, graded):
    docs, labels = graded
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none), ["doc_id"]).collect()} == {0.5}
    ones = labels.filter("quality = 1")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, ones), ["doc_id"]).collect()} == {1.0}
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels), ["doc_id"]).count() == 0
