"""Language identification as a mixture of languages.

Each language is a distribution over hashed letter trigrams, counted over training texts. A document's language
proportions are estimated by expectation-maximisation over its trigrams; the set of languages is chosen by penalised
likelihood (languages are added in the order of their proportions as long as each raises the log-likelihood by more
than ``PENALTY`` times the log of the trigram count), and the language of the largest proportion is the prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing could
be learned; ties go to the first language in code point order; rows with a null doc_id are never used for training;
repeated rows are predicted alike; an empty table gives no rows; other columns are ignored, and a carried one that bears
the name of a result is an error unless the results are given other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import slices

BUCKETS = 1 << 15
#: Bound on the training sample: about this many documents of each language, taken by hash.
SAMPLE_DOCS = 2_000
PENALTY = 4.0
SMOOTHING = 0.2
STEPS = 8
SLICE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _codes(text: str) -> np.ndarray:
    """Letters in lower case; all else is one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, 32)
    return points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]


def _buckets(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (c[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(49)).astype(np.int32)


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, bucket, count`` of the trigrams of each text, sorted by document; whole texts, slice by slice."""
    keys, n, held = [], [], []
    kind = np.int32 if len(texts) * BUCKETS < 1 << 31 else np.int64

    def close() -> None:
        if held:
            k, c = np.unique(np.concatenate(held), return_counts=True)
            keys.append(k), n.append(c.astype(np.int32))
            held.clear()

    size = 0
    for doc, text in enumerate(texts):
        long = np.zeros(BUCKETS, np.int64) if len(text) > SLICE else None
        for at in range(0, max(len(text), 1), SLICE):
            part = " " + text[max(0, at - 2) : at + SLICE] + " "
            b = _buckets(_codes(part))
            if long is not None:
                long += np.bincount(b, minlength=BUCKETS)
            else:
                held.append(b.astype(kind, copy=False) + kind(doc * BUCKETS))
                size += len(b)
        if long is not None or size > SLICE:
            close()
            size = 0
        if long is not None:
            at = np.flatnonzero(long)
            keys.append((at + doc * BUCKETS).astype(kind)), n.append(long[at])
    close()
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    k = np.concatenate(keys)
    return k // BUCKETS, k % BUCKETS, np.concatenate(n)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram distributions ``(buckets, languages)``, from text and lang alone.

    The sample is bounded, so the model is too: languages times buckets.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(~held_out()).select("doc_id", "lang", "text")
    # one number a language; the texts are filtered where they lie
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.ones((BUCKETS, 1), np.float32) / BUCKETS
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")]
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    sample = rows.filter(at * size < sample_docs * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            doc, bucket, n = _counts(texts)
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            if not len(doc):
                continue
            k, at = np.unique(code[doc] * BUCKETS + bucket, return_inverse=True)
            total = np.bincount(at, weights=n).astype(np.int64)
            lang = pa.array([names[i] for i in (k // BUCKETS).tolist()])
            yield pa.RecordBatch.from_arrays([lang, pa.array(k % BUCKETS), pa.array(total)], ["lang", "bucket", "n"])

    grams = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    counted = grams.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counted})
    p = np.full((BUCKETS, max(len(languages), 1)), SMOOTHING)
    column = {x: i for i, x in enumerate(languages)}
    for r in counted:
        p[r["bucket"], column[r["lang"]]] += r["n"]
    return languages, (p / p.sum(0)).astype(np.float32)


def _em(theta: np.ndarray, p: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, steps: int):
    """Proportions after ``steps`` and the log-likelihood of each document. A zero proportion stays zero."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(steps):
        share = theta[doc] * p
        share *= (n / share.sum(1))[:, None]
        theta = np.add.reduceat(share, starts) / total
    mixed = (theta[doc] * p).sum(1)
    return theta, np.add.reduceat(n * np.log(mixed), starts)


def infer(texts: list[str], p: np.ndarray) -> np.ndarray:
    """Language proportions ``(texts, languages)``; languages that the penalised likelihood leaves out are 0."""
    doc, bucket, n = _counts(texts)
    out = np.zeros((len(texts), p.shape[1]))
    bounds = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    # a quarter of a million trigrams at a time
    at = 0
    while at < len(bounds):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 250_000)))
        stop = bounds[end] if end < len(bounds) else len(doc)
        rows = slice(bounds[at], stop)
        _, local = np.unique(doc[rows], return_inverse=True)
        starts, c, q = bounds[at:end] - bounds[at], n[rows].astype(np.float32), p[bucket[rows]]
        k, m = p.shape[1], end - at
        theta, _ = _em(np.full((m, k), 1 / k, np.float32), q, local, starts, c, STEPS)
        order = np.argsort(-theta, 1, kind="stable")
        cost = PENALTY * np.log(np.add.reduceat(c, starts))
        best, chosen = np.full(m, -np.inf), np.zeros((m, k))
        # documents that still gain from a further language, and their rows
        live, mine, begin = np.arange(m), slice(None), starts
        for size in range(1, k + 1):
            few = np.zeros((len(live), k), np.float32)
            np.put_along_axis(few, order[live, :size], np.float32(1 / size), 1)
            here = np.repeat(np.arange(len(live)), np.diff(np.append(begin, len(c[mine]))))
            few, fit = _em(few, q[mine], here, begin, c[mine], STEPS if size > 1 else 0)
            value = fit - (size - 1) * cost[live]
            gains = value > best[live]
            live = live[gains]
            if not len(live):
                break
            best[live], chosen[live] = value[gains], few[gains]
            mine = np.isin(local, live)
            begin = np.searchsorted(local[mine], live)
        out[doc[bounds[at:end]]] = chosen
        at = end
    return out


def predict(
    docs: DataFrame,
    languages: list[str],
    p: np.ndarray,
    carry: list[str],
    names: tuple[str, str, str] = ("lang_pred", "score", "languages"),
) -> DataFrame:
    """Columns ``carry`` with the prediction, its score and the map of language to proportion, under ``names``."""
    if clash := {n.lower() for n in names} & {c.lower() for c in carry}:
        raise ValueError(f"carried columns bear names of results: {sorted(clash)}")
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.select(*carry).dtypes)
    # a text that is carried is read from there
    asked = [*carry] if "text" in carry else [*carry, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            theta = infer(texts, p) if languages else np.zeros((len(texts), 1))
            top = theta.argmax(1)
            spoken = [
                bool(languages) and letters[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any()
                for t in texts
            ]
            found = [languages[i] if ok else "und" for i, ok in zip(top.tolist(), spoken, strict=True)]
            score = np.where(spoken, np.clip(theta.max(1), 0, 1), 0.0)
            shares = [
                [(languages[i], float(row[i])) for i in np.flatnonzero(row)] if ok else []
                for row, ok in zip(theta, spoken, strict=True)
            ]
            columns = batch.columns[: len(carry)] + [
                pa.array(found, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(shares, pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*carry, *names])

    results = f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` map<string, double>"
    return docs.select(*asked).mapInArrow(run, f"{kept}, {results}")
