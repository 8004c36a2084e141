"""Quality scores from random-indexing word vectors and a small network.

Every word (letters, digits or a run of signs, as written) has a sparse random index vector: a few places with a sign,
both by its hash. A word's vector is the sum of the index vectors of the words around it over *all* documents, so words
in like company get like vectors. Words are known by a hash of ``WORD_BITS`` bits: the vectors are one table of fixed
size, summed up task by task and folded in a tree. A document is the mean of its words' vectors and of the products of
neighbouring ones, whatever its length; a network of one hidden layer, trained in numpy on a bounded sample of labelled documents (``SAMPLE``),
turns that into a logit, and a temperature fitted on the part of the sample kept from training makes it a probability.

Defined cases: null and empty texts, and those without a word, are scored like a document of no words; labels are
averaged by doc_id, an even split and null labels teach nothing, nor do documents without an id or with a held-out one;
a word of more than a million letters counts as several; with no label, or only one kind of label, every score is that
label's share (0.5 without any); equal texts score alike, so repeated rows do; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import folded, fresh, slices

WORD_BITS = 15
WORDS = 1 << WORD_BITS
DIM = 64
#: Places of a word's index vector.
PLACES = 4
#: Words on each side that give a word its vector.
REACH = 2
HIDDEN = 32
STEPS = 1500
BATCH = 256
#: Bound on the labelled documents that the network learns from, taken by hash; one in ``APART`` sets the temperature.
SAMPLE = 20_000
APART = 5
SEED = 23
RATE = 0.01
DECAY = 1e-3
#: Standard deviations from the centre beyond which a feature counts no further.
FARTHEST = 5.0
#: Characters of a text, and words, taken at a time; words whose vectors are looked up at a time.
STRETCH = 1 << 20
STRIDE = 1 << 15
REMEMBERED = 400_000
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Model(NamedTuple):
    """Word vectors, their centre and scale when pooled, the two layers and the temperature; or a constant score."""

    words: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every word's index vector; the last one, of no word, is a gap and weighs nothing."""
    rng = np.random.default_rng(SEED)
    place = rng.integers(0, DIM, (PLACES, WORDS + 1))
    sign = rng.choice(np.array([-1.0, 1.0]), (PLACES, WORDS + 1))
    sign[:, WORDS] = 0
    return place, sign


class _Hashes(dict):
    """Hash of each word, remembered; forgetting them changes nothing but time."""

    def __missing__(self, word: str) -> int:
        got = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (WORDS - 1)
        if len(self) > REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        """Hashes of all words; a long text is cut at blanks, so that its words need no list as long as the text."""
        parts, at = [np.zeros(0, np.int32)], 0
        while at < len(text):
            end = at + STRETCH
            if end < len(text):
                blank = text.rfind(" ", at, end)
                end = blank + 1 if blank > at else end
            words = _PARTS.findall(text, at, end)
            parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return np.concatenate(parts)


def _state(total: np.ndarray) -> bytes:
    """Sums of the words that have any, by number; whole numbers, so their order does not matter."""
    at = np.flatnonzero(total.any(1))
    whole = total[at].astype(np.int64)
    return zlib.compress(len(at).to_bytes(8, "little") + at.astype(np.int64).tobytes() + whole.tobytes(), 1)


def _summed(states: Iterator[bytes]) -> bytes:
    total = np.zeros((WORDS, DIM), np.int64)
    for s in states:
        _add(total, s)
    return _state(total)


def _add(total: np.ndarray, state: bytes) -> None:
    raw = np.frombuffer(zlib.decompress(state), np.int64)
    n = int(raw[0])
    total[raw[1 : n + 1]] += raw[n + 1 :].reshape(n, DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all word hashes, from the neighbours of every word of every document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = _index()
        hashes, gap = _Hashes(), np.full(REACH, WORDS, np.int32)
        total = np.zeros((WORDS + 1) * DIM)

        def near(words: np.ndarray) -> None:
            for step in range(1, REACH + 1):
                for at in range(0, len(words) - step, STRETCH):
                    left = words[at : at + STRETCH][: len(words) - step - at]
                    right = words[at + step : at + step + STRETCH]
                    for word, other in ((left, right), (right, left)):
                        base = word.astype(np.int64) * DIM
                        for k in range(PLACES):
                            total[:] += np.bincount(base + place[k][other], sign[k][other], len(total))

        any_rows = False
        for b in slices(batches, "text"):
            any_rows = True
            held = [x for t in b.column(0).to_pylist() if t for x in (hashes.of(t), gap)]
            if held:
                near(np.concatenate(held))
        if any_rows:
            state = _state(total.reshape(-1, DIM)[:WORDS])
            columns = [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "state"])

    found = folded(docs.select("text").mapInArrow(gather, "part long, state binary"), _summed, "word-vectors")
    total = np.zeros((WORDS, DIM), np.int64)
    if found is not None:
        _add(total, found)
    unit = _unit(total.astype(np.float64))
    known = total.any(1)
    if known.any():
        # what all words have in common says nothing
        unit[known] = _unit(unit[known] - unit[known].mean(0))
    return unit.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def pooled(words: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of a document's word vectors, and of the products of neighbouring ones: how far words repeat each other."""
    mean, product = np.zeros(DIM), np.zeros(DIM)
    for at in range(0, len(words), STRIDE):
        v = vectors[words[at : at + STRIDE + 1]]
        mean += v[:STRIDE].sum(0, np.float64)
        product += (v[1:] * v[:-1]).sum(0, np.float64)
    product /= max(len(words) - 1, 1)
    return np.concatenate([mean / max(len(words), 1), product, [product.sum()]])


def _features(text: str | None, hashes: _Hashes, vectors: np.ndarray) -> np.ndarray:
    return pooled(hashes.of(text or ""), vectors)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from the text of all ``docs`` and the ``quality`` of a bounded sample of those not held out."""
    vectors = word_vectors(docs)
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.filter(~held_out())
    n = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40))
    chosen = place < F.lit(min(1 << 40, (sample << 40) // max(n, 1)))
    marks = known.filter(chosen).groupBy("doc_id").agg(F.avg("quality").alias("mark")).filter("mark <> 0.5")
    # at most ``sample`` rows of two numbers, so the texts stay where they are
    marks = F.broadcast(marks.orderBy(place, "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(chosen & F.col("doc_id").isNotNull())
    rows = rows.join(marks, "doc_id")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            states = [_features(t, hashes, vectors).tobytes() for t in texts]
            digests = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            columns = [b.column(0), b.column(2), pa.array(digests, pa.int64()), pa.array(states, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "digest", "state"])

    found = rows.select("doc_id", "text", "mark").mapInArrow(pool, "doc_id long, mark double, digest long, state binary")
    once = found.dropDuplicates(["doc_id", "digest"]).orderBy(place, "doc_id", "digest").limit(sample).collect()
    x = np.array([np.frombuffer(r["state"]) for r in once]).reshape(-1, 2 * DIM + 1)
    y = np.array([float(r["mark"] > 0.5) for r in once])
    if not len(y) or y.min() == y.max():
        share = float(y[0]) if len(y) else 0.5
        none = np.zeros(0)
        return Model(vectors, none, none, none, none, none, 0.0, 1.0, share)
    return _network(vectors, x, y)


def _network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    apart = np.arange(len(y)) % APART == APART - 1
    if y[~apart].min() == y[~apart].max():
        apart[:] = False
    centre, scale = x[~apart].mean(0), x[~apart].std(0) + 1e-6
    model = Model(vectors, centre, scale, *_layers(_standard(x[~apart], centre, scale), y[~apart]), 1.0)
    if not apart.any():
        return model
    z, good = _logits(x[apart], model), y[apart].sum()
    # targets short of 0 and 1, as if each kind had been seen once more: a few right answers are no certainty
    target = np.where(y[apart] > 0, (good + 1) / (good + 2), 1 / (apart.sum() - good + 2))

    def loss(log_t: float) -> float:
        s = z / math.exp(log_t)
        return float(np.mean(np.logaddexp(0, s) - target * s))

    # the loss has one valley in the inverse temperature
    low, high, ratio = math.log(0.25), math.log(64.0), (math.sqrt(5) - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return model._replace(temperature=math.exp((low + high) / 2))


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -FARTHEST, FARTHEST)


def _layers(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights after ``STEPS`` steps of Adam on the logistic loss, with weight decay."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    p = [rng.standard_normal((d, HIDDEN)) / math.sqrt(d), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for step in range(1, STEPS + 1):
        some = rng.integers(0, len(x), BATCH)
        hidden = np.tanh(x[some] @ p[0] + p[1])
        slope = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - y[some]) / BATCH
        back = np.outer(slope, p[2]) * (1 - hidden * hidden)
        grads = [x[some].T @ back + DECAY * p[0], back.sum(0), hidden.T @ slope + DECAY * p[2], slope.sum(keepdims=True)]
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _logits(x: np.ndarray, model: Model) -> np.ndarray:
    hidden = np.tanh(_standard(x, model.centre, model.scale) @ model.w1 + model.b1)
    return hidden @ model.w2 + model.b2


def probabilities(x: np.ndarray, model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    return 1 / (1 + np.exp(-np.clip(_logits(x, model) / model.temperature, -700, 700)))


def score(docs: DataFrame, model: Model, carry: list[str], name: str = "score") -> DataFrame:
    """Columns ``carry`` and the probability that a document is of quality 1, under ``name``."""
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.select(*carry).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in slices(batches, b_text):
            x = np.array([_features(t, hashes, model.words) for t in b.column(b_text).to_pylist()])
            columns = [*b.columns[: len(carry)], pa.array(probabilities(x, model))]
            yield pa.RecordBatch.from_arrays(columns, [*carry, name])

    b_text = fresh("text", carry)
    return docs.select(*carry, F.col("text").alias(b_text)).mapInArrow(run, f"{kept}, `{name}` double")
