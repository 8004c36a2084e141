"""Hard negatives by a secondary-sort shuffle.

Anchors are scored against all rows in blocks, one matrix product a block pair. What a block pair reports is packed in
keys (anchor, descending score, positives first, id), dealt by anchor and sorted within each partition; a streaming
iterator then walks down an anchor's scores, opens the window of each positive that it meets and numbers the negatives
that fall in, so that it holds a few windows and never an anchor's rows.

A first walk over the blocks finds the positives (a block pair reports its best few, so the anchor's best are among
them); with the windows known, the second one reports for every window the first few negatives of the block pair.
Anything else could neither be a positive nor be among the first of a window.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do those with
a component of 2^24 or more after scaling (scores are exact below that); vectors of unlike lengths have no score; of
equal scores and ids the smaller label comes first; repeated rows are rows of their own, so a copy of an anchor is one
of its positives; an anchor without positives and an empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import map_groups, matrix
from bindery.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score as hundredths of the positive's, from and to.
WINDOW = (50, 95)
#: Anchors and rows of a block pair, and anchors scored at a time.
ANCHORS = 8192
ROWS = 8192
STRIDE = 512
LARGEST = 1 << 24


def usable_rows(vectors: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``row, id, label, v`` of the rows that take part; ``row`` tells rows of one id apart."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST)
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", fine), F.lit(False)))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", scaled.alias("v"))
    return materialize(rows.withColumn("dim", F.size("v")).filter("dim > 0"), "scored-vectors")


def block_pairs(rows: DataFrame, anchors: DataFrame, extra: list[str]) -> DataFrame:
    """Rows and anchors dealt to pairs of blocks: ``dim, i, j, anchor`` and the columns of both."""
    n_rows, n_anchors = rows.count(), anchors.count()
    down, across = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra]
    left = rows.select("row", "id", "label", "v", "dim", F.lit(False).alias("anchor"), *none, block(down).alias("i"), every(across).alias("j"))
    right = anchors.select("row", "id", "label", "v", "dim", F.lit(True).alias("anchor"), *extra, every(down).alias("i"), block(across).alias("j"))
    task = ["dim", "i", "j"]
    # by number: block pairs are small in bytes and large in work, so none should be put together
    return left.unionByName(right).repartition(2 * down * across, *task).sortWithinPartitions(*task)


class _Block:
    """One block pair: anchors and rows, scored a stride of anchors at a time."""

    def __init__(self, group: dict):
        is_anchor = np.asarray(group["anchor"].to_numpy(zero_copy_only=False), bool)
        self.group, self.anchor, self.other = group, np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
        self.row, self.id, self.label = (group[c].to_numpy() for c in ("row", "id", "label"))
        # rows in the order in which equal scores count, so that a stable sort by score is enough
        order = np.lexsort((self.row[self.other], self.label[self.other], self.id[self.other]))
        self.other = self.other[order]
        v = matrix(group["v"])
        # products are exact in double precision as long as no sum leaves its whole numbers
        exact = int(np.abs(v).max(initial=0)) ** 2 * v.shape[1] < 1 << 53
        self.v = v.astype(np.float64 if exact else np.int64)

    def __bool__(self) -> bool:
        return len(self.anchor) > 0 and len(self.other) > 0

    def strides(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors, their scores, and which rows have the anchor's label."""
        b = self.v[self.other]
        for at in range(0, len(self.anchor), STRIDE):
            some = self.anchor[at : at + STRIDE]
            scores = (self.v[some] @ b.T).astype(np.int64)
            yield some, scores, self.label[some][:, None] == self.label[self.other][None]


def _first(scores: np.ndarray, wanted: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the first ``count`` wanted columns of each row by falling score; equals keep their order."""
    low = np.iinfo(np.int64).min
    held = np.where(wanted, scores, low)
    i, j = [], []
    for _ in range(min(count, held.shape[1])):
        at = held.argmax(1)
        some = np.flatnonzero(held[np.arange(len(held)), at] != low)
        if not len(some):
            break
        i.append(some), j.append(at[some])
        held[some, at[some]] = low
    none = np.zeros(0, np.int64)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


PAIR = "anchor_row long, anchor_id long, score long, negative int, id long, label long, row long"


def _reported(block: _Block, anchor: np.ndarray, other: np.ndarray, score: np.ndarray, negative: int) -> dict:
    return {
        "anchor_row": block.row[anchor],
        "anchor_id": block.id[anchor],
        "score": score,
        "negative": np.full(len(score), negative, np.int32),
        "id": block.id[other],
        "label": block.label[other],
        "row": block.row[other],
    }


def _joined(parts: list[dict]) -> dict | None:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else None


def positives(rows: DataFrame, anchors: DataFrame, count: int = POSITIVES) -> DataFrame:
    """The first ``count`` other rows of each anchor's label, as pairs."""

    def best(group: dict) -> dict | None:
        block, parts = _Block(group), []
        if not block:
            return None
        for some, scores, same in block.strides():
            same &= block.row[some][:, None] != block.row[block.other][None]
            i, j = _first(scores, same, count)
            parts.append(_reported(block, some[i], block.other[j], scores[i, j], 0))
        return _joined(parts)

    found = map_groups(block_pairs(rows, anchors, []), ["dim", "i", "j"], best, PAIR)
    return materialize(_heads(found, count), "positives")


def _heads(pairs: DataFrame, count: int) -> DataFrame:
    """The first ``count`` pairs of each anchor in key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            chosen = []
            for n, anchor in enumerate(b.column(0).to_pylist()):
                at = at + 1 if anchor == last else 0
                last = anchor
                if at < count:
                    chosen.append(n)
            yield b.take(pa.array(chosen, pa.int64()))

    return _sorted(pairs).mapInArrow(run, PAIR)


def _sorted(pairs: DataFrame) -> DataFrame:
    """The secondary sort: dealt by anchor, in key order within each partition."""
    order = ["anchor_row", F.desc("score"), "negative", "id", "label", "row"]
    return pairs.repartition("anchor_row").sortWithinPartitions(*order)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    *,
    scale: int = SCALE,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, label, embedding``; ``is_anchor`` is a condition on ``vec_id``. For each of an anchor's
    first positives, the first negatives whose score lies in the window of the positive's.
    """
    low, high = window
    if not 0 <= low < high <= 100:  # a window has to open no later than its negatives come
        raise ValueError(f"not a window below the positive's score: {window}")
    rows = usable_rows(vectors, label, scale)
    anchors = rows.withColumn("vec_id", F.col("id")).filter(is_anchor).drop("vec_id")
    near = positives(rows, anchors, n_positives)
    windows = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list("score")).alias("windows"))
    ready = anchors.join(windows.withColumnRenamed("anchor_row", "row"), "row")

    def report(group: dict) -> dict | None:
        block, parts = _Block(group), []
        if not block:
            return None
        opened = group["windows"].to_pylist()
        for some, scores, same in block.strides():
            marks = np.full((len(some), n_positives), np.iinfo(np.int64).min // 128)
            for k, anchor in enumerate(some.tolist()):
                marks[k, : len(opened[anchor])] = opened[anchor]
            hits = set()
            for k in range(n_positives):
                p = marks[:, k : k + 1]
                wanted = ~same & (scores >= -(-low * p // 100)) & (scores <= high * p // 100)
                i, j = _first(scores, wanted, n_negatives)
                hits.update(zip(i.tolist(), j.tolist(), strict=True))
            i, j = (np.array(x, np.int64) for x in zip(*sorted(hits), strict=True)) if hits else (np.zeros(0, np.int64),) * 2
            parts.append(_reported(block, some[i], block.other[j], scores[i, j], 1))
        return _joined(parts)

    far = map_groups(block_pairs(rows, ready, ["windows"]), ["dim", "i", "j"], report, PAIR)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, windows = None, []
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        for b in batches:
            out = []
            for anchor, anchor_id, score, negative, other in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                if anchor != last:
                    last, windows = anchor, []
                if not negative:
                    windows.append([other, score, 0])
                    continue
                # windows whose lower end lies above this score are over, for scores only fall
                windows = [w for w in windows if 100 * score >= low * w[1] and w[2] < n_negatives]
                for w in windows:
                    if 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((anchor_id, w[0], w[2], other, w[1], score))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return _sorted(near.unionByName(far)).mapInArrow(emit, schema)
