"""Embedding near-duplicates by collision counting.

Vectors are projected on many random lines. Along each line, sorted, a window around every query vector takes in the
vectors that collide with it; a pair is verified in double precision when it has collided on so many lines as a pair
at the threshold does with probability ``RECALL`` (the count is the binomial quantile). Equal vectors are one row
from the start. Labels of up to ``CELL`` vectors are compared whole, whatever size others have. A larger label's vectors
are dealt by the signs of ``b`` further projections to cells of bounded size, in so many rounds that a pair at the
threshold shares a cell with probability ``SHARED``; with the collision count, it is found with ``RECALL`` or more in
all. Cells are cut in blocks; each pair is counted in the first round that brings it together.

Defined cases: a null label, a null vector, a zero vector and one with a null or non-finite component link with
nothing, as do vectors of different lengths; rows with a null vec_id are left unlinked; repeated rows count as
vectors of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import components, in_blocks, map_groups, matrix
from bindery.session import materialize

THRESHOLD = 0.93
LINES = 24
RECALL = 0.99
#: Probability that a pair at the threshold shares a cell; the collision count of 24 lines reaches 0.9936.
SHARED = 0.9995
CELL = 16_384
BLOCK = 1024
SEED = 5


def calibrate(threshold: float, lines: int, recall: float) -> tuple[float, int]:
    """Window half-width and the collision count that a pair at the threshold reaches with ``recall``."""
    width = math.sqrt(2 - 2 * threshold)
    p = math.erf(1 / math.sqrt(2))  # |N(0, width)| <= width
    reached = 0.0
    for count in range(lines, 0, -1):
        reached += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if reached >= recall:
            return width, count
    return width, 0


def cells(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Sign bits and rounds for a label of ``n`` vectors of one length."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(1 - recall) / math.log(1 - together))


@cache
def planes(count: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, 1]).standard_normal((count, dim))


def collide(a: np.ndarray, b: np.ndarray, lines: np.ndarray, width: float, least: int) -> np.ndarray:
    """Index pairs (row of a, row of b) whose projections lie within ``width`` on ``least`` lines or more."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    for h, q in zip((b @ lines).T, (a @ lines).T, strict=True):
        order = np.argsort(h, kind="stable")
        low = np.searchsorted(h[order], q - width)
        high = np.searchsorted(h[order], q + width, side="right")
        for i, (s, e) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            counts[i, order[s:e]] += 1
    return np.argwhere(counts >= least)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    width, least = calibrate(threshold, LINES, RECALL)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    usable &= F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("_ok", usable)
    same = ["label", "embedding"]
    distinct = rows.filter("_ok").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = materialize(distinct.withColumn("dim", F.size("embedding")), "distinct-vectors")
    sizes = distinct.groupBy("label", "dim").count().filter(F.col("count") > CELL)
    # at most one row for each CELL vectors
    split = {(r["label"], r["dim"]): cells(r["count"], threshold, SHARED) for r in sizes.collect()}

    def unit(group: dict) -> tuple[np.ndarray, np.ndarray]:
        x = matrix(group["embedding"]).astype(np.float64)
        return x, x / np.sqrt((x * x).sum(1))[:, None]

    def signs(label: int, vector: list[float]) -> list[int]:
        if (label, len(vector)) not in split:
            return [0]
        bits, rounds = split[label, len(vector)]
        on = (planes(rounds * bits, len(vector)) @ np.array(vector, np.float64) > 0).reshape(rounds, bits)
        return (on * (1 << np.arange(bits))).sum(1).tolist()

    def codes(batches):
        import pyarrow as pa

        for b in batches:
            labels, values = b.column("label").to_pylist(), b.column("embedding").to_pylist()
            cell = [signs(label, v) for label, v in zip(labels, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.list_(pa.int64()))], [*b.schema.names, "cells"])

    coded = distinct.mapInArrow(codes, "label int, embedding array<float>, rep long, copies long, dim int, cells array<long>")
    spread = coded.select("*", F.posexplode("cells").alias("round", "cell"))
    dealt = in_blocks(spread, ["label", "dim", "round", "cell"], "rep", BLOCK)

    def verify(g: dict) -> dict | None:
        x, u = unit(g)
        rep, copies, cell = g["rep"].to_numpy(), g["copies"].to_numpy(), matrix(g["cells"])
        block, i, j, turn = (g[n].to_numpy() for n in ("_c", "_i", "_j", "round"))
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        if not len(left) or not len(right):
            return None
        lines = np.random.default_rng([SEED, 2]).standard_normal((x.shape[1], LINES))
        pairs = collide(u[left], u[right], lines, width, least)
        a, b = left[pairs[:, 0]], right[pairs[:, 1]]
        if i[0] == j[0]:
            a, b = a[a < b], b[a < b]
        if turn[0]:
            new = ~(cell[a][:, : turn[0]] == cell[b][:, : turn[0]]).any(1)
            a, b = a[new], b[new]
        norm = np.sqrt((x * x).sum(1))
        near = np.zeros(len(a), bool)
        for at in range(0, len(a), 50_000):
            s = slice(at, at + 50_000)
            near[s] = np.einsum("ij,ij->i", x[a[s]], x[b[s]]) / (norm[a[s]] * norm[b[s]]) >= threshold
        a, b = a[near], b[near]
        n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        # smallest linked row of each, until nothing changes
        low = np.arange(len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.empty_like(order)
        rank[order] = low
        root = rank.copy()
        while True:
            was = root.copy()
            np.minimum.at(root, a, was[b])
            np.minimum.at(root, b, was[a])
            root = root[order[root]]
            if (was == root).all():
                break
        at = n > 0
        return {"rep": rep[at], "links": n[at].astype(np.int64), "root": rep[order[root]][at]}

    task = ["label", "dim", "round", "cell", "_i", "_j"]
    found = materialize(map_groups(dealt, task, verify, "rep long, links long, root long"), "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
    whole = distinct.join(linked, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    whole = whole.select(*same, "rep", "copies", "links", "component")
    out = rows.join(whole.withColumn("_ok", F.lit(True)), [*same, "_ok"], "left")
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    component = F.coalesce("component", "rep", "vec_id")
    return out.select(
        "vec_id",
        n_links.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
