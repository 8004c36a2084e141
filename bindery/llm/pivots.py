"""SimHash near-duplicates with pivot distance tables.

Every fingerprint's Hamming distances to reference fingerprints (pivots) are computed beforehand. Pivots come in
tables; those of one table look at the same few bits, so two fingerprints that agree on these bits have equal
distances to all of them, and equal distances put them in one bucket. With ``radius + spare`` groups of bits and
every choice of ``spare`` groups as a table, no pair within a small radius escapes. For wide radii (long
fingerprints) tables take random bits and their number is calibrated to the recall wanted at the radius. Within a
bucket, pairs whose distances to the general pivots differ by more than the radius at any one are discarded (the
triangle inequality) and the rest are verified bit by bit. Rows already in one component are not compared again,
which keeps large groups of near copies from costing the square of their size; large buckets are cut in blocks.

Equal fingerprints are one row from the start, so a group of exact copies costs as much as one document.

Defined cases: null and empty texts have the zero fingerprint and link like any other; fewer words than a shingle
are one shingle; documents with a null doc_id are compared, but a component takes the smallest id that is not null;
repeated rows share everything; an empty table gives no rows; other columns are ignored by :func:`fingerprints` and
:func:`near_duplicates` and kept by :func:`keep_first`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import components, in_blocks, map_groups, matrix, slices
from bindery.session import materialize

SEED = 42
SPARE = 2
PIVOTS = 8
TABLE_PIVOTS = 24
BLOCK = 4096
#: Texts of a block when shingle sets are compared.
TEXTS = 1024
#: Buckets up to this size are compared in one step.
SMALL = 128
RECALL = 0.97
#: Standard deviations beyond the expected distance: the radius that tables are made for, and the farthest candidate.
BEYOND, FARTHEST = 2, 4
#: Tables looked at before what they connect is taken as one, and how many times more each time after that.
FIRST, MORE = 8, 8
#: Shingles whose bits are counted at a time.
CHUNK = 20_000


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    begins = [0, *(e + 1 for e in ends[: -size])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[b:e], SEED) for b, e in zip(begins, ends[size - 1 :], strict=True)], np.uint64)


def simhash(text: str, size: int, words: int) -> np.ndarray:
    """``words`` 64-bit words; a bit is 1 if set in over half of the shingle hashes (mixed anew for each word)."""
    return _majority(_shingle_hashes(text, size), words)


def _majority(hashes: np.ndarray, words: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(words, np.uint64)
    votes = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        for w in range(words):
            if w:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * w)
                h ^= h >> np.uint64(32)
            votes[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return np.packbits((2 * votes > len(hashes)).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1) -> DataFrame:
    """``doc_id, fp`` (array of ``words`` longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            if b.num_rows:
                fps = np.stack([simhash(t or "", size, words) for t in b.column(1).to_pylist()])
                ends = np.arange(0, fps.size + 1, words, dtype=np.int32)
                fp = pa.ListArray.from_arrays(pa.array(ends), pa.array(fps.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp array<long>")


def _distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p).sum(1, np.int16) for p in pivots], 1)


def tables(radius: int, words: int, n: int, recall: float = RECALL) -> list[np.ndarray]:
    """Bit masks of the pivot tables.

    A radius up to 3 gets every choice of ``SPARE`` out of ``radius + SPARE`` groups of bits: all pairs are found.
    A wider one gets random bits, so many a table that buckets of unlike fingerprints stay near ``SMALL`` at ``n`` rows,
    and so many tables that a pair just at the radius is found with probability ``recall``.
    """
    bits = 64 * words
    rng = np.random.default_rng(7)
    order = rng.permutation(bits)
    if radius <= 3:
        groups = np.array_split(order, radius + SPARE)
        chosen = [np.concatenate(c) for c in itertools.combinations(groups, SPARE)]
    else:
        k = max(8, math.ceil(math.log2(max(n, 2))) - 6)
        hit = math.comb(bits - radius, k) / math.comb(bits, k)
        count = math.ceil(math.log(1 - recall) / math.log(1 - hit))
        chosen = [rng.choice(bits, k, replace=False) for _ in range(count)]
    masks = np.zeros((len(chosen), bits), np.uint8)
    for mask, at in zip(masks, chosen, strict=True):
        mask[at] = 1
    return list(np.packbits(masks, axis=1, bitorder="little").view("<u8"))


def _linked(fps: np.ndarray, far: np.ndarray, radius: int, known: np.ndarray) -> np.ndarray:
    """A label for each row, equal for rows connected through pairs within the radius or equal in ``known``."""
    n = len(fps)
    _, first, group = np.unique(known, return_index=True, return_inverse=True)
    label = first[group]
    if n <= SMALL:
        near = np.abs(far[:, None] - far[None]).max(2) <= radius
        a, b = np.nonzero(np.triu(near & (label[:, None] != label[None]), 1))
        hit = np.bitwise_count(fps[a] ^ fps[b]).sum(1) <= radius
        for i, j in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
        return label
    parts = len(first)
    for i in range(n - 1):
        if parts == 1:
            break
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(other):
            continue
        other = other[np.abs(far[other] - far[i]).max(1) <= radius]
        hit = other[np.bitwise_count(fps[other] ^ fps[i]).sum(1) <= radius]
        for old in np.unique(label[hit]):
            if old != label[i]:
                label[label == old] = label[i]
                parts -= 1
    return label


def links(distinct: DataFrame, radius: int, words: int, reach: int | None = None) -> DataFrame:
    """Edges ``a, b`` that connect the ids of ``distinct(id, fp)`` whose fingerprints lie within the radius.

    With ``reach``, rows that meet in a table made for the radius are linked up to this larger distance.
    Each task reports one edge per row to its group's first row: enough for components, and linear in its rows.
    Many tables are taken in rounds. What one round connects is one component in the next, which reports edges between
    components only: rows that meet in every table, as a large group of near copies does, do not give an edge for each.
    """
    n = distinct.count()
    masks = tables(radius, words, n)
    rng = np.random.default_rng(11)
    table_pivots = [rng.integers(0, 1 << 63, (TABLE_PIVOTS, words), np.uint64) * np.uint64(2) for _ in masks]
    general = rng.integers(0, 1 << 63, (PIVOTS, words), np.uint64) * np.uint64(2)
    primes = rng.integers(1, 1 << 62, TABLE_PIVOTS, np.int64) | 1

    names = ["id", "fp", "known", "t", "key"]

    def connect(g: dict) -> dict | None:
        ids = g["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        known, fps = g["known"].to_numpy()[order], matrix(g["fp"])[order].view(np.uint64)
        first = known[_linked(fps, _distances(fps, general), radius if reach is None else reach, known)]
        at = known != first
        return {"a": known[at], "b": first[at]}

    def met(rows: DataFrame, some: range) -> DataFrame:
        def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                fps = matrix(b.column(1)).view(np.uint64)
                for t in some:
                    distances = _distances(fps & masks[t], table_pivots[t] & masks[t]).astype(np.int64)
                    key = (distances * primes).sum(1)
                    table = pa.array(np.full(len(key), t, np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns, table, pa.array(key)], names)

        tabled = rows.mapInArrow(tabulate, "id long, fp array<long>, known long, t int, key long")
        dealt = in_blocks(tabled, ["t", "key"], "id", BLOCK)
        return map_groups(dealt, ["t", "key", "_i", "_j"], connect, "a long, b long").distinct()

    begin, end = 0, min(FIRST, len(masks))
    edges = met(distinct.select("id", "fp", F.col("id").alias("known")), range(end))
    while end < len(masks):
        known = components(edges, "table-links")
        begin, end = end, min(end * MORE, len(masks))
        rows = distinct.join(known, distinct.id == known.node, "left")
        rows = rows.select("id", "fp", F.coalesce("component", "id").alias("known"))
        # a row is linked to its component, components to each other
        stars = known.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        edges = materialize(stars.unionByName(met(rows, range(begin, end))), "table-edges")
    return edges


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, words: int = 1) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    prints = materialize(fingerprints(docs, size, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # fingerprints of documents without an id link others, so all are linked by a number of their own
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-fingerprints")
    found = components(links(distinct.select("id", "fp"), radius, words), "pivot-links")
    labels = distinct.join(found, distinct.id == found.node, "left")
    least = labels.filter("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    labels = labels.join(least, "component", "left")
    labels = labels.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def radius_for(similarity: float, words: int, beyond: float = 0) -> int:
    """Expected Hamming distance of equally long shingle sets of this Jaccard similarity.

    ``beyond`` standard deviations are added; sets of unlike length lie closer than that.
    """
    bits, p = 64 * words, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + beyond * math.sqrt(bits * p * (1 - p)))


def _shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(_shingle_hashes(text or "", size))


def set_fingerprints(rows: DataFrame, size: int, words: int) -> DataFrame:
    """``k1, k2, doc_id, d1, d2, fp`` of ``rows(k1, k2, doc_id, text)``.

    Every shingle votes once, however often it stands in the text, as it counts once for similarity; ``d1, d2`` is a
    digest of the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            if b.num_rows:
                sets = [_shingle_set(t, size) for t in b.column(3).to_pylist()]
                fps = np.stack([_majority(s, words) for s in sets])
                ends = np.arange(0, fps.size + 1, words, dtype=np.int32)
                fp = pa.ListArray.from_arrays(pa.array(ends), pa.array(fps.ravel().view(np.int64)))
                seeds = (SEED, SEED + 1)
                d = [np.array([xxhash.xxh64_intdigest(s.tobytes(), x) for s in sets], np.uint64) for x in seeds]
                digests = [pa.array(x.view(np.int64)) for x in d]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *digests, fp], ["k1", "k2", "doc_id", "d1", "d2", "fp"])

    rows = rows.select("k1", "k2", "doc_id", "text")
    return rows.mapInArrow(run, "k1 long, k2 long, doc_id long, d1 long, d2 long, fp array<long>")


def _alike(sets: list[np.ndarray], fps: np.ndarray, similarity: float, reach: int) -> np.ndarray:
    """A label for each set, equal for sets connected through pairs of this Jaccard similarity or more."""
    n = parts = len(sets)
    label, sizes = np.arange(n), np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    mark = np.zeros(len(flat), bool)
    for i in range(n - 1):
        if parts == 1:
            break
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        other = other[np.minimum(sizes[other], sizes[i]) >= similarity * np.maximum(sizes[other], sizes[i]) - 1e-9]
        other = other[np.bitwise_count(fps[other] ^ fps[i]).sum(1) <= reach]
        if not len(other):
            continue
        mine = flat[begins[i] : begins[i] + sizes[i]]
        mark[mine] = True
        common = np.array([np.count_nonzero(mark[flat[b : b + k]]) for b, k in zip(begins[other], sizes[other])])
        mark[mine] = False
        hit = other[common >= similarity * (sizes[other] + sizes[i] - common) - 1e-9]
        for old in np.unique(label[hit]):
            if old != label[i]:
                label[label == old] = label[i]
                parts -= 1
    return label


def from_leader(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """``component, id, fp, text, leader, d, near``: exact Jaccard distance to the component's ``leader``.

    ``rows(component, id, fp, text, leader, n)`` are dealt in blocks; each block gets one copy of its leader's text and
    keeps one set of shingles besides the text it looks at, so the work is linear in the rows of a component.
    """
    columns = ["component", "id", "fp", "text", "leader"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(0, np.uint64)
        for b in slices(batches, "text"):
            leads = np.asarray(b.column("_lead").to_pylist(), bool)
            d, near = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for i, (lead, text) in enumerate(zip(leads, b.column("text").to_pylist(), strict=True)):
                mine = _shingle_set(text, size)
                if lead:
                    base = mine
                    continue
                common = len(np.intersect1d(base, mine, assume_unique=True))
                union = len(base) + len(mine) - common
                d[i], near[i] = 1 - common / max(union, 1), common >= similarity * union - 1e-9
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(d), pa.array(near)], names)
            yield out.filter(pa.array(~leads))

    names = [*columns, "d", "near"]
    cut = rows.withColumn("_blocks", F.ceil(F.col("n") / TEXTS).cast("int"))
    own = cut.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).withColumn("_lead", F.lit(False))
    lead = cut.filter("id = leader").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = own.unionByName(lead.withColumn("_lead", F.lit(True))).select(*columns, "_b", "_lead")
    # a block's leader comes before its rows
    dealt = dealt.repartition("component", "_b").sortWithinPartitions("component", "_b", F.desc("_lead"))
    return dealt.mapInArrow(
        measure, "component long, id long, fp array<long>, text string, leader long, d double, near boolean"
    )


def similar(texts: DataFrame, size: int, similarity: float, reach: int) -> DataFrame:
    """Edges ``a, b`` that connect the ids of ``texts(component, id, fp, text)`` which are similar in a component.

    A component of more than ``TEXTS`` rows is first measured against a leader, its smallest id. Jaccard distance is a
    metric: rows near the leader are connected through it, and a row further from it than twice the radius is near none
    of them. So the near rows are settled and leave, but for those within the radius of the nearest row that is
    neither. This is repeated for what stays while that halves; a group of near copies takes one round and linear work.
    The rest is compared pair by pair, in blocks, up to ``reach`` bits between fingerprints.
    """
    columns, radius = ["component", "id", "fp", "text"], 1 - similarity + 1e-9
    active, settled, rest, was = texts, [], [], None
    while True:
        sizes = active.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("leader"))
        sizes = materialize(sizes.filter(F.col("n") > TEXTS), "large-components")
        n = sizes.agg(F.sum("n")).first()[0]
        if n is None or was is not None and 2 * n > was:
            break
        was = n
        rest.append(active.join(sizes, "component", "left_anti").select(*columns))
        measured = materialize(from_leader(active.join(sizes, "component"), size, similarity), "leader-distances")
        settled.append(measured.filter("near and id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
        between = measured.filter(~F.col("near") & (F.col("d") <= 2 * radius))
        between = between.groupBy("component").agg(F.min("d").alias("closest"))
        stays = ~F.col("near") | F.coalesce(F.col("d") >= F.col("closest") - radius, F.lit(False))
        active = measured.join(between, "component", "left").filter(stays).select(*columns)
    rest.append(active)

    def connect(g: dict) -> dict | None:
        ids = g["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, fps = ids[order], matrix(g["fp"])[order].view(np.uint64)
        held = g["text"].to_pylist()
        first = ids[_alike([_shingle_set(held[i], size) for i in order.tolist()], fps, similarity, reach)]
        at = ids != first
        return {"a": ids[at], "b": first[at]}

    # a component's rows all left in the same round
    dealt = in_blocks(reduce(DataFrame.unionByName, rest), ["component"], "id", TEXTS)
    compared = map_groups(dealt, ["component", "_i", "_j"], connect, "a long, b long").distinct()
    return reduce(DataFrame.unionByName, settled, compared)


def keep_first(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """All columns of one document of each group of near-duplicates: the one with the smallest doc_id.

    Groups are connected through pairs whose shingle sets have this Jaccard similarity or more. Fingerprints of
    ``words`` times 64 bits only say which pairs are compared: those up to ``FARTHEST`` standard deviations beyond
    the expected distance that meet in a table. Candidate groups are then compared by their texts, large ones first
    with one leader after the other (:func:`similar`).

    A row is known by doc_id and text: unlike texts without a doc_id, or under one, each stay, and of rows equal in both
    one stays. A document without a doc_id stays only where no near-duplicate has one.
    """
    whole = (F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    rows = docs.withColumn("_k1", F.xxhash64(F.lit(1), *whole)).withColumn("_k2", F.xxhash64(F.lit(2), *whole))
    keyed = rows.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "doc_id", "text")
    prints = materialize(set_fingerprints(keyed, size, words), "set-fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    units = prints.groupBy("d1", "d2", "fp").agg(F.min(order).alias("first"))
    units = units.select(F.monotonically_increasing_id().alias("id"), "fp", "first", "first.k1", "first.k2")
    units = materialize(units, "shingle-sets")
    reach = radius_for(similarity, words, FARTHEST)
    met = links(units.select("id", "fp"), radius_for(similarity, words, BEYOND), words, reach)
    likely = components(met, "pivot-links")
    members = units.join(likely, units.id == likely.node).select("component", "id", "fp", "k1", "k2")
    texts = keyed.select("k1", "k2", "text").join(members, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    texts = materialize(texts.select("component", "id", "fp", "text"), "likely-texts")
    found = components(similar(texts, size, similarity, reach), "near-duplicates")
    groups = units.join(found, units.id == found.node, "left")
    groups = groups.groupBy(F.coalesce("component", "id").alias("group")).agg(F.min("first").alias("first"))
    stays = groups.select(F.col("first.k1").alias("_k1"), F.col("first.k2").alias("_k2"))
    kept = rows.join(stays, ["_k1", "_k2"], "left_semi")
    # rows equal in doc_id and text: only these few are numbered
    first = Window.partitionBy("_k1", "_k2").orderBy(F.to_json(F.struct(*docs.drop("text").columns)))
    return kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*docs.columns)
