"""Exact repeated-passage removal by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes picks triggers: in every ``WINDOW``-byte string the trigger is the least hash
(the first of equals), so equal strings carry their trigger at the same place. Each stretch of strings with one
trigger is a phrase: the bytes of all of them, overlapping the next phrase as prefix-free parsing asks, so that no
string spans two phrases and the order of the parse beyond a phrase never matters for strings of this length. The
phrases are the dictionary, kept as hashes with the smallest doc_id; a document is its parse, the phrases in turn.

* A phrase that a smaller doc_id holds whole is repeated as a whole: that settles long repeats at one entry for
  some fourteen bytes.
* A phrase whose trigger other phrases share may be repeated in part. Only of these the dictionary's suffixes
  (its strings) are sorted out, by grouping equal ones and taking the smallest doc_id.

Entries are packed in binary blocks per hash bucket, combined within a batch before they are shuffled: a batch sends
at most one entry per trigger, so a passage of a third of all documents does not meet in one task one document at
a time. Buckets are sized by the corpus.

Defined cases: null and empty texts have 0 bytes and lose none; texts shorter than a window neither lose nor cause
anything; nor do documents with a null doc_id; rows with one doc_id do not affect each other; a text that repeats
within itself is not touched by that; an empty table gives no rows; other columns are ignored by :func:`repeats`
and kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import slices
from bindery.session import materialize

WINDOW = 50
TRIGGER = 24
#: Bytes of text per bucket of dictionary entries.
BUCKET_TEXT = 32 << 20
#: Bytes of texts whose phrases are combined before they are sent.
COMBINED = 16 << 20
#: Bytes of a text parsed at a time.
STRETCH = 1 << 21
_PLACE = np.uint64((1 << 22) - 1)
_SPAN = WINDOW - TRIGGER + 1
_ENTRY = np.dtype([("phrase", "<u8"), ("trigger", "<u4")])
_BYTES = np.random.default_rng(3).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Parse:
    """Phrases of one stretch: trigger hash, phrase hash, first and last string start."""

    def __init__(self, data: bytes):
        b = _BYTES[np.frombuffer(data, np.uint8)]
        two = b[:-1] * _MUL[0] + b[1:]
        four = two[:-2] * _MUL[1] + two[2:]
        eight = four[:-4] * _MUL[2] + four[4:]
        sixteen = eight[:-8] * _MUL[3] + eight[8:]
        self.two, self.rolling = two, _mix(sixteen[:-8] * _MUL[4] + eight[16:])
        key = (self.rolling & ~_PLACE) | np.arange(len(self.rolling), dtype=np.uint64)
        low = np.minimum(key[:-1], key[1:])
        for step in (2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: len(low) - (_SPAN - 16)], low[_SPAN - 16 :])
        place = (low & _PLACE).astype(np.int64)
        self.first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.last = np.append(self.first[1:], len(place)) - 1
        self.trigger = self.rolling[place[self.first]]
        ends = (self.last - self.first).astype(np.uint64)
        self.phrase = _mix(self.strings(self.first) * _MUL[1] + self.strings(self.last) * _MUL[2] + ends)

    def strings(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that start there."""
        return _mix(
            self.rolling[at] * _MUL[2] + self.rolling[at + TRIGGER] * _MUL[3] + self.two[at + 2 * TRIGGER]
        )


def parses(data: bytes) -> Iterator[tuple[int, Parse]]:
    """Stretches of a text, overlapping by a window less one byte, with their offsets."""
    for at in range(0, max(len(data) - WINDOW + 1, 0), STRETCH):
        yield at, Parse(data[at : at + STRETCH + WINDOW - 1])


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _phrases(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """``doc, trigger, phrase`` of a batch of documents; a document's equal phrases once."""
    ids, triggers, phrases = [], [], []
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        got = [(p.phrase, p.trigger) for _, p in parses(_utf8(text))] if doc is not None else []
        if got:
            phrase, at = np.unique(np.concatenate([g[0] for g in got]), return_index=True)
            phrases.append(phrase), triggers.append(np.concatenate([g[1] for g in got])[at])
            ids.append(np.full(len(phrase), doc, np.int64))
    return _joined(ids, triggers, phrases)


def _strings(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """``doc, trigger, string`` of the strings in the phrases (third column) to be looked into."""
    ids, triggers, strings = [], [], []
    for doc, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        known = _set(parts)
        for _, p in parses(_utf8(text)):
            at = np.flatnonzero(_within(p.phrase, known))
            n = p.last[at] - p.first[at] + 1
            start = np.repeat(p.first[at] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
            string, one = np.unique(p.strings(start), return_index=True)
            strings.append(string), triggers.append(np.repeat(p.trigger[at], n)[one])
            ids.append(np.full(len(string), doc, np.int64))
    return _joined(ids, triggers, strings)


def _joined(*columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    kinds = (np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True))


def _blocks(doc: np.ndarray, trigger: np.ndarray, entry: np.ndarray, buckets: int, whole: bool) -> Iterator[tuple]:
    """Rows ``bucket, docs, counts, entries, doc_id, kind, found`` of a batch's phrases, or of single strings."""
    if not len(doc):
        return
    order = np.lexsort((doc, entry, trigger))
    doc, trigger, entry = doc[order], trigger[order], entry[order]
    head = np.append(True, (entry[1:] != entry[:-1]) | (trigger[1:] != trigger[:-1]))
    later = doc > doc[np.flatnonzero(head)][np.cumsum(head) - 1]
    yield from _replies(doc[later], entry[later], 1, buckets)
    doc, trigger, entry = doc[head], trigger[head], entry[head]
    if whole:
        start = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
        size = np.diff(np.append(start, len(doc)))
        mixed = (size > 1) & (np.maximum.reduceat(doc, start) > np.minimum.reduceat(doc, start))
        several = np.repeat(mixed, size)
        yield from _replies(doc[several], entry[several], 2, buckets)
        # of a trigger with several phrases here one entry goes on, to say so (phrase 0)
        entry = np.where(several, np.uint64(0), entry)
        goes = ~several
        goes[start] = True
        doc, trigger, entry = doc[goes], trigger[goes], entry[goes]
    bucket = ((trigger >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket))
    doc, bucket = doc[order], bucket[order]
    entries = np.empty(len(doc), _ENTRY)
    entries["phrase"], entries["trigger"] = entry[order], trigger[order].astype(np.uint32)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        docs, counts = np.unique(doc[s:e], return_counts=True)
        yield int(bucket[s]), docs.tobytes(), counts.astype("<i4").tobytes(), entries[s:e].tobytes(), None, 0, None


def _replies(doc: np.ndarray, phrase: np.ndarray, kind: int, buckets: int) -> Iterator[tuple]:
    """One row per document with the phrases found: kind 1 repeated whole, kind 2 perhaps in part."""
    order = np.argsort(doc, kind="stable")
    doc, phrase = doc[order], phrase[order]
    if not len(doc):
        return
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist()
    for s, e in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        bucket = int(_mix(doc[s : s + 1].view(np.uint64))[0] % np.uint64(buckets))
        yield bucket, None, None, None, int(doc[s]), kind, phrase[s:e].tobytes()


_BLOCK_COLUMNS = {
    "bucket": pa.int64(), "docs": pa.binary(), "counts": pa.binary(), "entries": pa.binary(),
    "doc_id": pa.int64(), "kind": pa.int32(), "found": pa.binary(),
}
_BLOCK = "bucket long, docs binary, counts binary, entries binary, doc_id long, kind int, found binary"


def _batches(rows: Iterator[tuple], columns: dict) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), columns.values(), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, list(columns))

    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 16
        if size > 4 << 20:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _settled(rows: DataFrame, gather, buckets: int, whole: bool) -> DataFrame:
    """``doc_id, whole, parts``: entries that a smaller doc_id holds, and of phrases those to be looked into.

    What the buckets find goes back in blocks of documents, so that no row is made per document and bucket.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((r for b in slices(batches, "text", COMBINED) for r in _blocks(*gather(b), buckets, whole)), _BLOCK_COLUMNS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, entries = [], []
        found: dict[int, list] = {1: [], 2: []}
        for b in batches:
            for row in b.to_pylist():
                if row["kind"]:
                    phrase = np.frombuffer(row["found"], "<u8")
                    found[row["kind"]].append((np.full(len(phrase), row["doc_id"], np.int64), phrase))
                else:
                    counts = np.frombuffer(row["counts"], "<i4")
                    ids.append(np.repeat(np.frombuffer(row["docs"], np.int64), counts))
                    entries.append(np.frombuffer(row["entries"], _ENTRY))
        if ids:
            doc, entry = np.concatenate(ids), np.concatenate(entries)
            ids.clear(), entries.clear()
            order = np.lexsort((doc, entry["phrase"], entry["trigger"]))
            doc, phrase, trigger = doc[order], entry["phrase"][order], entry["trigger"][order]
            del entry, order
            head = np.append(True, (phrase[1:] != phrase[:-1]) | (trigger[1:] != trigger[:-1]))
            later = doc > doc[np.flatnonzero(head)][np.cumsum(head) - 1]
            if whole:
                named = phrase != 0
                later &= named
                start = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
                size = np.diff(np.append(start, len(doc)))
                # a trigger with two phrases, of different documents, or said to have several
                several = np.maximum.reduceat(doc, start) > np.minimum.reduceat(doc, start)
                several &= np.add.reduceat(head.astype(np.int64), start) > 1
                several |= ~np.logical_and.reduceat(named, start)
                part = named & head & np.repeat(several, size)
                found[2].append((doc[part], phrase[part]))
            found[1].append((doc[later], phrase[later]))
        yield from _batches(_dealt(found, buckets), _FOUND_COLUMNS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {1: [], 2: []}
        for b in batches:
            for row in b.to_pylist():
                docs = np.repeat(np.frombuffer(row["docs"], np.int64), np.frombuffer(row["counts"], "<i4"))
                found[row["kind"]].append((docs, np.frombuffer(row["entries"], "<u8")))
        kinds: list[dict[int, bytes]] = []
        for pairs in found.values():
            of: dict[int, bytes] = {}
            if pairs:
                doc, phrase = (np.concatenate(x) for x in zip(*pairs, strict=True))
                order = np.argsort(doc, kind="stable")
                doc, phrase = doc[order], phrase[order]
                cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist() if len(doc) else []
                for s, e in zip(cuts, [*cuts[1:], len(doc)] if cuts else [], strict=True):
                    of[int(doc[s])] = phrase[s:e].tobytes()
            kinds.append(of)
        rows = ((doc, kinds[0].get(doc), kinds[1].get(doc)) for doc in sorted(kinds[0].keys() | kinds[1].keys()))
        yield from _batches(rows, {"doc_id": pa.int64(), "whole": pa.binary(), "parts": pa.binary()})

    settled = rows.mapInArrow(block, _BLOCK).repartition(buckets, "bucket").mapInArrow(settle, _FOUND)
    return settled.repartition(buckets, "bucket").mapInArrow(merge, "doc_id long, whole binary, parts binary")


_FOUND_COLUMNS = {
    "bucket": pa.int64(), "kind": pa.int32(), "docs": pa.binary(), "counts": pa.binary(), "entries": pa.binary()
}
_FOUND = "bucket long, kind int, docs binary, counts binary, entries binary"


def _dealt(found: dict[int, list], buckets: int) -> Iterator[tuple]:
    """Findings in one block per bucket of documents and kind."""
    for kind, pairs in found.items():
        if not pairs:
            continue
        doc, phrase = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(doc):
            continue
        bucket = (_mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        doc, phrase, bucket = doc[order], phrase[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(doc)], strict=True):
            docs, counts = np.unique(doc[s:e], return_counts=True)
            yield int(bucket[s]), kind, docs.tobytes(), counts.astype("<i4").tobytes(), phrase[s:e].tobytes()


def _set(blob: bytes | None) -> np.ndarray:
    return np.unique(np.frombuffer(blob or b"", "<u8"))


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def removed(data: bytes, whole: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which bytes go: of phrases repeated whole, and of single strings found repeated."""
    edge = np.zeros(len(data) + 1, np.int64)
    for at, p in parses(data):
        all_of = _within(p.phrase, whole)
        np.add.at(edge, at + p.first[all_of], 1)
        np.add.at(edge, at + p.last[all_of] + WINDOW, -1)
        if len(repeated):
            start = np.arange(p.last[-1] + 1)
            hit = start[_within(p.strings(start), repeated)]
            np.add.at(edge, at + hit, 1)
            np.add.at(edge, at + hit + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _found(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``whole`` and ``repeated``.

    Texts are joined twice, by doc_id both times and in one query, so that their exchange can be used again.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // BUCKET_TEXT))

    phrases = materialize(_settled(docs.select("doc_id", "text"), _phrases, buckets, True), "phrases")
    numbered = docs.filter("doc_id is not null")
    known = numbered.join(phrases, "doc_id", "left")
    asked = known.filter("parts is not null").select("doc_id", "text", "parts")
    strings = _settled(asked, _strings, buckets, False).select("doc_id", F.col("whole").alias("repeated"))
    out = known.drop("parts").join(strings, "doc_id", "left").select(*docs.columns, "whole", "repeated")
    none = F.lit(None).cast("binary")
    return out.unionByName(docs.filter("doc_id is null").withColumns({"whole": none, "repeated": none}))


def _spans(text: str | None, whole, repeated) -> tuple[bytes, np.ndarray]:
    data = _utf8(text)
    if not whole and not repeated:
        return data, np.zeros(len(data), bool)
    return data, removed(data, _set(whole), _set(repeated))


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for text, whole, repeated in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                data, gone = _spans(text, whole, repeated)
                kept = data if not gone.any() else np.frombuffer(data, np.uint8)[~gone].tobytes()
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
            if rows:
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    rows = _found(docs.select("doc_id", "text")).select("doc_id", "text", "whole", "repeated")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns, with repeated passages cut from ``text``.

    A character goes only when all of its bytes do, so the text stays well formed.
    """
    columns = docs.columns
    # columns get plain names on the way, so that the caller's may be called anything
    plain = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(columns)]
    rows = _found(docs.toDF(*plain)).select(*plain, "whole", "repeated")
    at = plain.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for text, *found in zip(*(b.column(n).to_pylist() for n in ("text", "whole", "repeated")), strict=True):
                data, gone = _spans(text, *found)
                if gone.any():
                    raw = np.frombuffer(data, np.uint8)
                    lead = (raw & 0xC0) != 0x80
                    char = np.cumsum(lead) - 1
                    all_gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))
                    text = raw[~all_gone[char]].tobytes().decode("utf-8", "replace")
                out.append(text)
            kept = list(b.columns)[:-2]
            kept[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(kept, plain)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("whole", "repeated").dtypes)
    return rows.mapInArrow(run, schema).toDF(*columns)
