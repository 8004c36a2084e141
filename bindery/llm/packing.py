"""Best-fit packing by exact complements.

Lengths are at most the capacity, so the plan is made on a histogram of at most ``capacity`` numbers, whatever the
corpus: the longest remaining length opens a sequence, and its gap is closed exactly by one, two or three lengths
whose sum is indexed under the available counts; where no such sum exists the best-fitting (longest) length goes in
and the smaller gap is tried again. A combination is consumed as often as its counts allow, so the number of
different combinations does not grow with the corpus. Pieces then find their place by their ordinal among pieces of
their length, a distributed count.

Defined cases: a null text is an empty one and an empty text is its end token; a text over the capacity is cut,
others never; repeated rows are packed as rows of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import running_sum, slices
from bindery.session import materialize

CAPACITY = 4096
END_ID = 1
#: Distinct parts of words whose ids a task remembers, and their bytes; forgetting them changes nothing but time.
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20
#: Bytes of text that a task looks at together: the more, the fewer words are looked up again.
SLICE = 8 << 20
_ODD = "[\x1c-\x1f]"
# Latin letters with a lower case of one letter, then ASCII signs without the apostrophe: the tokenizer parts such a word
# just there, and neither of the parts any further
_LETTERS, _SIGNS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{1c3}", r"!-&(-/:-@\[-`{-~"
_PLAIN = f"^(?P<letters>[{_LETTERS}]+)(?P<signs>[{_SIGNS}]*)$"
_PART = f"^(?:[{_LETTERS}]+|[{_SIGNS}]+)$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Words:
    """Ids of texts as little-endian bytes, through the ids of their words.

    The tokenizer turns white space to one blank and drops it, so no token reaches over a blank and a text's ids
    are those of its words in turn. The few control characters that Arrow, but not the tokenizer, takes for white
    space send a text through the tokenizer whole.

    Words are told apart by Arrow, a slice of texts at a time, and plain ones parted into letters, in lower case, and
    signs. Parts and the words that are not plain are ``keys``, of which each has a stretch of ``flat``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # parts need no more than the model: they are in lower case, composed and parted
        self.parts = Tokenizer(self.tokenizer.model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # the empty word stands where a text begins or ends in white space
        self.keys, self.starts, self.sizes = pa.array([""]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many parts, and how many each has; a part ends with the first token that ends a word."""
        offsets = np.unique(np.append(np.arange(0, len(parts), 2_000), len(parts)))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts), " ")
        found = self.parts.encode_batch_fast(joined.to_pylist(), add_special_tokens=False)
        ids = np.concatenate([np.asarray(f.ids, "<u4") for f in found])
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(parts) or ends[-1] != len(ids):
            return None
        return ids, np.diff(ends, prepend=0)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, and how many each has: a token belongs to the word that its offset lies in."""
        flat, sizes = [], []
        for at in range(0, len(words), 2_000):
            some = words[at : at + 2_000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            begins = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            place = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
            flat.append(ids)
            sizes.append(np.diff(np.append(np.searchsorted(place, begins), len(ids))))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, keys: pa.Array) -> None:
        """Add keys that are not known yet."""
        part = pc.and_(pc.match_substring_regex(keys, _PART), pc.less_equal(pc.utf8_length(keys), 64))
        for some, of_parts in ((keys.filter(part), True), (keys.filter(pc.invert(part)), False)):
            if not len(some):
                continue
            ids, sizes = (self._parts(some) if of_parts else None) or self._whole(some.to_pylist())
            self.keys = pa.concat_arrays([self.keys, some])
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.flat = np.append(self.flat, ids)

    def _places(self, strings: pa.Array) -> np.ndarray:
        """Each string's place in ``keys``."""
        at = pc.index_in(strings, value_set=self.keys)
        if at.null_count:
            known = len(self.keys)
            self._learn(strings.filter(at.is_null()).unique())
            new = pc.add(pc.index_in(strings, value_set=self.keys.slice(known)), known)
            at = pc.coalesce(at, new)
        return at.to_numpy()

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        if len(self.keys) > REMEMBERED or self.keys.nbytes + self.flat.nbytes > REMEMBERED_BYTES:
            self._forget()
        odd = pc.match_substring_regex(texts, _ODD)
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        parts = pc.extract_regex(distinct, _PLAIN)
        plain = pc.and_(parts.is_valid(), pc.less_equal(pc.utf8_length(distinct), 64))
        first = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "letters")), distinct)
        second = pc.if_else(plain, pc.struct_field(parts, "signs"), "")
        # of each word its two parts, side by side
        two = self._places(pa.concat_arrays([first, second])).reshape(2, -1).T
        flat, sizes = _gathered(self.flat, self.starts[two].ravel(), self.sizes[two].ravel()), self.sizes[two].sum(1)
        of_word = coded.indices.to_numpy()
        blob = _gathered(flat, (np.cumsum(sizes) - sizes)[of_word], sizes[of_word]).tobytes()
        ends = np.append(0, np.cumsum(sizes[of_word]))[words.offsets.to_numpy()] * 4
        for whole, text, begin, end in zip(odd.to_pylist(), texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield self._whole([text.as_py()])[0].tobytes() if whole else blob[begin:end]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every text's pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _Words(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", SLICE):
            rows, blobs = [], []

            def packed(rows=rows, blobs=blobs):
                a = np.array(rows, np.int64).reshape(-1, 5)
                out = {n: a[:, i] for i, n in enumerate(("row", "piece", "start", "length", "ids_crc32"))}
                out["doc_id"], out["piece"] = ids.take(pa.array(out.pop("row"))), out["piece"].astype(np.int32)
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                columns = [out[n] if n == "doc_id" else pa.array(out[n]) for n in names]
                if keep_ids:
                    names.append("ids")
                    flat = pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))
                    ends = np.append(0, np.cumsum([len(b) // 4 for b in blobs])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                return pa.RecordBatch.from_arrays(columns, names)

            ids, texts = batch.column(0), batch.column(1).fill_null("")
            held = 0
            for row, got in enumerate(words.ids(texts)):
                blob = got + end
                for piece, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if keep_ids:
                        blobs.append(part)
                        held += len(part)
                if held > 32_000_000:
                    yield packed()
                    rows.clear(), blobs.clear()
                    held = 0
            if rows:
                yield packed()

    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """``(times, ((length, copies), ...))`` combinations that use up the histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n

    def pair(gap: int, have: np.ndarray) -> tuple[int, int] | None:
        """The pair of sum ``gap`` with the longest first part."""
        if gap < 2:
            return None
        ok = (have[1:gap] > 0) & (have[gap - 1 : 0 : -1] > 0)
        if gap % 2 == 0 and have[gap // 2] < 2:
            ok[gap // 2 - 1] = False
        at = np.flatnonzero(ok)
        return (int(at[-1]) + 1, gap - int(at[-1]) - 1) if len(at) else None

    def longest(gap: int, have: np.ndarray) -> int:
        at = np.flatnonzero(have[1 : gap + 1] > 0)
        return int(at[-1]) + 1 if len(at) else 0

    def exact(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
        if have[gap] > 0:
            return (gap,)
        most = longest(gap, have)
        if gap > 3 * most:
            return None
        if gap <= 2 * most and (two := pair(gap, have)):
            return two
        # the other two reach at most twice the longest
        low = max(1, gap - 2 * most)
        for first in np.flatnonzero(have[low:gap] > 0)[::-1] + low:
            have[first] -= 1
            two = pair(gap - int(first), have)
            have[first] += 1
            if two:
                return (int(first), *two)
        return None

    out = []
    top = capacity
    while top:
        if left[top] == 0:
            top -= 1
            continue
        have, gap, parts = left.copy(), capacity - top, [top]
        have[top] -= 1
        while gap:
            if found := exact(gap, have):
                parts += found
                break
            best = longest(gap, have)
            if not best:
                break
            parts.append(best)
            have[best] -= 1
            gap -= best
        used: dict[int, int] = {}
        for p in parts:
            used[p] = used.get(p, 0) + 1
        times = min(int(left[p]) // c for p, c in used.items())
        for p, c in used.items():
            left[p] -= times * c
        out.append((times, tuple(used.items())))
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (a written table)."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity
    next_ordinal = dict.fromkeys(counts, 0)
    runs, sequence = [], 0
    for times, parts in plan(counts, capacity):
        at = 0
        for length, copies in parts:
            runs.append((length, next_ordinal[length], sequence, copies, at))
            next_ordinal[length] += copies * times
            at += copies * length
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    starts = table[:, 0] * (1 << 48) + table[:, 1]
    narrow = cut.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("_one", F.lit(1).cast("long"))
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    numbered = running_sum(narrow, "length", order, "_one", "ordinals").drop("_one", "total")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, ordinal = (b.column(n).to_numpy().astype(np.int64) for n in ("length", "before"))
            row = table[np.searchsorted(starts, length * (1 << 48) + ordinal, side="right") - 1]
            r = ordinal - row[:, 1]
            columns = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(row[:, 2] + r // row[:, 3]), pa.array(row[:, 4] + r % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return numbered.mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents with their places: one row per piece, ids reduced to a checksum."""
    cut = pieces(docs, tokenizer or default_tokenizer(), capacity, end_id)
    return place(materialize(cut, "pieces"), capacity)


def sequences(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, doc_ids, starts, lengths, ids``, in order of offset.

    Ids are gathered per sequence, so a group never exceeds the capacity.
    """
    cut = materialize(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, True), "token-pieces")
    # pieces with equal keys are equal: their order among themselves is free
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    places = place(cut, capacity)
    one = F.struct(F.col("offset"), *same, "ids")
    held, placed = _numbered(cut, same).alias("c"), _numbered(places, same).alias("p")
    alike = [F.col(f"c.{n}").eqNullSafe(F.col(f"p.{n}")) for n in (*same, "_copy")]
    keyed = held.join(placed, alike).select("p.sequence_id", "p.offset", *[f"c.{n}" for n in same], "c.ids")
    rows = keyed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    return rows.select(
        "sequence_id",
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.start").alias("starts"),
        F.col("p.length").alias("lengths"),
        F.flatten("p.ids").alias("ids"),
    )


def _numbered(df: DataFrame, same: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
