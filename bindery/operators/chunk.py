"""Next-fit chunking: split ordered sections at a word budget without cutting a section.

A chunk's end depends on where the previous one ended, so this is not a plain window.
What a run of consecutive sections does to the open chunk is a step function of the
words already in it, and step functions compose. So the sections are cut into blocks of
bounded size, every block is summarised in parallel, summaries are composed in a tree,
and the words carried into each block flow back down. No task ever holds more than one
block or ``fan_in`` summaries, however large a corpus is. Only numbers take part; texts
are joined back by id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.operators.order import ranked, with_ordinal
from bindery.session import materialize

BLOCK_ROWS_LOG2 = 16
FAN_IN = 64

_SUMMARY = "corpus string, node long, shift long, edges array<long>, carries array<long>, opened array<long>"
_SUMMARY_TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
_ENTRY = "corpus string, node long, carry long, chunks long"


class Step(NamedTuple):
    """Effect of consecutive sections on an open chunk holding ``c`` words.

    ``c <= edges[0]``: everything fits and the chunk holds ``c + shift`` words.
    ``edges[k] < c <= edges[k + 1]``: ``opened[k]`` chunks start, the last holds ``carries[k]``.
    """

    shift: int
    edges: np.ndarray
    carries: np.ndarray
    opened: np.ndarray

    def __call__(self, words):
        k = np.searchsorted(self.edges, words, side="left") - 1
        fits = k < 0
        k = np.maximum(k, 0)
        return (
            np.where(fits, words + self.shift, self.carries[k]),
            np.where(fits, 0, self.opened[k]),
        )

    def then(self, nxt: Step) -> Step:
        """This step followed by ``nxt``."""
        edges = nxt.edges - self.shift
        reached = edges < self.edges[0]
        carries, more = nxt(self.carries)
        return Step(
            self.shift + nxt.shift,
            np.concatenate([edges[reached], self.edges]),
            np.concatenate([nxt.carries[reached], carries]),
            np.concatenate([nxt.opened[reached], self.opened + more]),
        ).compact()

    def compact(self) -> Step:
        """Drop unreachable pieces (negative words) and merge equal neighbours."""
        first = max(np.searchsorted(self.edges, 0, side="left") - 1, 0)
        edges, carries, opened = self.edges[first:], self.carries[first:], self.opened[first:]
        keep = np.r_[True, (np.diff(carries) != 0) | (np.diff(opened) != 0)]
        return Step(self.shift, edges[keep], carries[keep], opened[keep])


def _next_start(words: np.ndarray, limit: int, sep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(words + sep)
    begins = ends - words - sep
    nxt = np.searchsorted(ends, limit + sep + begins, side="right")
    return begins, ends, np.maximum(nxt, np.arange(1, len(words) + 1))


def block_step(words: np.ndarray, limit: int, sep: int) -> Step:
    begins, ends, nxt = _next_start(words, limit, sep)
    n = len(words)
    last, hops = np.arange(n), np.ones(n, dtype=np.int64)
    jump = np.r_[nxt, n]
    hops, last = np.r_[hops, 0], np.r_[last, n]
    # pointer doubling: last chunk start inside the block, and chunks opened on the way
    while (jump[:-1] < n).any():
        inside = jump < n
        last = np.where(inside, last[np.minimum(jump, n)], last)
        hops = hops + np.where(inside, hops[jump], 0)
        jump = jump[jump]
    feasible = min(n, int(np.searchsorted(ends, limit, side="right")) + 1)
    begin = np.r_[begins, ends[-1]]
    carries = np.minimum(ends[-1] - begin[last[:feasible]] - sep, limit + 1)
    return Step(int(ends[-1]), (limit - ends[:feasible])[::-1], carries[::-1], hops[:feasible][::-1]).compact()


def block_assign(words: np.ndarray, limit: int, sep: int, carry: int) -> np.ndarray:
    """Number of chunks opened in the block up to and including each section."""
    _, ends, nxt = _next_start(words, limit, sep)
    starts = np.zeros(len(words), dtype=np.int64)
    at = int(np.searchsorted(ends, limit - carry, side="right"))
    while at < len(words):
        starts[at] = 1
        at = int(nxt[at])
    return np.cumsum(starts)


def _as_step(row) -> Step:
    return Step(int(row.shift), *(np.asarray(v, dtype=np.int64) for v in (row.edges, row.carries, row.opened)))


def next_fit(
    sections: DataFrame, max_words: int, sep_words: int, block_rows_log2: int = BLOCK_ROWS_LOG2, fan_in: int = FAN_IN
) -> DataFrame:
    """Add ``chunk_no`` to sections ``(corpus, gid, n_words, …)`` placed by :func:`ranked`.

    Sections are taken in ``gid`` order within each corpus; chunks are numbered from 1.
    """
    # a fresh corpus behaves like an overfull chunk: the first section always opens one
    fresh = max_words + 1
    sections = sections.withColumn("n_words", F.col("n_words").cast("long")).withColumn(
        "block", F.shiftright("gid", block_rows_log2)
    )
    listed = with_ordinal(ranked(sections.select("corpus", "block").distinct(), [F.col("corpus"), F.col("block")], "listed"), "at")
    spans = listed.groupBy("corpus").agg(F.min("at").alias("first"), F.count("*").alias("blocks"))
    numbered = listed.join(spans, "corpus").select("corpus", "block", (F.col("at") - F.col("first")).alias("node"), "blocks")
    blocks = materialize(numbered, "blocks")
    widest = blocks.agg(F.max("blocks")).first()[0] or 0

    alone = blocks.filter("blocks = 1") if widest > 1 else blocks
    entries = alone.select("corpus", "block", F.lit(fresh).cast("long").alias("carry"), F.lit(0).cast("long").alias("chunks"))
    if widest > 1:
        split = blocks.filter("blocks > 1")
        entries = entries.unionByName(_carried_in(sections, split, widest, max_words, sep_words, fan_in))

    def assign(block: pa.Table) -> pa.Table:
        block = block.sort_by("gid")
        carry, chunks = block["carry"][0].as_py(), block["chunks"][0].as_py()
        opened = block_assign(block["n_words"].to_numpy(), max_words, sep_words, carry)
        return block.drop_columns(["block", "carry", "chunks"]).append_column("chunk_no", pa.array(chunks + opened))

    out = T.StructType([f for f in sections.schema if f.name != "block"]).add("chunk_no", "long")
    keyed = sections.join(entries, ["corpus", "block"])
    columns = [f.name for f in out if f.name != "chunk_no"]
    return keyed.select(*columns, "block", "carry", "chunks").groupBy("corpus", "block").applyInArrow(assign, out)


def _carried_in(
    sections: DataFrame, blocks: DataFrame, widest: int, max_words: int, sep_words: int, fan_in: int
) -> DataFrame:
    """Words and chunks carried into every block: compose summaries up, pass carries down."""

    def summarise(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        words = block.sort_by("gid")["n_words"].to_numpy()
        shift, *pieces = block_step(words, max_words, sep_words)
        values = [[key[0].as_py()], [key[1].as_py()], [shift], *([p.tolist()] for p in pieces)]
        return pa.table([pa.array(v, t) for v, t in zip(values, _SUMMARY_TYPES, strict=True)], _columns(_SUMMARY))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("node").itertuples())
        step = _as_step(rows[0])
        for row in rows[1:]:
            step = step.then(_as_step(row))
        return pd.DataFrame([(rows[0].corpus, rows[0].node // fan_in, *step)], columns=_columns(_SUMMARY))

    def pass_down(pdf: pd.DataFrame) -> pd.DataFrame:
        out, carry, chunks = [], int(pdf["carry"].iloc[0]), int(pdf["chunks"].iloc[0])
        for row in pdf.sort_values("node").itertuples():
            out.append((row.corpus, row.node, carry, chunks))
            after, opened = _as_step(row)(carry)
            carry, chunks = min(int(after), max_words + 1), chunks + int(opened)
        return pd.DataFrame(out, columns=_columns(_ENTRY))

    numbered = sections.select("corpus", "block", "gid", "n_words").join(blocks, ["corpus", "block"])
    numbered = numbered.select("corpus", "node", "gid", "n_words")
    levels = [
        materialize(numbered.groupBy("corpus", "node").applyInArrow(summarise, _SUMMARY), "steps")
    ]
    width = widest
    while width > fan_in:
        above = levels[-1].groupBy("corpus", (F.col("node") / fan_in).cast("long").alias("up"))
        levels.append(materialize(above.applyInPandas(compose, _SUMMARY), "steps"))
        width = -(-width // fan_in)
    entries = levels[-1].select(
        "corpus", F.lit(0).cast("long").alias("up"), F.lit(max_words + 1).cast("long").alias("carry"), F.lit(0).cast("long").alias("chunks")
    ).distinct()
    for level in reversed(levels):
        children = level.withColumn("up", (F.col("node") / fan_in).cast("long"))
        entries = (
            children.join(entries, ["corpus", "up"])
            .groupBy("corpus", "up")
            .applyInPandas(pass_down, _ENTRY)
            .withColumnRenamed("node", "up")
        )
    return entries.join(blocks.withColumnRenamed("node", "up"), ["corpus", "up"]).select(
        "corpus", "block", "carry", "chunks"
    )


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]
