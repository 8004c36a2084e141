"""Building blocks shared by the operators: text slices, tree folds, grouped prefix sums, bucket blocks, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.session import materialize

WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
#: Bytes of text that a task holds as Python objects at a time.
TEXT_SLICE = 4 << 20
#: States that one task folds into one.
FAN = 16


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column bears it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = TEXT_SLICE) -> Iterator[pa.RecordBatch]:
    """Views of the batches with about ``limit`` bytes in the column ``text``; a longer text is one by itself.

    A batch of ten thousand documents may hold a gigabyte of text; a worker that looks at a view at a time, and lets
    go of what it made of it, stays small whatever the batch.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def folded(states: DataFrame, merge: Callable[[Iterator[bytes]], bytes], label: str) -> bytes | None:
    """One state out of ``states(part long, state binary)``, merged ``FAN`` at a time in a tree of written tables.

    A state has a fixed size, so no task holds more than ``FAN`` of them and the driver gets one.
    """

    def combine(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        state = merge(x.as_py() for x in group["state"])
        return pa.table({"part": [group["part"][0].as_py() // FAN], "state": pa.array([state], pa.binary())})

    level = materialize(states, label)
    while level.count() > 1:
        up = F.floor(F.col("part") / FAN)
        level = materialize(level.groupBy(up).applyInArrow(combine, "part long, state binary"), label)
    last = level.first()
    return None if last is None else bytes(last["state"])


def running_sum(df: DataFrame, group: str, order: list, value: str, label: str) -> DataFrame:
    """Add ``before`` (sum of ``value`` over earlier rows of the group) and ``total`` (of the group).

    Rows are range-partitioned by group and order, so a group holding a third of all rows is spread over
    many tasks. Each task keeps one running number; only (group, partition) sums meet in a window.
    ``group`` must hold no nulls. Written once, so that ties stay as they fell.
    """
    columns = df.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", before long, _part int"

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, carry = TaskContext.get().partitionId(), None, 0
        for frame in frames:
            if frame.empty:
                continue
            keys, v = frame[group].to_numpy(), frame[value].to_numpy(np.int64)
            first = np.ones(len(v), bool)
            first[1:] = keys[1:] != keys[:-1]
            prior = np.cumsum(v) - v
            starts = np.flatnonzero(first)
            base = np.repeat(prior[starts], np.diff(np.append(starts, len(v))))
            before = prior - base
            if last is not None and keys[0] == last:
                before[: starts[1] if len(starts) > 1 else len(v)] += carry
            last, carry = keys[-1], int(before[-1] + v[-1])
            frame["before"], frame["_part"] = before, part
            yield frame

    dealt = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    local = materialize(dealt.mapInPandas(scan, schema), label)
    sums = local.groupBy(group, "_part").agg(F.sum(value).alias("_s"))
    by_part = Window.partitionBy(group).orderBy("_part")
    offsets = sums.select(
        group,
        "_part",
        F.coalesce(F.sum("_s").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_s").over(Window.partitionBy(group)).alias("total"),
    )
    joined = local.join(offsets, [group, "_part"])
    return joined.select(*columns, (F.col("before") + F.col("_off")).alias("before"), "total")


def in_blocks(rows: DataFrame, keys: list[str], salt: str, block: int) -> DataFrame:
    """Deal buckets of two rows or more to pair tasks of at most about ``2 * block`` rows.

    A bucket of n rows is cut by a hash of ``salt`` into ``ceil(n / block)`` blocks; block c takes part in the
    tasks (c, d) of all blocks d. Small buckets are one task. Adds ``_i``, ``_j`` (the task) and ``_c`` (own block).
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    dealt = rows.join(sizes, keys).withColumn("_c", F.pmod(F.xxhash64(salt), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    dealt = dealt.withColumn("_i", F.least("_c", "_d")).withColumn("_j", F.greatest("_c", "_d")).drop("_d")
    task = [*keys, "_i", "_j"]
    return dealt.repartition(*task).sortWithinPartitions(*task)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each run of equal ``keys`` in a sorted partition, as Arrow columns in, arrays out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[dict] = []
        n = 0

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: np.concatenate([r[k] for r in rows]) for k in rows[0]})

        def changes(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for k in keys:
                v = table.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(new)

        def groups(last: bool) -> Iterator[pa.Table]:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = changes(table)
            held.clear()
            ends = np.append(starts[1:], table.num_rows)
            for s, e in zip(starts, ends, strict=True):
                if e == table.num_rows and not last:
                    held.extend(table.slice(s, e - s).to_batches())
                else:
                    yield table.slice(s, e - s)

        def fed() -> Iterator[pa.Table]:
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    yield from groups(False)
            if held:
                yield from groups(True)

        for group in fed():
            got = fn({c: group.column(c) for c in group.column_names})
            if got is not None and len(next(iter(got.values()))):
                out.append(got)
                n += len(next(iter(got.values())))
                if n > 50_000:
                    yield packed(out)
                    out, n = [], 0
        if out:
            yield packed(out)

    return df.mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths, not empty, as a two-dimensional array."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps: each step only takes minima per node (combined map-side) and
    joins them back, so a node with very many links needs no task that holds them all. Each round is written.
    """

    def tidy(e: DataFrame) -> DataFrame:
        pair = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return pair.filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())

    now = materialize(tidy(edges), label)
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = tidy(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        now = materialize(tidy(small), label)
        was, seen = seen, state(now)
        if was == seen:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
