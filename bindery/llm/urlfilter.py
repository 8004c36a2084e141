"""URL filter as a Bloom filter cascade.

The key universe is everything the corpus could ask for: of each URL, every suffix of its host with every path
beginning of a rule's length. Level 0 encodes the listed keys; level 1 those unlisted keys of the universe that
level 0 lets through; level 2 the listed keys that level 1 lets through; and so on until a level lets nothing wrong
through. A key belongs to the list if the first level to refuse it is an odd one. Over the universe this is exact,
and pages are judged by bit tests alone, without a join.

Keys are dealt by hash to parts of about ``PART_KEYS`` keys of the universe, each a cascade of its own that one task
builds; hashes of distinct keys cannot be skewed. The filters hold some ``BITS`` bits a listed key, more where the
universe outweighs the list so far that the levels behind would grow with it. They are sent to all tasks while they
fit ``SENT_BYTES``; beyond that the pages' keys go to the filter of their part instead, hot parts salted, with the
same result.

Defined cases: a URL that is null or has no ``://`` has empty host and path and fits no rule; a path counts only up
to ``?`` or ``#``; of equally long fitting rules the one with the longer host wins; repeated pages are judged alike;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import ascii_lower
from bindery.session import materialize

# fixed values: rule and verdict
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Host labels whose hosts the method lists for blocking.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Bits of a filter per key that it encodes, at least and at most.
BITS, MOST_BITS = 12, 48
HASHES = 4
#: Keys of the universe in a part.
PART_KEYS = 1 << 18
#: Filters of up to this size in all are sent to every task.
SENT_BYTES = 32 << 20
#: Keys of pages that one task looks up in a part, once filters are not sent.
TASK_KEYS = 4_000_000


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix with every path beginning of ``lengths`` (the path must be that long)."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    heads = F.filter(
        F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
        lambda x: x.isNotNull(),
    )
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    return F.when(F.length(host) > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


class Level(NamedTuple):
    """One level of all parts: the words of part p are ``words[begin[p]:begin[p + 1]]``; without words all are refused."""

    begin: np.ndarray
    words: np.ndarray


def part_of(h: Column, parts: int) -> Column:
    return F.shiftrightunsigned(h, 40) % F.lit(parts)


def _places(hashes: np.ndarray, bits: np.ndarray | int, level: int) -> np.ndarray:
    """``HASHES`` bit numbers per key, by double hashing of (key hash, level)."""
    x = hashes.astype(np.uint64) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    step = (x >> np.uint64(32)) | np.uint64(1)
    bits = np.asarray(bits, np.uint64)
    return np.stack([(x + np.uint64(i) * step) % bits for i in range(HASHES)]).astype(np.int64)


def _passes(hashes: np.ndarray, number: int, level: Level) -> np.ndarray:
    if not len(level.words):
        return np.zeros(len(hashes), bool)
    part = ((hashes.astype(np.uint64) >> np.uint64(40)) % np.uint64(len(level.begin) - 1)).astype(np.int64)
    begin = level.begin[part]
    bits = (level.begin[part + 1] - begin) * 64
    at = _places(hashes, np.maximum(bits, 1), number)
    words = level.words[np.minimum(begin + (at >> 6), len(level.words) - 1)]
    return ((words >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(0) & (bits > 0)


def member(hashes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Whether each key is listed: the first level to refuse it is an odd one, or none is and their number is odd."""
    alive, listed = np.ones(len(hashes), bool), np.zeros(len(hashes), bool)
    for number, level in enumerate(levels):
        ok = _passes(hashes, number, level)
        listed |= alive & ~ok & (number % 2 == 1)
        alive &= ok
    return listed | (alive & (len(levels) % 2 == 1))


def _one(words: np.ndarray) -> Level:
    return Level(np.array([0, len(words)]), words)


def _bits(coded: int, other: int) -> int:
    """Size of a filter of ``coded`` keys that lets through no more than about as many of ``other`` keys."""
    share = min(0.5, coded / max(other, 1)) ** (1 / HASHES)
    a_key = min(MOST_BITS, max(BITS, -HASHES / math.log1p(-share)))
    return max(64, math.ceil(coded * a_key / 64) * 64)


def _levels(hashes: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """Filters of one part: listed keys, unlisted ones that pass, listed ones that pass those, and so on."""
    coded, other, out = hashes[listed], hashes[~listed], []
    while len(coded):
        words = np.zeros(_bits(len(coded), len(other)) // 64, np.uint64)
        at = _places(coded, len(words) * 64, len(out)).ravel()
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        coded, other = other[_passes(other, len(out), _one(words))], coded
        out.append(words)
    return out


def filters(universe: DataFrame, listed: DataFrame, part_keys: int = PART_KEYS) -> tuple[DataFrame, int]:
    """``part, level, words`` that tell ``listed(h)`` from the rest of ``universe(h)`` exactly, and the number of parts."""
    both = universe.select("h", F.lit(False).alias("listed")).unionByName(listed.select("h", F.lit(True).alias("listed")))
    keys_ = materialize(both.groupBy("h").agg(F.max("listed").alias("listed")), "url-universe")
    parts = max(1, -(-keys_.count() // part_keys))

    def build(group: pa.Table) -> pa.Table:
        h = group["h"].to_numpy()
        found = _levels(h, group["listed"].to_numpy())
        columns = {
            "part": pa.array([group["part"][0].as_py()] * len(found), pa.int64()),
            "level": pa.array(range(len(found)), pa.int32()),
            "words": pa.array([w.tobytes() for w in found], pa.binary()),
        }
        return pa.table(columns)

    dealt = keys_.withColumn("part", part_of(F.col("h"), parts))
    return materialize(dealt.groupBy("part").applyInArrow(build, "part long, level int, words binary"), "filters"), parts


def gathered(made: DataFrame, parts: int) -> list[Level]:
    """The filters of all parts as levels; the caller has seen to their size."""
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in made.collect():
        found.setdefault(r["level"], {})[r["part"]] = np.frombuffer(r["words"], np.uint64)
    out = []
    for number in range(len(found)):
        words = [found[number].get(p, np.zeros(0, np.uint64)) for p in range(parts)]
        out.append(Level(np.cumsum([0] + [len(w) for w in words]), np.concatenate(words)))
    return out


def cascade(universe: DataFrame, listed: DataFrame, part_keys: int = PART_KEYS) -> list[Level]:
    """Levels that tell ``listed(h)`` from the rest of ``universe(h)`` exactly, for lists that the driver can hold."""
    return gathered(*filters(universe, listed, part_keys))


def _found_here(keyed: DataFrame, levels: list[Level]) -> DataFrame:
    """``found``, the listed ones of each row's keys, with the filters at hand in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("_h").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            hit = member(flat, levels)
            ends = np.cumsum(b.column("_h").value_lengths().to_numpy(zero_copy_only=False))
            offsets = np.append(0, np.cumsum(hit))[np.append(0, ends)].astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), b.column("_keys").flatten().filter(pa.array(hit)))
            columns = [b.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, found], ["page_id", "host", "path", "found"])

    kind = keyed.schema["page_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"page_id {kind}, host string, path string, found array<string>")


def _found_in_parts(keyed: DataFrame, made: DataFrame, parts: int, task_keys: int) -> DataFrame:
    """:func:`_found_here` with every key sent to the filter of its part, whose levels come first in its task.

    A part that many pages ask for (a host suffix that a third of them share) is salted, its filter sent to each salt.
    """
    rows = materialize(keyed.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    asked = rows.select("_row", F.inline(F.arrays_zip(F.col("_keys").alias("key"), F.col("_h").alias("h"))))
    asked = asked.withColumn("part", part_of(F.col("h"), parts))
    load = asked.groupBy("part").agg(F.ceil(F.count("*") / F.lit(task_keys)).alias("ways"))
    ways = materialize(load.join(made.select("part").distinct(), "part"), "url-ways")  # parts without filters list nothing
    asked = asked.join(ways, "part").withColumn("salt", F.pmod(F.xxhash64("_row"), "ways")).drop("ways")
    sent = made.join(ways, "part").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    both = sent.drop("ways").unionByName(asked, allowMissingColumns=True)
    task = ["part", "salt"]
    both = both.repartition(*task).sortWithinPartitions(*task, F.col("level").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, []
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in task])
            starts = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(0)))
            for begin, end in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
                run_ = b.slice(begin, end - begin)
                here = tuple(marks[:, begin])
                if here != now:
                    now, levels = here, []
                filters_ = run_.column("words").drop_null()
                levels += [_one(np.frombuffer(w.as_py(), np.uint64)) for w in filters_]
                keys_ = run_.slice(len(filters_))
                if keys_.num_rows:
                    hit = pa.array(member(keys_.column("h").to_numpy(), levels))
                    yield keys_.select(["_row", "key"]).filter(hit)

    hits = both.mapInArrow(run, "_row long, key string").groupBy("_row").agg(F.collect_list("key").alias("found"))
    joined = rows.select("_row", "page_id", "host", "path").join(hits, "_row", "left")
    return joined.withColumn("found", F.coalesce("found", F.array().cast("array<string>"))).drop("_row")


def judge(
    pages: DataFrame,
    rules: dict[str, str] | None = None,
    blocked_labels: tuple[str, ...] = BLOCKED_LABELS,
    *,
    part_keys: int = PART_KEYS,
    sent_bytes: int = SENT_BYTES,
    task_keys: int = TASK_KEYS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed_host`` of every page.

    Listed keys are the rules, and the hosts of the corpus with a blocked label; a page under no rule is blocked if
    a suffix of its host is listed, else allowed.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for r in rules} | {0})
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    keyed = parts.withColumn("_keys", keys(F.col("host"), F.col("path"), lengths))
    keyed = keyed.withColumn("_h", F.transform("_keys", lambda k: F.xxhash64(k)))
    universe = keyed.select(F.explode("_keys").alias("key")).distinct().withColumn("h", F.xxhash64("key"))
    universe = materialize(universe, "url-keys")
    blocked = F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, blocked_labels)).cast("array<string>"))
    hosts = universe.filter(~F.col("key").contains("/") & blocked).select("h")
    given = spark.createDataFrame([(r,) for r in rules], "key string").select(F.xxhash64("key").alias("h"))
    made, n_parts = filters(universe, given.unionByName(hosts), part_keys)
    size = made.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size <= sent_bytes:
        found = _found_here(keyed, gathered(made, n_parts))
    else:
        found = _found_in_parts(keyed, made, n_parts, task_keys)
    is_rule = lambda f: f.isin(*rules)
    fits = F.transform(F.filter("found", is_rule), lambda f: F.struct(F.length(f), F.instr(f, "/"), f.alias("rule")))
    verdicts = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]).cast("map<string,string>")
    judged = found.select(
        "page_id", "host", "path", F.array_max(fits)["rule"].alias("rule"), F.exists("found", lambda f: ~is_rule(f)).alias("listed_host")
    )
    by_method = F.when(F.col("listed_host"), F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.try_element_at(verdicts, F.col("rule")), by_method)
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed_host")
