"""Overlap sizes between large sets: compressed bitmaps by identifier range."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import layout
from graphloom.session import durable

#: Rows that an identifier range has on average, and from which on its pairs of sets are spread over tasks.
RANGE, SPLIT = 1 << 17, 1 << 20
#: Sets that may hold an identifier for it to be kept as a list of sets; others are bits of bitmaps.
LISTED = 128
#: Non-zero pair counts held by a task before they are written out, and pairs made at once.
HELD, STEP = 1 << 22, 1 << 21

Counts = tuple[np.ndarray, np.ndarray]


def _run_lengths(codes: np.ndarray, counts: np.ndarray | None = None) -> Counts:
    """Distinct codes, sorted, with how often they occur or the sum of their counts."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


def _merged(parts: list[Counts]) -> Counts:
    return _run_lengths(*(np.concatenate(x) for x in zip(*parts))) if parts else _run_lengths(np.empty(0, np.int64))


def _listed_pairs(row: np.ndarray, at: np.ndarray, part: np.ndarray | None) -> Iterator[Counts]:
    """Pairs of rows that meet at an identifier, walked identifier by identifier; each has at most ``LISTED`` rows."""
    order = np.lexsort((row, at))
    row, at = row[order], at[order]
    active, step, held, size = np.arange(len(at)), 0, [], 0
    while True:
        step += 1
        active = active[active + step < len(at)]
        active = active[at[active] == at[active + step]]
        if not len(active):
            break
        i, j = row[active], row[active + step]
        if part is not None:
            apart = part[i] != part[j]
            i, j = i[apart], j[apart]
        held.append((i << 32) | j)
        size += len(i)
        if size >= STEP:
            yield _run_lengths(np.concatenate(held))
            held, size = [], 0
    if held:
        yield _run_lengths(np.concatenate(held))


def _bitmap_pairs(row: np.ndarray, at: np.ndarray, part: np.ndarray | None) -> Iterator[Counts]:
    """Common bits of all rows with a bit among the identifiers that many rows hold."""
    rows, place = np.unique(row, return_inverse=True)
    _, bit = np.unique(at, return_inverse=True)
    words = np.zeros((len(rows), int(bit.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(words, (place, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    block = max(1, STEP // len(rows))
    for lo in range(0, len(rows), block):
        hi = min(lo + block, len(rows))
        common = np.zeros((hi - lo, len(rows) - lo), np.int32)
        for w in range(words.shape[1]):
            common += np.bitwise_count(words[lo:hi, w, None] & words[None, lo:, w])
        i, j = np.nonzero(common)
        count = common[i, j].astype(np.int64)
        kept = j > i
        if part is not None:
            kept &= part[rows[lo + i]] != part[rows[lo + j]]
        i, j, count = i[kept], j[kept], count[kept]
        yield (rows[lo + i] << 32) | rows[lo + j], count


def range_counts(sets: np.ndarray, ids: np.ndarray, part: np.ndarray | None = None) -> Counts:
    """(packed pair of set numbers, common identifiers) of the sets of one range.

    Identifiers of one set add to no pair and are left out. Those that few sets hold are
    lists of sets, walked for the pairs that meet there; those of many sets are the bits
    of bitmaps, one row per set, intersected and counted row by row. Memory is in
    proportion to the rows, and only sets that meet are paired. With ``part`` (per row),
    only sets of different parts are.
    """
    _, at, times = np.unique(ids, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    names, row = np.unique(sets[shared], return_inverse=True)
    at = at[shared]
    parts = None
    if part is not None:
        parts = np.zeros(len(names), np.int64)
        parts[row] = part[shared]
    few = times[at] <= LISTED
    found: list[Counts] = []
    for how, kept in ((_listed_pairs, few), (_bitmap_pairs, ~few)):
        if not kept.any():
            continue
        for counts in how(row[kept], at[kept], parts):
            found.append(counts)
            if sum(len(c) for c, _ in found) > HELD:
                found = [_merged(found)]
    code, count = _merged(found)
    return (names[code >> 32] << 32) | names[code & 0xFFFFFFFF], count


def _count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair counts of (range, set, identifier, part) rows that come range by range, summed within the task."""
    done: list[Counts] = []
    held: list[tuple[np.ndarray, ...]] = []
    current = None

    def close() -> None:
        if held:
            sets, ids, part = (np.concatenate(x) for x in zip(*held))
            done.append(range_counts(sets, ids, None if part[0] < 0 else part))
            held.clear()

    def out(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 1 << 20):
            part = slice(at, at + (1 << 20))
            yield pa.RecordBatch.from_arrays([pa.array(codes[part]), pa.array(counts[part])], ["code", "n"])

    for batch in batches:
        ranges, sets, ids, part = (np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.int64) for c in batch.columns)
        edges = np.flatnonzero(np.diff(ranges)) + 1
        for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(ranges)]))):
            if lo == hi:
                continue
            if ranges[lo] != current:
                close()
                current = ranges[lo]
                if sum(len(c) for c, _ in done) > HELD:
                    done = [_merged(done)]
                    if len(done[0][0]) > HELD // 2:
                        yield from out(*done.pop())
            held.append((sets[lo:hi], ids[lo:hi], part[lo:hi]))
    close()
    yield from out(*_merged(done))


def _spread(rows: DataFrame) -> DataFrame:
    """(range, code, h) with ``part``: -1, or the part of the set where the pairs of a large range are spread.

    The rows of every range are counted exactly. The sets of a large one, such as the
    range of an identifier that millions of sets hold, fall into parts, and each pair of
    parts is a range of its own.
    """
    large = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT)
    large = durable(large)  # at most one in SPLIT / RANGE of the ranges
    whole = rows.withColumn("part", F.lit(-1))
    if large.isEmpty():
        return whole
    parts = F.ceil(F.col("n") / (SPLIT // 2)).cast("int")
    split = rows.join(large, "range").withColumn("part", F.pmod(F.xxhash64("code"), parts).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = [F.least("part", "other"), F.greatest("part", "other")]
    # the pairs within a part are those of a range without parts
    split = split.select(
        F.xxhash64("range", *pair).alias("range"), "code", "h", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("part")
    )
    return whole.join(large, "range", "left_anti").select("range", "code", "h", "part").unionByName(split)


def set_overlaps(df: DataFrame, key: str = "term", member: str = "element", least: int = 100) -> DataFrame:
    """Common members of every two sets with at least ``least`` distinct members that share any.

    Columns: ``set_a`` < ``set_b``, ``n_a``, ``n_b`` (their sizes), ``shared``. Null or
    blank keys and members count nowhere, repeated rows once; without two large sets the
    result is empty; other columns are not read. Sizes are exact. Members are encoded as
    64-bit hashes: ``shared`` is exact unless two members of a pair of sets have one hash,
    which adds one to it (for two sets of a billion members with a probability of 5 %).

    The identifiers fall into ranges of about ``RANGE`` rows. Each range is a set of
    compressed bitmaps, intersected pairwise (``range_counts``); a task sums the counts of
    its ranges, and one map-side-combined shuffle sums them over all ranges. No set is
    ever held whole, a hot set is spread over all ranges, and the pairs of a range with
    many sets are spread over tasks.
    """
    pairs = layout.distinct_pairs(layout.clean_pairs(df, key, member)).select("key", "member")
    sizes = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    sizes = durable(layout.with_codes(sizes, "key", "code"))
    total = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    ranges = max(1, math.ceil(total / RANGE))
    hashed = pairs.join(sizes.select("key", "code"), "key").select("code", F.xxhash64("member").alias("h"))
    rows = durable(hashed.select(F.pmod(F.shiftright("h", 20), F.lit(ranges)).alias("range"), "code", "h"))
    laid = _spread(rows).select("range", "code", "h", "part")
    laid = laid.repartition(min(ranges, 100_000), "range").sortWithinPartitions("range")
    counts = laid.mapInArrow(_count_ranges, "code long, n long").groupBy("code").agg(F.sum("n").alias("shared"))
    counts = counts.select(
        F.shiftright("code", 32).cast("int").alias("code_a"),
        F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("code_b"),
        "shared",
    )
    for side in "ab":
        named = sizes.select(F.col("code").alias(f"code_{side}"), F.struct("key", "size").alias(side))
        counts = counts.join(named, f"code_{side}")
    a, b = F.least("a", "b"), F.greatest("a", "b")
    return counts.select(a.alias("a"), b.alias("b"), "shared").select(
        F.col("a.key").alias("set_a"),
        F.col("b.key").alias("set_b"),
        F.col("a.size").alias("n_a"),
        F.col("b.size").alias("n_b"),
        "shared",
    )
