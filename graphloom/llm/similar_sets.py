"""All similar pairs of sets: forests of sorted minhash sketches with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import layout
from graphloom.operators.skew import hot_counts
from graphloom.session import durable

#: Similarity expected between unrelated sets, and rows of a neighbourhood that are compared without a longer prefix.
BACKGROUND, CROWD = 0.1, 100
#: Minhashes of the shortest prefix that makes a neighbourhood.
SHORTEST = 2
#: Bits of the one-bit sketch, and standard deviations it may fall below its mean.
BITS, SIGMAS = 128, 6.0
#: Rows of a common prefix that one task compares; larger neighbourhoods get longer prefixes, then pairs of chunks.
CHUNK = 20_000
#: Rows of a key, as estimated, that one task streams; keys with more are split.
HOT_ROWS = 1 << 18
#: Rows of one prefix or key each that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def forest_shape(sets: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """(deepest, first, trees): longest prefix, trees of the first round, trees in all.

    The longest prefix grows with the logarithm of the number of sets, until the unrelated
    sets that share one by chance are about ``CROWD``. The first round has the trees that
    reach ``recall`` at the threshold if no neighbourhood is crowded, all trees reach it if
    every one is.
    """
    deepest = max(SHORTEST + 1, math.ceil(math.log(max(sets, 1) / CROWD, 1 / BACKGROUND)))
    needed = [math.ceil(math.log(1 - recall) / _log_miss(threshold, depth)) for depth in (SHORTEST, deepest)]
    return deepest, needed[0], max(needed[1], math.ceil(BITS / deepest))


def _log_miss(threshold: float, depth: int) -> float:
    """Log of the probability that a pair at the threshold does not share a prefix of one tree."""
    return math.log(max(1 - threshold**depth, 1e-300))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _grouped(
    batches: Iterator[pa.RecordBatch], rows: int = 1 << 16, whole: bool = True
) -> Iterator[tuple[pa.Table, np.ndarray, bool]]:
    """Sorted input as blocks: a table, where the groups of its first column start, if the last one goes on.

    A block has about ``rows`` rows. Groups come whole, or, if not ``whole``, those longer
    than a block in pieces.
    """
    filled = (b for b in batches if b.num_rows)
    held: list[pa.RecordBatch] = []
    size, batch = 0, next(filled, None)
    while batch is not None:
        held.append(batch)
        size += batch.num_rows
        batch = next(filled, None)
        if batch is not None and size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column(0).combine_chunks()
        differs = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(differs) + 1))
        goes_on = batch is not None and batch.column(0)[0] == key[size - 1]
        if goes_on and len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1], False
            held = table.slice(int(starts[-1])).to_batches()
            size = table.num_rows - int(starts[-1])
        elif goes_on and whole:
            rows = 2 * size
            held = table.to_batches()
        else:
            yield table, starts, goes_on
            held, size = [], 0


def _minima(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Minhash signatures, one row of ``n`` minima per group."""
    odd, add = _family(n)
    out = np.empty((len(starts), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(_mixed(hashes * odd[k] + add[k]), starts)
    return out


Signatures = tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[Signatures]:
    """(keys, distinct members, two fingerprints, minima) of (key, h) rows sorted by both.

    A key of any number of rows is streamed: what a block has of it is kept as one
    partial signature.
    """
    held = None
    for table, starts, goes_on in _grouped(batches, whole=False):
        h = np.asarray(table.column("h")).view(np.uint64)
        fresh = np.concatenate(([True], h[1:] != h[:-1]))
        fresh[starts] = True
        begin = np.concatenate(([0], np.cumsum(fresh)))[starts]
        h = h[fresh]
        new = np.ones(len(h), np.uint64)
        if held is not None and h[0] == held[-1]:
            new[0] = 0
        sizes = np.add.reduceat(new, begin).astype(np.int64)
        prints = [np.add.reduceat(_mixed(h ^ np.uint64(s)) * new, begin).view(np.int64) for s in (1, 2)]
        least = _minima(h, begin, n)
        if held is not None:
            sizes[0] += held[0]
            for total, part in zip(prints, held[1]):  # slices: numbers wrap around
                total[:1] += part
            least[0] = np.minimum(least[0], held[2])
        end = len(starts)
        held = None
        if goes_on:
            end -= 1
            held = sizes[-1], [p[-1:].copy() for p in prints], least[-1].copy(), h[-1]
        if end:
            keys = table.column("key").combine_chunks().take(pa.array(starts[:end]))
            yield keys, sizes[:end], [p[:end] for p in prints], least[:end]


PARTIAL = "key string, size long, fp0 long, fp1 long, least array<long>"
SKETCH = "key string, size long, fp0 long, fp1 long, bits0 long, bits1 long, minima binary"


def _partial(n: int):
    """(part, key, h) rows sorted by part and h -> one partial signature per part of a hot set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["key", "h"]) for b in batches)
        for keys, sizes, prints, least in _signatures(parts, n):
            names = pc.list_element(pc.split_pattern(keys, "\x00", max_splits=1), 1)
            lists = pa.array(list(least.view(np.int64)), pa.list_(pa.int64()))
            arrays = [names, pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "size", "fp0", "fp1", "least"])

    return run


def _finished(keys, sizes, prints, least: np.ndarray, least_size: int) -> pa.RecordBatch:
    """Packed minima (two bytes each) and one-bit sketches of the sets that are large enough."""
    kept = np.flatnonzero(sizes >= least_size)
    least = least[kept]
    bits = np.packbits(((least[:, :BITS] >> np.uint64(16)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
    width = 2 * least.shape[1]
    offsets = pa.py_buffer(np.arange(len(kept) + 1, dtype=np.int32) * width)
    packed = pa.py_buffer((least & np.uint64(0xFFFF)).astype("<u2").tobytes())
    minima = pa.Array.from_buffers(pa.binary(), len(kept), [None, offsets, packed])
    numbers = [pa.array(x[kept], pa.int64()) for x in (sizes, *prints)]
    columns = [keys.take(pa.array(kept)), *numbers, pa.array(bits[:, 0]), pa.array(bits[:, 1]), minima]
    return pa.RecordBatch.from_arrays(columns, ["key", "size", "fp0", "fp1", "bits0", "bits1", "minima"])


def _sketched(n: int, least_size: int):
    """(key, h) rows sorted by both -> sketches of the sets with enough distinct members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _signatures(batches, n):
            yield _finished(*found, least_size)

    return run


def _merged(n: int, least_size: int):
    """Partial signatures of hot sets, sorted by key -> their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, _ in _grouped(batches, 256):
            lists = table.column("least").combine_chunks()
            flat = np.asarray(lists.flatten()).view(np.uint64).reshape(-1, n)
            least = np.minimum.reduceat(flat, starts, axis=0)
            size, *prints = (np.add.reduceat(np.asarray(table.column(c)), starts) for c in ("size", "fp0", "fp1"))
            keys = table.column("key").combine_chunks().take(pa.array(starts))
            yield _finished(keys, size, prints, least, least_size)

    return run


def _words(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of two-byte words as a matrix."""
    packed = column.combine_chunks()
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(data).view("<u2").reshape(-1, width)


def neighbourhoods(label: np.ndarray, words: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, depth) of the neighbourhood of every row; rows are sorted by label and words.

    A neighbourhood is a common prefix of ``floor`` words, one word longer as long as more
    than ``CROWD`` rows share it, or of all words.
    """
    n, deepest = words.shape
    place = np.arange(n)
    first, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    agrees = label[1:] == label[:-1]
    for d in range(1, deepest + 1):
        agrees = agrees & (words[1:, d - 1] == words[:-1, d - 1])
        if d < SHORTEST:
            continue
        starts = np.flatnonzero(np.concatenate(([True], ~agrees)))
        sizes = np.diff(np.append(starts, n))
        few = np.repeat((sizes <= CROWD) | (d == deepest), sizes)
        taken = few & (depth == 0) & (floor <= d)
        first[taken] = np.repeat(starts, sizes)[place[taken]]
        depth[taken] = d
    return first, depth


def _neighbours(threshold: float, deepest: int):
    """Rows sorted by label and prefix -> near pairs (a, b), and (a, null, depth) where a prefix was not the shortest.

    Rows are compared with the next, the second next and so on, as long as the
    neighbourhood is the same: the work is the number of pairs, the memory that of the
    block. Sizes too different and sketches too far apart for the threshold never leave
    the task. Where ``cross`` is set, only rows of different chunks are compared.
    """
    mean = (1 + threshold) / 2
    most = int(BITS * (1 - mean) + SIGMAS * math.sqrt(BITS * mean * (1 - mean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, *_ in _grouped(batches):
            label, size = np.asarray(table.column("label")), np.asarray(table.column("size"))
            first, depth = neighbourhoods(label, _words(table.column("prefix"), deepest), np.asarray(table.column("floor")))
            bits = [np.asarray(table.column(c)).view(np.uint64) for c in ("bits0", "bits1")]
            chunk = np.asarray(table.column("chunk"))
            cross = table.column("cross").to_numpy()
            keys = table.column("key").combine_chunks()
            deep = np.flatnonzero((depth > SHORTEST) & ~cross)
            if len(deep):
                columns = [keys.take(pa.array(deep)), pa.nulls(len(deep), pa.string()), pa.array(depth[deep], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "depth"])
            active, step = np.arange(table.num_rows), 0
            while True:
                step += 1
                active = active[active + step < table.num_rows]
                active = active[first[active] == first[active + step]]
                if not len(active):
                    break
                i, j = active, active + step
                near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
                near &= ~cross[i] | (chunk[i] != chunk[j])
                i, j = i[near], j[near]
                far = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int64) for b in bits)
                i, j = i[far <= most], j[far <= most]
                if len(i):
                    columns = [keys.take(pa.array(i)), keys.take(pa.array(j)), pa.nulls(len(i), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "b", "depth"])

    return run


def _label(depth: int) -> Column:
    """The prefix of ``depth`` minhashes of a tree as a number."""
    return F.xxhash64("tree", F.substring("prefix", 1, 2 * depth))


def laid_out(rows: DataFrame, deepest: int) -> DataFrame:
    """(tree, prefix, ...) rows with the label they are compared under, so that no label has many rows.

    The label is the shortest prefix; where more than ``CHUNK`` rows share it, which is
    counted exactly, the prefix is made longer. Rows that share the longest prefix in
    larger numbers get a label for each pair of chunks they are in, so all their pairs are
    compared, in as many tasks as there are pairs of chunks.
    """
    parts = []
    rows = rows.withColumns({"chunk": F.lit(0), "cross": F.lit(False)})
    for depth in range(SHORTEST, deepest + 1):
        labelled = rows.withColumns({"label": _label(depth), "floor": F.lit(depth)})
        large = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
        large = durable(large)
        n = large.count()
        if not n:
            return _together([*parts, labelled])
        large = F.broadcast(large) if n <= BROADCAST_ROWS else large
        parts.append(labelled.join(large, "label", "left_anti"))
        rows = labelled.join(large, "label").drop("floor")
        if depth < deepest:
            rows = rows.drop("label", "n")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    pair = F.xxhash64("label", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = rows.withColumns({"label": pair, "floor": F.lit(deepest), "cross": F.col("chunk") != F.col("other")})
    return _together([*parts, rows.drop("other", "n")])


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _compared(classes: DataFrame, trees: Column, threshold: float, deepest: int) -> DataFrame:
    """Near pairs and depths, as of ``_neighbours``, over the given trees (an array) of every class."""
    width = 2 * deepest
    rows = classes.select(F.col("class_key").alias("key"), "size", "bits0", "bits1", "minima", F.explode(trees).alias("tree"))
    prefix = F.substring(F.col("minima"), F.col("tree") * width + 1, F.lit(width))
    laid = laid_out(rows.withColumn("prefix", prefix).drop("minima"), deepest)
    laid = laid.select("label", "prefix", "key", "size", "bits0", "bits1", "floor", "chunk", "cross")
    laid = laid.repartition("label").sortWithinPartitions("label", "prefix")
    return durable(laid.mapInArrow(_neighbours(threshold, deepest), "a string, b string, depth int"))


def _at_least(part: Column, whole: Column, threshold: float) -> Column:
    """part / whole >= threshold without rounding, for thresholds of up to four decimals."""
    return part * 10_000 >= whole * round(threshold * 10_000)


def similar_sets(
    df: DataFrame,
    key: str = "term",
    member: str = "element",
    threshold: float = 0.7,
    least_size: int = 4,
    recall: float = 0.9999,
) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets with a Jaccard similarity of ``threshold`` or more, and membership.

    Returns (pairs, membership). Membership has one row per key whose set has at least
    ``least_size`` distinct members: ``key``, ``class_key`` (the smallest key with exactly
    this set), ``size`` and ``links``, how many other classes are similar. Pairs hold
    class keys: ``class_a`` < ``class_b``, ``shared``, ``either``. Null or blank keys and
    members count nowhere, repeated rows once; an empty table gives two empty results.

    Every tree of the forest orders the sets by a signature of ``deepest`` minhashes of
    its own. Sets are compared with their neighbours in that order, those with a common
    prefix: the shortest one (``SHORTEST``) unless more than ``CROWD`` sets share it, else
    a longer one. A longer prefix finds a pair less surely; from the depths a set was
    compared at follows its recall, and sets below ``recall`` are compared in as many more
    trees as they need. Neighbours are compared by size and by a 128-bit sketch, which
    loses a pair at the threshold with a probability below 1e-8, and what remains is
    verified exactly on the members themselves. No neighbourhood is capped, however many
    sets share the longest prefix (``laid_out``). A pair at the very threshold is found
    with probability ``recall``, others more surely.

    A set is one streamed group of one task unless its key is hot: the signature of a hot
    set is the minimum of the signatures of its parts. Identical sets are one class before
    the forest, so a crowd of copies is one row per tree.
    """
    rows = layout.clean_pairs(df, key, member)
    hashed = rows.select("key", F.xxhash64("member").alias("h"))
    seen = hot_counts(rows, ["key"], extra={"n": F.approx_count_distinct("key")})
    deepest, first, trees = forest_shape(seen["n"], threshold, recall)
    hot = [(k, 1 + n // HOT_ROWS) for k, n in seen["key"].items() if n > HOT_ROWS]
    minima = deepest * trees
    plain = hashed.where(~F.col("key").isin([k for k, _ in hot])) if hot else hashed
    plain = plain.repartition("key").sortWithinPartitions("key", "h")
    sketches = plain.mapInArrow(_sketched(minima, least_size), SKETCH)
    if hot:
        split = F.broadcast(df.sparkSession.createDataFrame(hot, "key string, parts int"))  # at most skew.MAX_HOT rows
        parts = hashed.join(split, "key").distinct()
        salt = F.pmod(F.col("h"), F.col("parts"))
        parts = parts.select(F.concat_ws("\x00", salt, "key").alias("part"), "h")
        parts = parts.repartition("part").sortWithinPartitions("part", "h")
        whole = parts.mapInArrow(_partial(minima), PARTIAL).repartition("key").sortWithinPartitions("key")
        sketches = sketches.unionByName(whole.mapInArrow(_merged(minima, least_size), SKETCH))
    sketches = durable(sketches)
    same = ["size", "fp0", "fp1"]
    firsts = sketches.groupBy(*same).agg(F.min("key").alias("class_key"))
    classes = sketches.join(firsts.select(F.col("class_key").alias("key")), "key", "left_semi")
    classes = durable(classes.withColumnRenamed("key", "class_key"))
    near = _compared(classes, F.sequence(F.lit(0), F.lit(first - 1)), threshold, deepest)
    # the log of the probability that a pair of this set was missed, against the log of what may be missed
    miss = [_log_miss(threshold, d) for d in range(1, deepest + 1)]
    allowed = math.log(1 - recall)
    lost = F.element_at(F.array(*[F.lit(m - miss[SHORTEST - 1]) for m in miss]), F.col("depth"))
    short = near.where(F.col("b").isNull()).groupBy(F.col("a").alias("class_key"))
    short = short.agg((F.sum(lost) + first * miss[SHORTEST - 1] - allowed).alias("over"))
    more = F.ceil(F.col("over") / -miss[-1]).cast("int")
    short = durable(short.where(F.col("over") > 1e-9).select("class_key", F.least(more, F.lit(trees - first)).alias("more")))
    if not short.isEmpty():
        again = _compared(classes.join(short, "class_key"), F.sequence(F.lit(first), F.col("more") + (first - 1)), threshold, deepest)
        near = near.unionByName(again)
    near = near.where(F.col("b").isNotNull())
    near = durable(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = near.select(F.col("a").alias("key")).union(near.select("b")).distinct()
    ends = F.broadcast(ends) if 2 * near.count() <= BROADCAST_ROWS else ends
    sets = rows.join(ends, "key", "left_semi").distinct()
    sides = near.select("a", "b", F.explode(F.array("a", "b")).alias("key")).join(sets, "key")
    joint = sides.groupBy("a", "b", "member").agg(F.count(F.lit(1)).alias("sides"))
    pairs = joint.groupBy(F.col("a").alias("class_a"), F.col("b").alias("class_b")).agg(
        F.count_if(F.col("sides") == 2).alias("shared"), F.count(F.lit(1)).alias("either")
    )
    pairs = pairs.where(_at_least(F.col("shared"), F.col("either"), threshold))
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_key")).groupBy("class_key")
    links = links.agg(F.count(F.lit(1)).alias("links"))
    membership = sketches.select("key", *same).join(firsts, same)
    membership = membership.join(links, "class_key", "left")
    return pairs, membership.select("key", "class_key", "size", F.coalesce("links", F.lit(0)).alias("links"))


def similar_keys(df: DataFrame, key: str = "term", member: str = "element", **options) -> DataFrame:
    """(key_a, key_b): every pair of keys with similar sets, identical ones included.

    The pairs of classes of ``similar_sets`` with the classes' members put back.
    """
    pairs, membership = similar_sets(df, key, member, **options)
    a = membership.select(F.col("class_key").alias("class_a"), F.col("key").alias("x"))
    b = membership.select(F.col("class_key").alias("class_b"), F.col("key").alias("y"))
    across = pairs.join(a, "class_a").join(b, "class_b").select("x", "y")
    twins = a.join(b, (a["class_a"] == b["class_b"]) & (a["x"] < b["y"])).select("x", "y")
    both = across.unionByName(twins)
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
