"""How many partners of every key are in every set: counted key by key, without shuffling the pairs of keys and sets.

The pairs of a key and a set may be far more than the edges and members they come from.
Only the edges are brought together by key; the members, as numbers, are sent to every
task, which counts a block of keys against all sets at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Rows of members that are sent to every task; callers use joins for more.
MEMBERS = 2_000_000
#: Cells of a block of keys by sets, and looked up members, that a task holds at once.
CELLS = 1 << 22
#: Edges of a block.
EDGES = 1 << 17
#: Rows of one Arrow batch that goes back.
BATCH = 1 << 16


@dataclass(frozen=True)
class Members:
    """``table``: the collected rows; the sets of vertex ``i`` are ``held[starts[i]:starts[i + 1]]``, places in ``ids``."""

    table: pa.Table
    vertices: pa.Array
    ids: pa.Array
    sets: np.ndarray
    starts: np.ndarray
    held: np.ndarray
    order: np.ndarray


def collected(members: DataFrame, set_id: str, vertex: str) -> Members | None:
    """The rows of ``members`` with its sets and vertices as numbers; None if they are more than ``MEMBERS``."""
    if isinstance(members.schema[set_id].dataType, (ArrayType, MapType, StructType)):
        return None
    table = members.limit(MEMBERS + 1).toArrow()
    if table.num_rows > MEMBERS:
        return None
    v, s = (
        pa.chunked_array(table.column(c).chunks, table.schema.field(c).type).combine_chunks().dictionary_encode("encode")
        for c in (vertex, set_id)
    )
    codes, sets = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (v, s))
    order = np.argsort(codes, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(v.dictionary)))))
    return Members(table, v.dictionary, s.dictionary, sets, starts.astype(np.int64), sets[order].astype(np.int32), order)


def coded(edges: DataFrame, vertex: str, members: Members, others: bool = True) -> DataFrame:
    """``edges`` with the number of their vertex as ``code``, -1 if it is no member, or, unless ``others``, without these."""
    codes = pa.table({vertex: members.vertices, "code": pa.array(np.arange(len(members.vertices), dtype=np.int64))})
    known = F.broadcast(edges.sparkSession.createDataFrame(codes))  # at most MEMBERS rows
    rows = edges.join(known, vertex, "left" if others else "inner")
    return rows.withColumn("code", F.coalesce("code", F.lit(-1).cast("long")))


def in_one_place(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with all of a key together, sorted by key and ``order``.

    The number of partitions is given: the work of a task follows what it gives, not the
    few bytes it reads, by which they would be made fewer.
    """
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key, *order)


def by_key(edges: DataFrame, key: str, vertex: str, members: Members, others: bool = False) -> DataFrame:
    """(key, code) of the edges whose vertex is a member, all of a key together; with ``others`` the rest as -1."""
    rows = coded(edges, vertex, members, others)
    return in_one_place(rows.select(F.col(key).alias("key"), "code"), "key")


def stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length - 1`` of all stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def even_slices(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``lengths`` that add up to ``most`` at most, or hold one element."""
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(at, to)
        at = to


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches put together to ``EDGES`` rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def counted(
    batches: Iterator[pa.RecordBatch], starts: np.ndarray, held: np.ndarray, n: int
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, edges of each, counts by key and set) of (key, code) rows sorted by key.

    A key may go on through any number of blocks; its counts are carried on.
    """
    name, size, row = None, 0, None
    step = max(1, CELLS // max(1, n))
    for block in blocks(batches):
        keys = block.column(0).combine_chunks().dictionary_encode()
        at, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary
        codes = block.column(1).to_numpy()
        sizes = np.bincount(at, minlength=len(names))
        at, codes = at[codes >= 0].astype(np.int64), codes[codes >= 0]
        lengths = starts[codes + 1] - starts[codes]
        for a in range(0, len(names), step):
            b = min(a + step, len(names))
            first, last = np.searchsorted(at, (a, b))
            counts = np.zeros((b - a) * n, np.int64)
            for part in even_slices(lengths[first:last], CELLS):
                places = slice(first + part.start, first + part.stop)
                sets = held[stretches(starts[codes[places]], lengths[places])]
                cells = np.repeat((at[places] - a) * n, lengths[places]) + sets
                counts += np.bincount(cells, minlength=len(counts))
            counts = counts.reshape(b - a, n)
            if row is not None and a == 0:
                if names[0].as_py() == name:
                    counts[0] += row
                    sizes[0] += size
                else:
                    yield pa.array([name], names.type), np.array([size]), row[None]
            row = None
            if b == len(names):  # the last key may go on in the next block
                b -= 1
                name, size, row = names[b].as_py(), int(sizes[b]), counts[b - a].copy()
            if b > a:
                yield names.slice(a, b - a), sizes[a:b], counts[: b - a]
    if row is not None:
        yield pa.array([name], names.type), np.array([size]), row[None]


def met_sets(shared, ids_type: pa.DataType) -> Callable:
    """For ``mapInArrow``: (key, sets), the sets that the partners of every key are in."""

    def run(batches):
        starts, held, ids = shared.value
        for names, _, counts in counted(batches, starts, held, len(ids)):
            at, sets = np.nonzero(counts)
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(names))))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(sets)).cast(ids_type))
            yield pa.RecordBatch.from_arrays([names, lists], ["key", "sets"])

    return run


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded half up in decimal notation, as ``F.round`` does; NaN stays."""
    if digits is None:
        return values
    from decimal import ROUND_HALF_UP, Decimal

    with np.errstate(over="ignore", invalid="ignore"):
        scaled = values * 10.0**digits
        out = np.rint(scaled) / 10.0**digits
        # whole already, or too close to a half to tell in binary
        out = np.where(np.abs(scaled) < 1e15, out, values)
        close = np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-9 * np.maximum(1.0, np.abs(scaled))
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(close & (np.abs(scaled) < 1e15)):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def factorized(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For rows of whole numbers from 0: the place of each among the distinct rows, and these."""
    whole = columns[0]
    spans = [int(c.max(initial=0)) + 1 for c in columns]
    for column, span in zip(columns[1:], spans[1:], strict=True):
        whole = whole * span + column
    codes, distinct = pd.factorize(whole)
    out = []
    for span in spans[:0:-1]:
        distinct, rest = np.divmod(distinct, span)
        out.append(rest)
    return codes, [distinct, *out[::-1]]
