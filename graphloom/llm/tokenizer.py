"""Byte-level BPE encoding with array-based pre-tokenisation and cached pair merging."""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points with the property White_Space.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points of a block of texts, and distinct slices that a task keeps merged.
BLOCK, CACHE = 1 << 21, 1 << 20


def code_point_classes() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    out = np.full(len(first), OTHER, np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = NUMBER
    out[WHITE] = SPACE
    return out


def slice_starts(codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the slices of concatenated texts start, sorted.

    ``codes`` are the code points of all texts, ``kinds`` their classes, ``begins`` the
    start of each (non-empty) text. A slice is a run of one class with at most one
    ordinary space before it; white space that precedes a slice gives up only its last
    character; an apostrophe alone before s, t, re, ve, m, ll or d forms a slice with it.

    Each code point acts on the start of the current run as a transition function, either
    "keep" or "set to here"; composing them is associative (the maximum of positions), so
    a prefix scan yields every run's start without walking the text.
    """
    n = len(codes)
    place = np.arange(n)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    change = first[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    run = np.maximum.accumulate(np.where(change, place, 0))  # the scan: start of the run of each code point
    ends = np.flatnonzero(np.append(change[1:], True))  # last code point of every run
    starts = run[ends]
    opens = np.zeros(n, bool)
    opens[starts] = True
    # white space before more text: the last character goes its own way
    white = (kinds[ends] == SPACE) & ~first[ends + 1]
    last = ends[white]
    opens[last] = True
    # an ordinary space is taken in by the run behind it
    taken = last[codes[last] == 0x20] + 1
    opens[taken] = False
    # contractions: a lone apostrophe that no space took in, and the letters behind it
    lone = ends[(starts == ends) & (codes[ends] == 0x27) & opens[ends] & ~first[ends + 1]]
    if len(lone):
        two = codes[np.minimum(lone[:, None] + np.arange(1, 3), n - 1)]
        tail = ~first[np.minimum(lone + 2, n)]
        one = np.isin(two[:, 0], [ord(c) for c in "stmd"])
        pair = np.zeros(len(lone), bool)
        for text in ("re", "ve", "ll"):
            pair |= (two[:, 0] == ord(text[0])) & (two[:, 1] == ord(text[1])) & tail
        for hits, width in ((lone[one], 2), (lone[pair & ~one], 3)):
            opens[hits + 1] = False
            rest = hits + width
            rest = rest[rest < n]
            opens[rest] |= ~first[rest] & (kinds[rest] == LETTER)
    opens[begins] = True
    return np.flatnonzero(opens)


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file's byte strings with their ids, which are also their merge ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the neighbours of lowest rank are merged until none can be.

    A heap of candidate merges over a linked list keeps very long slices at n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    import heapq

    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    ends = list(range(1, n + 1))  # part at i is piece[i:ends[i]]; 0 marks a part that was merged away
    heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not ends[i] or j >= n or ends[j] != end:
            continue
        ends[i], ends[j], after[i] = end, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = ends[after[i]]
            if (rank := ranks.get(piece[i:k])) is not None:
                heapq.heappush(heap, (rank, i, k))
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (rank, h, end))
    return [ranks[piece[i:end]] for i, end in enumerate(ends) if end]


class _Merged(dict):
    """Slice of text -> its ids; slices not seen yet are merged when asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, text: str) -> list[int]:
        ids = merge_pairs(text.encode("utf-8", "replace"), self.ranks)
        if len(self) >= CACHE:
            self.clear()
        self[text] = ids
        return ids


def encode_block(texts: list[str], classes: np.ndarray, merged: dict) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """(ids, ids per text, slices, slices per text) of a block of texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    text_at = np.concatenate(([0], np.cumsum(lengths)))
    starts = slice_starts(codes, classes[codes], text_at[:-1][lengths > 0]) if len(codes) else np.empty(0, np.int64)
    bounds = [*starts.tolist(), len(whole)]
    slices = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
    found = [merged[s] for s in slices]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
    at = np.searchsorted(starts, text_at)  # first slice of every text
    return ids, np.diff(np.concatenate(([0], np.cumsum(counts)))[at]), slices, np.diff(at)


def _encoder(path: str, shared, offsets: bool):
    """(key, text) rows -> ids; ``shared`` broadcasts the class of every code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, classes = read_ranks(path), np.frombuffer(shared.value, np.uint8)
        merged = _Merged(ranks)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= BLOCK):
                    size += len(texts[stop])
                    stop += 1
                ids, per_text, slices, n_slices = encode_block(texts[at:stop], classes, merged)
                bounds = pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32())
                columns = [batch.column(0).slice(at, stop - at), pa.ListArray.from_arrays(bounds, pa.array(ids))]
                names = ["key", "ids"]
                if offsets:
                    sizes = [len(merged[s]) for s in slices]
                    lengths = np.fromiter(map(len, slices), np.int32, len(slices))
                    cuts = pa.array(np.concatenate(([0], np.cumsum(n_slices))), pa.int32())
                    columns.append(pa.ListArray.from_arrays(cuts, pa.array(lengths)))
                    columns.append(pa.ListArray.from_arrays(cuts, pa.array(sizes, pa.int32())))
                    names += ["slice_chars", "slice_ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = stop

    return run


def encode_texts(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", offsets: bool = False
) -> DataFrame:
    """(key, ids): the token ids of every row's text, one row for each row of ``df``.

    ``path`` is a vocabulary of byte strings with ranks, readable by every executor.
    Special tokens have no meaning: their strings are ordinary text. An empty or null
    text has an empty list. Rows with equal keys stay rows of their own; an empty table
    gives no rows; other columns are not read. With ``offsets``, ``slice_chars`` and
    ``slice_ids`` tell how many code points and ids every slice of the text has, so each
    id can be traced back to its place; see ``decode_slices``.

    One pass without a shuffle. Texts are cut into slices by arrays over a whole block of
    texts; each distinct slice is merged once per task and then looked up.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + (", slice_chars array<int>, slice_ids array<int>" if offsets else "")
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(code_point_classes().tobytes())  # one byte each, 1.1 MB
    coded = rows.mapInArrow(_encoder(path, shared, offsets), schema)
    return coded.withColumnRenamed("key", key)


def decode_texts(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts whose ids are given; an empty or null list is an empty text."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(_decoder(path), f"key {kind}, text string").withColumnRenamed("key", key)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(parts.__getitem__, x or ())).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return run


def decode_slices(df: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, slice_no, begins, text): every slice of every text, from ids and offsets as of ``encode_texts``.

    ``begins`` is the code point of the text at which the slice starts, counted from 0.
    Texts without slices have no row.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            row, number, begins, texts = [], [], [], []
            ids, chars, counts = (batch.column(c).to_pylist() for c in (1, 2, 3))
            for i, (own, wide, many) in enumerate(zip(ids, chars, counts)):
                at = place = 0
                for j, (w, n) in enumerate(zip(wide or (), many or ())):
                    row.append(i)
                    number.append(j)
                    begins.append(place)
                    texts.append(b"".join(map(parts.__getitem__, own[at : at + n])).decode("utf-8", "replace"))
                    at, place = at + n, place + w
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32())]
            columns += [pa.array(begins, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "slice_no", "begins", "text"])

    rows = df.select(F.col(key).alias("key"), "ids", "slice_chars", "slice_ids")
    return rows.mapInArrow(run, f"key {kind}, slice_no int, begins int, text string").withColumnRenamed("key", key)
