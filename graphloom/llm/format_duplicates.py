"""Rows that differ in formatting only: commutative multiset fingerprints."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import durable

#: Rows of a group that are joined to it by broadcast, as a share of all rows and at least.
HOT_SHARE, HOT_ROWS = 1 / 10_000, 100_000


@functools.cache
def marks() -> str:
    """All characters with a punctuation, separator, control or format category."""
    kinds = ("P", "Z", "Cc", "Cf")
    points = (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return "".join(c for c in points if unicodedata.category(c).startswith(kinds))


def bare(column: Column) -> Column:
    """The text in lower case without white space, control, format and punctuation characters of any script."""
    return F.lower(F.translate(column, marks(), ""))


def _fingerprint(fields: list[Column], seed: int) -> Column:
    """A 62-bit hash per normalised value, combined by addition, which no order can change.

    Both fields bear the same name, since an undirected edge has no first end; for
    records with ordered fields the name would be hashed with the value.
    """
    total = F.lit(0).cast("long")
    for field in fields:
        total = total + F.shiftright(F.xxhash64(F.lit("vertex"), field, F.lit(seed)), 2)
    return total


GROUP = ["fp", "lo", "hi"]


def _rows(df: DataFrame, key: str, ends: tuple[str, str]) -> DataFrame:
    """(key, fp, lo, hi): the normalised ends, smaller first, and the fingerprint of every row that has both."""
    # a generator of one row: the texts are rewritten once per row, not again in every filter on the result
    ends_bare = F.struct(*[bare(F.col(c)).alias(n) for c, n in zip(ends, "vw")])
    rows = df.select(F.col(key).alias("key"), F.inline(F.array(ends_bare)))
    rows = rows.where((F.col("v") != "") & (F.col("w") != ""))
    fp = _fingerprint([F.col("v"), F.col("w")], 0).alias("fp")
    return rows.select("key", fp, F.least("v", "w").alias("lo"), F.greatest("v", "w").alias("hi"))


def _groups(rows: DataFrame) -> DataFrame:
    """(fp, lo, hi, first_key, copies): one row per fingerprint and, since chance may bring others together, fields."""
    return rows.groupBy(*GROUP).agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"))


def distinct_edges(df: DataFrame, key: str = "edge_id", ends: tuple[str, str] = ("vertex1", "vertex2")) -> DataFrame:
    """(key, copies): one row per edge, the smallest key of its rows, with their number.

    Rows and copies are those of ``edge_copies``; one map-side-combined hash aggregate.
    """
    return _groups(_rows(df, key, ends)).select(F.col("first_key").alias("key"), "copies")


def edge_copies(df: DataFrame, key: str = "edge_id", ends: tuple[str, str] = ("vertex1", "vertex2")) -> DataFrame:
    """Every row with the first row of its group of copies and the size of that group.

    Columns: ``first_key`` (smallest key of the group), ``key``, ``copies`` (rows in the
    group, 1 for a row without copies). Two rows are copies if their ends are the same in
    either order once case, white space and punctuation are ignored. Rows with a null or
    blank end, or one of punctuation alone, are left out; equal keys in repeated rows are
    rows of their own. An empty table gives no rows; other columns are not read.

    Rows are grouped by an order-free fingerprint, and their fields compared, in one hash
    aggregate that is combined on the map side, so a group of any size reaches its task as
    a few rows. Groups with copies are then joined back to their rows by hash, those that
    hold a large part of all rows (at most 1 / ``HOT_SHARE``) as a broadcast table.
    """
    rows = _rows(df, key, ends)
    groups = durable(_groups(rows).where(F.col("copies") > 1))
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    limit = max(HOT_ROWS, total * HOT_SHARE)
    large, small = groups.where(F.col("copies") >= limit), groups.where(F.col("copies") < limit)
    columns = [F.coalesce("first_key", "key").alias("first_key"), "key", F.coalesce("copies", F.lit(1)).alias("copies")]
    if large.isEmpty():
        return rows.join(small.hint("shuffle_hash"), GROUP, "left").select(*columns)
    large = F.broadcast(large)
    crowd = rows.join(large, GROUP).select(*columns)
    others = rows.join(large, GROUP, "left_anti")
    return others.join(small.hint("shuffle_hash"), GROUP, "left").select(*columns).unionByName(crowd)
