"""Layouts of (key, member) tables that stay even when one key holds a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import filled
from graphloom.operators.skew import hot_counts

#: Parts into which the rows of a hot key are spread.
SALTS = 64


def clean_pairs(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member) of the rows in which neither is null or blank, repetitions included."""
    rows = df.select(F.col(key).alias("key"), F.col(member).alias("member"))
    return rows.where(filled(F.col("key")) & filled(F.col("member")))


def distinct_pairs(rows: DataFrame) -> DataFrame:
    """(key, member, n): every pair once with its number of rows; one shuffle, map-side combined."""
    return rows.groupBy("key", "member").agg(F.count(F.lit(1)).alias("n"))


def proven_large(rows: DataFrame, keys: list[str], most: int) -> list[str]:
    """Those of ``keys`` that are proven to have more than ``most`` distinct members, and no others.

    Members are hashed into four times as many buckets as the limit. Equal members share a
    bucket, so more than ``most`` filled buckets are more than ``most`` members. Keys up to
    some 1.2 times the limit may stay unproven. Collated members, of which equal ones may
    differ in bytes and so in hash, prove nothing.
    """
    if not keys or getattr(rows.schema["member"].dataType, "collation", "UTF8_BINARY") != "UTF8_BINARY":
        return []
    words = max(1, math.ceil(most / 16))  # of 64 buckets
    bucket = F.pmod(F.xxhash64("member"), F.lit(64 * words))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bucket", F.lit(64)).cast("int"))
    taken = rows.where(F.col("key").isin(keys)).select("key", bucket.alias("bucket"))
    taken = taken.groupBy("key", F.shiftright("bucket", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    counted = taken.groupBy("key").agg(F.sum(F.bit_count("bits")).alias("n"))
    return [r["key"] for r in counted.where(F.col("n") > most).collect()]


def by_key(rows: DataFrame, hot: list[str]) -> DataFrame:
    """Distinct pairs partitioned by key, for keys of which none is large.

    ``hot`` names keys of many rows but few distinct members; their repetitions are
    collapsed on the map side first. All other rows cross one shuffle.
    """
    laid = rows.select("key", "member")
    if hot:
        loud = laid.where(F.col("key").isin(hot)).distinct()
        laid = laid.where(~F.col("key").isin(hot)).unionByName(loud)
    return laid.repartition("key").distinct()


def small_sets(rows: DataFrame, most: int) -> DataFrame:
    """(key, members): the sets of the keys with at most ``most`` distinct members.

    Hot keys that are proven to have more never enter the shuffle; the exact limit is
    checked on the counted rows of each other key, which are spilled where needed, and
    only sets within it are collected.
    """
    hot = hot_counts(rows, ["key"])["key"]
    large = proven_large(rows, [k for k, n in hot.items() if n > most], most)
    kept = rows.where(~F.col("key").isin(large)) if large else rows
    pairs = by_key(kept, [k for k in hot if k not in set(large)])
    counted = pairs.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return counted.where(F.col("m") <= most).groupBy("key").agg(F.collect_list("member").alias("members"))


def with_codes(df: DataFrame, column: str, code: str, buckets: int = 4096) -> DataFrame:
    """``df`` of distinct values with a unique number below 2**31 for each.

    A value's number is its rank within a hash bucket, times the buckets, plus the
    bucket: unique and repeatable without a global sort or a single task.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(column))
    return (
        df.withColumn("__bucket", bucket)
        .withColumn(code, ((rank - 1) * buckets + F.col("__bucket")).cast("int"))
        .drop("__bucket")
    )
