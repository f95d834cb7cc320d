"""Per-key results when a handful of keys hold most of the rows.

The recurring form is value-frequency compression: rows are first counted per
(key, value), which spreads a hot key over all its values and collapses repeated
rows before the shuffle; per-key results are then derived from the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Never more than this many values are reported as hot, so a list of them is always small.
MAX_HOT = 2048
#: Counters that the hot-value sketch tracks per column.
TRACKED = 32768


def hot_counts(
    df: DataFrame, columns: list[str], share: float = 1 / 10_000, extra: dict[str, Column] | None = None
) -> dict[str, dict]:
    """Values that may stand in at least ``share`` of the rows of ``df``, per column, with estimated counts.

    One map-side-combined pass with a frequent-items sketch per column; at most
    ``MAX_HOT`` values per column reach the driver. The estimates steer layouts only:
    results never depend on them. Nulls are never hot; an empty table has no hot values.
    ``extra`` aggregates are taken in the same pass and returned under their names.
    """
    wanted = [F.count(F.lit(1)).alias("__rows"), *[c.alias(f"__{n}") for n, c in (extra or {}).items()]]
    for i, name in enumerate(columns):
        quoted = "`" + name.replace("`", "``") + "`"
        wanted.append(F.expr(f"approx_top_k({quoted}, {MAX_HOT}, {TRACKED})").alias(f"__top{i}"))
    row = df.select(*[F.col(c) for c in columns]).agg(*wanted).first()
    least = max(2.0, row["__rows"] * share)
    return {
        name: {
            x["item"]: x["count"]
            for x in row[f"__top{i}"] or []
            if x["item"] is not None and x["count"] >= least
        }
        for i, name in enumerate(columns)
    } | {name: row[f"__{name}"] for name in extra or {}}


def hot_values(df: DataFrame, columns: list[str], share: float = 1 / 10_000) -> dict[str, list]:
    """The values of ``hot_counts`` alone, the most frequent first."""
    return {name: list(values) for name, values in hot_counts(df, columns, share).items()}


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how many rows hold each value under each key. Nulls are values."""
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def key_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows, distinct values and the modal value of every key, exactly.

    Columns: ``key``, ``n_rows``, ``n_values`` (distinct non-null values), ``mode``
    (most frequent non-null value; of equally frequent ones the smallest) and
    ``mode_rows``. A null key is a key of its own; a key whose values are all null has
    0 values and a null mode. An empty table gives no rows. Other columns of ``df``,
    whatever their names, are not read.

    A key with a third of all rows is compressed to (value, count) by a hash aggregate on
    the map side and spread by the hash of key *and* value. The second level is partial and
    final as well, so a key reaches its last task as one row per task before; it aggregates
    by sorting, since the mode is a value of any length, and spills where it must.
    """
    counted = value_counts(df, key, value)
    # the order of the struct makes the smallest value win among equal counts
    seen = F.col("value").isNotNull()
    return (
        counted.groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.count_if(seen).alias("n_values"),
            F.min(F.when(seen, F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))).alias("top"),
        )
        .select("key", "n_rows", "n_values", F.col("top.v").alias("mode"), (-F.col("top.m")).alias("mode_rows"))
    )


def weighted_percentiles(
    df: DataFrame, key: str, value: str, probabilities: list[float], splitters: int = 128
) -> DataFrame:
    """Exact interpolated percentiles of ``value`` per key, from weighted values.

    Columns: ``key``, ``probability``, ``percentile`` (double; linear interpolation
    between the closest ranks). Null and NaN values are left out, and so are keys
    without any other value. Repeated values are kept as weights.

    No task sees a whole hot key: at most ``splitters`` cut points of the overall value
    distribution split every key into ordered value ranges; the weights per (key, range)
    locate the range that holds a rank, and only the rows of that range are sorted.
    The cut points steer the layout only, the result is exact for any of them. A range
    holds about 1 / ``splitters`` of the distinct values of a hot key: give more of them
    for keys of more than some billion distinct values.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    steps = [i / splitters for i in range(1, splitters)]
    cuts = sorted(set(rows.approxQuantile("value", steps, 1 / (2 * splitters)) or [])) if steps else []
    counted = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    # number of cut points not above the value: an order-preserving range id
    band = (
        F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("value"))) if cuts else F.lit(0)
    )
    counted = counted.withColumn("band", band)
    bands = counted.groupBy("key", "band").agg(F.sum("n").alias("w"))
    before = Window.partitionBy("key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        "key",
        "band",
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("below"),
        "w",
        F.sum("w").over(Window.partitionBy("key")).alias("total"),
    )
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    targets = bands.select("key", "band", "below", "w", "total", asked)
    position = (F.col("total") - 1) * F.col("probability")
    ends = F.explode(
        F.array(
            F.struct(F.floor(position).alias("rank"), F.lit(0).alias("upper")),
            F.struct(F.ceil(position).alias("rank"), F.lit(1).alias("upper")),
        )
    )
    targets = (
        targets.select("key", "band", "below", "w", "probability", position.alias("position"), ends.alias("e"))
        .select("key", "band", "below", "w", "probability", "position", "e.rank", "e.upper")
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("w")))
    )
    needed = targets.select("key", "band").distinct()
    same = F.col("c.key").eqNullSafe(F.col("t.key")) & (F.col("c.band") == F.col("t.band"))
    within = counted.alias("c").join(needed.alias("t"), same, "left_semi").select("c.key", "c.band", "c.value", "c.n")
    upto = Window.partitionBy("key", "band").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    within = within.withColumn("upto", F.sum("n").over(upto))
    offset = F.col("t.rank") - F.col("t.below")
    found = (
        within.alias("c")
        .join(targets.alias("t"), same)
        .where((offset < F.col("c.upto")) & (offset >= F.col("c.upto") - F.col("c.n")))
        .select("t.key", "t.probability", "t.position", "t.upper", "c.value")
    )
    low, high = F.max(F.when(F.col("upper") == 0, F.col("value"))), F.max(F.when(F.col("upper") == 1, F.col("value")))
    part = F.max("position") - F.floor(F.max("position"))
    return found.groupBy("key", "probability").agg((low + (high - low) * part).alias("percentile"))


def dominant_keys(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Profiles of the non-null keys that hold at least ``share`` of all rows of ``df``.

    The row total is counted without reading a column or shuffling a row.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    profile = key_profile(df, key, value).where(F.col("key").isNotNull())
    return profile.where(F.col("n_rows") / total >= F.lit(share))
