"""Frequency of every distinct value: heavy-light aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import layout
from graphloom.operators.skew import hot_values
from graphloom.session import durable


def value_frequencies(
    df: DataFrame, term: str = "term", element: str = "element", common_share: float = 0.1
) -> DataFrame:
    """In how many rows and records every term and every element occurs, with a mark.

    Columns: ``field_name`` (``term`` or ``element``), ``field_value``, ``n_rows``,
    ``n_records`` (distinct partners) and ``mark``: ``rare`` for one record, else
    ``common`` for at least ``common_share`` of all distinct values of the other field,
    else null. Rows with a null or blank term or element count nowhere; a repeated pair
    counts once as a record and every time as a row. An empty table gives no rows; only
    the two named columns are read.

    Pairs are made distinct in one map-side-combined shuffle, which heavy values cross
    too, since a distinct partner can only be counted once all its repetitions have met.
    Detected heavy values are a bounded table, broadcast; every task then counts them in
    its own exact counters, one slot per heavy value (the map side of an aggregate over
    the slots), and sends one number for each. Only the light values are shuffled by
    value. The detection steers the layout; any list gives the same counts.
    """
    rows = layout.clean_pairs(df, term, element)
    hot = hot_values(rows, ["key", "member"])
    names = [("term", "key"), ("element", "member")]
    heavy = [(field, value) for field, column in names for value in hot[column]]
    slots = df.sparkSession.createDataFrame(
        [(f, v, i) for i, (f, v) in enumerate(heavy)], "field_name string, field_value string, slot int"
    )
    both = F.inline(
        F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(c).alias("field_value"), "n") for f, c in names])
    )
    occurrences = layout.distinct_pairs(rows).select(both)
    sums = [F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records")]
    on = ["field_name", "field_value"]
    light = occurrences.join(F.broadcast(slots), on, "left_anti").groupBy(*on).agg(*sums)
    counted = light
    if heavy:
        local = occurrences.join(F.broadcast(slots), on).groupBy("slot").agg(*sums)
        counted = light.unionByName(local.join(F.broadcast(slots), "slot").select(*on, "n_rows", "n_records"))
    counted = durable(counted)
    distinct = {r["field_name"]: r["count"] for r in counted.groupBy("field_name").count().collect()}
    partners = F.when(F.col("field_name") == "term", distinct.get("element", 0)).otherwise(distinct.get("term", 0))
    mark = F.when(F.col("n_records") == 1, "rare").when(F.col("n_records") / partners >= common_share, "common")
    return counted.withColumn("mark", mark)
