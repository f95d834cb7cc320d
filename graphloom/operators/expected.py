"""Expected edge counts in a random graph with given expected degrees, and their statistics.

An edge between degrees k and l has probability min(1, kl/2M). Sums over vertex pairs
are sums over pairs of distinct degrees: the number of pairs with kl > 2M plus the
exact integer sum of the other products, divided by 2M once. For each degree k, the
other degrees are cut at 2M/k, and running sums over the sorted degrees give both parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import poisson
from graphloom.operators.graph import Graph, _per_set, disjoint

METHODS = ("accurate", "optimized", "fast")


def _exact(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def _product(a: Column, b: Column) -> Column:
    """An exact integer product: whole up to 38 digits."""
    return _exact(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))


def _capped_sum(k: Column, other: Column, pairs: Column, two_m: Column) -> Column:
    """Sum of pairs * min(1, k * other / 2M) in exact integers until the last division."""
    product = k * other
    sure = F.coalesce(F.sum(F.when(product > two_m, pairs)), F.lit(0)).cast("double")
    rest = F.sum(F.when(product <= two_m, _exact(pairs.cast("decimal(18,0)") * product.cast("decimal(19,0)"))))
    return sure + F.coalesce(F.try_divide(rest.cast("double"), two_m.cast("double")), F.lit(0.0))


def _capped_by_levels(asked: DataFrame, two_m: Column, levels: DataFrame | None = None) -> DataFrame:
    """(set_id, lambda): sum of n * o * min(1, k * l / 2M) over the asked (set_id, k, n) and the levels (set_id, l, o).

    Without ``levels`` the sum is over the asked members among themselves, pairs of a
    member with itself left out. Both tables are merged by one sort per set; what the
    levels up to 2M / k add up to is read off their running sums. That is D log D for D
    distinct degrees, where a join would make D² rows. All sums are exact until the last
    division.
    """
    none = F.lit(None).cast("long")

    def row(upto: Column, kind: int, **given: str) -> Column:
        kept = [F.col(given[c]).alias(c) if c in given else none.alias(c) for c in "knlo"]
        return F.struct(upto.alias("upto"), F.lit(kind).alias("kind"), *kept)

    # a degree of 0 takes part in no edge
    question = row(F.expr("m2 div greatest(k, 1)"), 1, k="k", n="n")
    itself = levels is None
    asked = asked.withColumn("m2", two_m)
    if itself:
        both = asked.select("set_id", F.inline(F.array(question, row(F.col("k"), 0, l="k", o="n"))))
    else:
        both = asked.select("set_id", F.inline(F.array(question)))
        both = both.unionByName(levels.select("set_id", F.inline(F.array(row(F.col("l"), 0, l="l", o="o")))))
    running = Window.partitionBy("set_id").orderBy("upto", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # a set's degrees add up to 2M at most, so whole numbers of 64 bits hold the running sums
    sums = both.select(
        *("set_id", "k", "n", "o", "upto"),
        F.coalesce(F.sum("o").over(running), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.col("l") * F.col("o")).over(running), F.lit(0)).alias("total"),
    )
    k, n, own = F.col("k"), F.col("n"), F.col("k") <= F.col("upto")
    sure, rest = n * F.col("count"), _product(n * k, F.col("total"))
    if itself:
        sure = sure + F.when(own, 0).otherwise(n)
        rest = rest - F.when(own, _product(n * k, k)).otherwise(_exact(F.lit(0)))
    found = sums.groupBy("set_id").agg(
        (F.sum("n") * F.sum("o") - F.sum(sure)).alias("sure"), F.sum(_exact(rest)).alias("rest")
    )
    rest = F.try_divide(F.col("rest").cast("double"), two_m.cast("double"))
    return found.select("set_id", (F.coalesce("sure", F.lit(0)).cast("double") + F.coalesce(rest, F.lit(0.0))).alias("lambda"))


def lambda_between(graph: Graph, sets1: DataFrame, sets2: DataFrame, method: str = "optimized") -> DataFrame:
    """(set_id, lambda): expected edges between the disjoint parts of each pair of sets.

    ``accurate`` sums over vertex pairs (for validation: its work is the product of the
    sizes), ``optimized`` gives the same over pairs of distinct degrees, ``fast`` leaves
    out the cap at 1. A pair with an empty part has 0.
    """
    two_m = graph.two_m()
    sides = [x.join(graph.degrees, "v").withColumn("times", F.lit(1)) for x in disjoint(sets1, sets2)]
    if method == "fast":
        sums = [s.groupBy("set_id").agg(F.sum("k").alias(f"k{i}")) for i, s in enumerate(sides)]
        found = sums[0].join(sums[1], "set_id")
        product = F.col("k0").cast("double") * F.col("k1")
        found = found.select("set_id", F.try_divide(product, two_m).alias("lambda"))
    elif method == "optimized":
        one, two = (graph.histogram(s) for s in sides)
        levels = two.select("set_id", F.col("k").alias("l"), F.col("n").alias("o"))
        found = _capped_by_levels(one, two_m, levels)
    elif method == "accurate":
        one, two = sides
        pairs = one.select("set_id", "k").join(two.select("set_id", F.col("k").alias("l")), "set_id").withColumn("m2", two_m)
        total = F.sum(F.least(F.lit(1.0), F.col("k") * F.col("l") / F.col("m2")))
        found = pairs.groupBy("set_id").agg(total.alias("lambda"))
    else:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    return _per_set(sets1.select("set_id").union(sets2.select("set_id")), found, **{"lambda": 0.0})


def lambda_within(graph: Graph, sets: DataFrame, method: str = "optimized", dedupe: bool = True) -> DataFrame:
    """(set_id, lambda): expected edges within each set; methods as in ``lambda_between``.

    A set with fewer than two known members has 0.
    """
    two_m = graph.two_m()
    members = graph.members(sets, dedupe)
    levels = graph.histogram(members)
    if method == "fast":
        k, n = F.col("k").cast("decimal(19,0)"), F.col("n")
        sums = levels.groupBy("set_id").agg(
            F.sum(_exact(k * n)).alias("s"), F.sum(_exact(k * k * n)).alias("q"), F.sum("n").alias("n")
        )
        value = F.try_divide(_exact(F.col("s") * F.col("s") - F.col("q")).cast("double"), 2 * two_m)
        found = sums.select("set_id", F.when(F.col("n") > 1, value).otherwise(0.0).alias("lambda"))
    elif method == "optimized":
        # over all ordered pairs of members, less each member with itself, halved
        found = _capped_by_levels(levels, two_m)
        found = found.select("set_id", (F.col("lambda") / 2).alias("lambda"))
    elif method == "accurate":
        if not dedupe:
            members = members.select("set_id", "v", "k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
        else:
            members = members.withColumn("copy", F.lit(1))
        place = F.struct("v", "copy")
        one = members.select("set_id", "k", place.alias("p"))
        two = members.select("set_id", F.col("k").alias("l"), place.alias("q"))
        pairs = one.join(two, "set_id").where(F.col("p") < F.col("q")).withColumn("m2", two_m)
        found = pairs.groupBy("set_id").agg(F.sum(F.least(F.lit(1.0), F.col("k") * F.col("l") / F.col("m2"))).alias("lambda"))
    else:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    return _per_set(sets, found, **{"lambda": 0.0})


def edge_count_statistics(
    graph: Graph,
    sets1: DataFrame,
    sets2: DataFrame | None = None,
    observed: DataFrame | None = None,
    method: str = "optimized",
) -> DataFrame:
    """How far the edges within sets, or between pairs of sets, exceed expectation.

    Columns: ``set_id``, ``p_value``, ``z_score``, ``log2_Anscombe_ratio``,
    ``log2_relative_change``. ``observed`` (set_id, edge_count) is counted in the same
    plan if it is not given. The truncation bound of a pair ignores that its sets may
    overlap, while the expectation does not count common members.
    """
    if sets2 is None:
        lam, most = lambda_within(graph, sets1, method), graph.max_within(sets1)
        seen = graph.count_within(sets1) if observed is None else observed
    else:
        lam, most = lambda_between(graph, sets1, sets2, method), graph.max_between(sets1, sets2)
        seen = graph.count_between(sets1, sets2) if observed is None else observed
    rows = lam.join(most, "set_id").join(seen, "set_id")
    x, expected = F.col("edge_count"), F.col("lambda")
    return rows.select(
        "set_id",
        poisson.p_value(x, F.col("max_edges"), expected).alias("p_value"),
        poisson.z_score(x, expected).alias("z_score"),
        poisson.anscombe_ratio(x, expected).alias("log2_Anscombe_ratio"),
        poisson.relative_change(x, expected).alias("log2_relative_change"),
    )


def suitability(graph: Graph) -> DataFrame:
    """How often the model's edge probability would exceed 1, over all pairs of distinct degrees.

    Columns: ``measure`` (``pij`` or ``capped_pij``), ``minimum``, ``q1``, ``median``,
    ``mean``, ``q3``, ``maximum`` over the unweighted grid of distinct degrees (degree 0
    included), and ``pij_over_1``, the share of ordered vertex pairs with kl/2M >= 1.
    Empty for an empty graph.

    The grid is never made. The distinct degrees go to one task: D different ones add up
    to at least D(D-1)/2 edge ends, so there are at most 2 sqrt(M) + 1 of them, two million
    for a trillion edges. Quantiles are found by bisection on the product, counting the
    cells below it by binary search in the sorted degrees.
    """
    levels = graph.degrees.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("m2", graph.two_m())
    names = ("minimum", "q1", "median", "mean", "q3", "maximum", "pij_over_1")
    schema = "measure string, " + ", ".join(f"{n} double" for n in names)
    return levels.groupBy("m2").applyInPandas(_grid_summary, schema)


def _grid_summary(levels: pd.DataFrame) -> pd.DataFrame:
    levels = levels.sort_values("k")
    k, n, m2 = levels["k"].to_numpy(np.int64), levels["n"].to_numpy(np.float64), int(levels["m2"].iloc[0])
    cells = len(k) ** 2
    positive = k[k > 0]
    zeros = cells - len(positive) ** 2

    def ranked(rank: int) -> int:
        """The product of the given rank, from 0."""
        low, high = -1, int(k[-1]) ** 2  # at most rank cells up to low, more up to high
        while high - low > 1:
            middle = (low + high) // 2
            below = zeros + int(np.searchsorted(positive, middle // positive, "right").sum())
            low, high = (low, middle) if below > rank else (middle, high)
        return high

    def quantile(p: float, most: float) -> float:
        at = p * (cells - 1)
        low, high = (min(most, ranked(r) / m2) for r in (int(np.floor(at)), int(np.ceil(at))))
        return low + (high - low) * (at - np.floor(at))

    cut = np.searchsorted(positive, m2 // positive, "right") if len(positive) else positive
    sums = np.concatenate(([0.0], np.cumsum(positive.astype(np.float64))))
    capped = float((len(positive) - cut).sum() + (positive * sums[cut]).sum() / m2)
    whole = float(sums[-1] ** 2 / m2)
    tail = np.concatenate((np.cumsum(n[::-1])[::-1], [0.0]))
    with np.errstate(divide="ignore"):
        least = np.where(k > 0, -(-m2 // np.maximum(k, 1)), k[-1] + 1)  # the smallest partner with kl >= 2M
    over = float((n * tail[np.searchsorted(k, least)]).sum() / n.sum() ** 2)
    rows = []
    for measure, most, total in (("pij", np.inf, whole), ("capped_pij", 1.0, capped)):
        q1, median, q3 = (quantile(p, most) for p in (0.25, 0.5, 0.75))
        ends = [min(most, int(x) ** 2 / m2) for x in (k[0], k[-1])]
        rows.append((measure, ends[0], q1, median, total / cells, q3, ends[1], over))
    return pd.DataFrame(rows, columns=["measure", "minimum", "q1", "median", "mean", "q3", "maximum", "pij_over_1"])
