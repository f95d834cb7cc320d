"""Simple undirected graphs as DataFrames, with edge counts and their bounds for many vertex sets at once.

Vertex sets are DataFrames (set_id, v); one job answers all of them. Unknown vertices,
nulls and unknown set members are ignored; a set without known members gives 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import incidence
from graphloom.sources.edges import read_edges, two_columns


@dataclass(frozen=True)
class Graph:
    """``edges`` (v, nbr) holds every edge in both directions, ``degrees`` (v, k) every vertex once."""

    edges: DataFrame
    degrees: DataFrame

    @classmethod
    def from_edges(cls, df: DataFrame, col1: int | str = 1, col2: int | str = 2) -> Graph:
        """The simple graph of a table's two columns.

        Self-loops, repeated and reversed edges collapse; rows with an empty id are
        dropped; a null id drops the edge but keeps the other vertex. A vertex seen only
        in dropped edges has degree 0. Without any proper edge the graph is empty.

        One shuffle makes the edges distinct in one direction, one more counts degrees,
        both combined on the map side.
        """
        pairs = two_columns(df, col1, col2)
        pairs = pairs.where((F.coalesce("a", F.lit("-")) != "") & (F.coalesce("b", F.lit("-")) != ""))
        half = pairs.where(F.col("a") != F.col("b"))
        half = half.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        turn = F.inline(
            F.array(
                F.struct(F.col("a").alias("v"), F.col("b").alias("nbr")),
                F.struct(F.col("b").alias("v"), F.col("a").alias("nbr")),
            )
        )
        edges = half.select(turn)
        mentioned = pairs.select(F.explode(F.array("a", "b")).alias("v")).where(F.col("v").isNotNull())
        counted = edges.select("v", F.lit(1).alias("one")).unionByName(mentioned.select("v", F.lit(0).alias("one")))
        degrees = counted.groupBy("v").agg(F.sum("one").alias("k"))
        return cls(edges, degrees.where(pairs.where(F.col("a") != F.col("b")).limit(1).exists()))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, col1: int | str = 1, col2: int | str = 2, **options) -> Graph:
        """The graph of a delimited file; ``options`` as in ``read_edges``."""
        return cls.from_edges(read_edges(spark, path, **options), col1, col2)

    @classmethod
    def from_graph(cls, graph) -> Graph:
        """The simple graph of a graph object: anything with an ``edges`` DataFrame of ``src``/``dst`` or ``from``/``to``.

        Directions and other attributes are ignored; vertices without a row in ``edges``
        are not taken in. TypeError for an object without such a frame.
        """
        edges = getattr(graph, "edges", None)
        for ends in (("src", "dst"), ("from", "to")):
            if isinstance(edges, DataFrame) and set(ends) <= set(edges.columns):
                return cls.from_edges(edges, *ends)
        raise TypeError("a graph object has an edges DataFrame with the columns src and dst, or from and to")

    def persist(self) -> Graph:
        """Keep edges and degrees for several queries; lost parts are computed again."""
        self.edges.persist()
        self.degrees.persist()
        return self

    def unpersist(self) -> None:
        self.edges.unpersist()
        self.degrees.unpersist()

    def moments(self) -> DataFrame:
        """One row: ``m`` edges, ``n`` vertices, ``average_degree`` (null for an empty graph)."""
        total = self.degrees.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k2"), F.count(F.lit(1)).alias("n"))
        return total.select(
            F.expr("k2 div 2").alias("m"), "n", F.try_divide(F.col("k2").cast("double"), F.col("n")).alias("average_degree")
        )

    def two_m(self) -> Column:
        """2M, as a scalar subquery: the rows of ``edges``, whose shuffle it shares."""
        return self.edges.agg(F.count(F.lit(1)).alias("k2")).scalar()

    def to_dataframe(self, one_direction: bool = False) -> DataFrame:
        """(from_id, to_id): every edge in both directions, or once with the smaller id first."""
        rows = self.edges.where(F.col("v") < F.col("nbr")) if one_direction else self.edges
        return rows.select(F.col("v").alias("from_id"), F.col("nbr").alias("to_id"))

    def adjacency(self) -> DataFrame:
        """(v, neighbors): sorted neighbours of every vertex, empty for isolated ones.

        The array form of one hub is one row; use ``edges`` where hubs may be huge.
        """
        lists = self.edges.groupBy("v").agg(F.array_sort(F.collect_list("nbr")).alias("neighbors"))
        joined = self.degrees.join(lists, "v", "left")
        return joined.select("v", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"))

    def neighbors(self, sets: DataFrame) -> DataFrame:
        """(set_id, v): the distinct neighbours of the members of every set; members may be among them.

        Up to ``incidence.MEMBERS`` members are collected when this is called, and the sets
        of every neighbour are found in one place, so that only edges cross the shuffle. More
        members are joined, and the neighbours of all sets made distinct by a shuffle.
        """
        wanted = _members(sets).select("set_id", "v")
        members = incidence.collected(wanted, "set_id", "v")
        if members is None:
            return self.edges.join(wanted, "v").select("set_id", F.col("nbr").alias("v")).distinct()
        rows = incidence.by_key(self.edges, "nbr", "v", members)
        kind = wanted.schema["set_id"].dataType
        shared = sets.sparkSession.sparkContext.broadcast((members.starts, members.held, members.ids))
        found = rows.mapInArrow(
            incidence.met_sets(shared, members.ids.type), f"key string, sets array<{kind.simpleString()}>"
        )
        return found.select(F.explode("sets").alias("set_id"), F.col("key").alias("v"))

    def members(self, sets: DataFrame, dedupe: bool = True) -> DataFrame:
        """(set_id, v, k, times): the known members of every set with their degrees and multiplicity."""
        counted = _members(sets, dedupe)
        return counted.join(self.degrees, "v").select("set_id", "v", "k", "times")

    def count_within(self, sets: DataFrame, dedupe: bool = True) -> DataFrame:
        """(set_id, edge_count): edges between members of each set, as a double.

        With ``dedupe=False`` a repeated member counts its edges as often, which inflates
        the count by halves.
        """
        ends = _members(sets).select("set_id", F.col("v").alias("nbr"))
        half = self.edges.where(F.col("v") < F.col("nbr")) if dedupe else self.edges
        inside = half.join(_members(sets, dedupe), "v").join(ends, ["set_id", "nbr"])
        count = F.sum("times") if dedupe else F.sum("times") / 2
        found = inside.groupBy("set_id").agg(count.cast("double").alias("edge_count"))
        return _per_set(sets, found, edge_count=0.0)

    def count_between(self, sets1: DataFrame, sets2: DataFrame) -> DataFrame:
        """(set_id, edge_count): edges between the parts of each pair of sets that they do not share."""
        one, two = disjoint(sets1, sets2)
        ends = two.select("set_id", F.col("v").alias("nbr"))
        found = self.edges.join(one, "v").join(ends, ["set_id", "nbr"])
        found = found.groupBy("set_id").agg(F.count(F.lit(1)).cast("double").alias("edge_count"))
        return _per_set(sets1.select("set_id").union(sets2.select("set_id")), found, edge_count=0.0)

    def max_within(self, sets: DataFrame, dedupe: bool = True) -> DataFrame:
        """(set_id, max_edges): n(n-1)/2 for the n known members."""
        sized = self.members(sets, dedupe).groupBy("set_id").agg(F.sum("times").alias("n"))
        n = F.col("n").cast("double")
        return _per_set(sets, sized.select("set_id", (n * (n - 1) / 2).alias("max_edges")), max_edges=0.0)

    def max_between(self, sets1: DataFrame, sets2: DataFrame, dedupe: bool = True) -> DataFrame:
        """(set_id, max_edges): the product of the numbers of known members; the sets may overlap."""
        sizes = [
            self.members(s, dedupe).groupBy("set_id").agg(F.sum("times").cast("double").alias(f"n{i}"))
            for i, s in enumerate((sets1, sets2))
        ]
        found = sizes[0].join(sizes[1], "set_id").select("set_id", (F.col("n0") * F.col("n1")).alias("max_edges"))
        return _per_set(sets1.select("set_id").union(sets2.select("set_id")), found, max_edges=0.0)

    def max_within_degrees(self, sets: DataFrame, dedupe: bool = True) -> DataFrame:
        """(set_id, max_edges): most edges within each set when no member exceeds its degree.

        The greedy choice has no relational form; it runs once per set on the histogram
        of degrees. The histogram has one entry per distinct degree, but the choice takes
        one step per member: about 12 seconds for a million members.
        """
        levels = self.histogram(self.members(sets, dedupe))
        found = levels.groupBy("set_id").applyInPandas(
            _greedy_per_set, f"set_id {levels.schema['set_id'].dataType.simpleString()}, max_edges double"
        )
        return _per_set(sets, found, max_edges=0.0)

    def max_between_degrees(self, sets1: DataFrame, sets2: DataFrame) -> DataFrame:
        """(set_id, max_edges): most edges between the disjoint parts when no vertex exceeds its degree.

        The minimum, over i, of the degrees of the first part after its i largest plus
        the sum of min(degree, i) over the second part. The expression is linear between
        the cumulative counts of the first part's degree levels and the degrees of the
        second part, so only these i are tried. Levels and tries are merged by one sort per
        set, and running sums give both terms: D log D for D distinct degrees.
        """
        one, two = (self.histogram(x.join(self.degrees, "v").withColumn("times", F.lit(1))) for x in disjoint(sets1, sets2))
        down = Window.partitionBy("set_id").orderBy(F.col("k").desc())
        one = one.withColumns({"upto": F.sum("n").over(down), "next": F.coalesce(F.lead("k").over(down), F.lit(0))})
        top = one.groupBy("set_id").agg(F.max("k").alias("next"), F.sum("n").alias("n1"))
        n2 = two.groupBy("set_id").agg(F.sum("n").alias("n2"))
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

        def events(rows: DataFrame, at: Column, kind: int, taken=zero, upto=none, following=none, held=zero, many=zero) -> DataFrame:
            columns = {"i": at, "kind": F.lit(kind), "taken": taken, "upto": upto, "next": following, "held": held, "many": many}
            return rows.select("set_id", *[c.cast("int" if n == "kind" else "long").alias(n) for n, c in columns.items()])

        # the first part's levels in falling order, at the number of vertices down to them
        merged = events(one, F.col("upto"), 0, F.col("k") * F.col("n"), F.col("upto"), F.col("next"))
        merged = merged.unionByName(events(top, zero, 0, upto=zero, following=F.col("next")))
        # the second part's levels at their degree
        merged = merged.unionByName(events(two, F.col("k"), 0, held=F.col("k") * F.col("n"), many=F.col("n")))
        tries = one.select("set_id", F.col("upto").alias("i")).union(top.select("set_id", zero))
        tries = tries.union(two.join(top, "set_id").select("set_id", F.least("k", "n1"))).distinct()
        merged = merged.unionByName(events(tries, F.col("i"), 1))
        whole = Window.partitionBy("set_id")
        running = whole.orderBy("i", "kind").rowsBetween(Window.unboundedPreceding, 0)
        # of levels at one place, only those of the first part have a following degree
        begun = F.max(F.when(F.col("next").isNotNull(), F.struct("upto", "next"))).over(running)
        sums = merged.select(
            "set_id",
            "kind",
            "i",
            (F.sum("taken").over(whole) - F.sum("taken").over(running)).alias("rest"),
            begun.alias("level"),
            F.sum("held").over(running).alias("held"),
            (F.sum("many").over(whole) - F.sum("many").over(running)).alias("above"),
        ).where("kind = 1")
        rest = F.col("rest") - (F.col("i") - F.col("level.upto")) * F.col("level.next")
        found = sums.join(n2, "set_id", "left_semi").groupBy("set_id")
        found = found.agg(F.min(rest + F.col("held") + F.col("i") * F.col("above")).cast("double").alias("max_edges"))
        return _per_set(sets1.select("set_id").union(sets2.select("set_id")), found, max_edges=0.0)

    @staticmethod
    def histogram(members: DataFrame) -> DataFrame:
        """(set_id, k, n): how many members of each set have each degree."""
        return members.groupBy("set_id", "k").agg(F.sum("times").alias("n"))


def one_set(spark: SparkSession, vertices: list[str], set_id: int = 0) -> DataFrame:
    """A set DataFrame from a list, for single calls."""
    return spark.createDataFrame([(set_id, v) for v in vertices], "set_id int, v string")


def _members(sets: DataFrame, dedupe: bool = True) -> DataFrame:
    """(set_id, v, times) without nulls, one row per distinct member."""
    times = F.lit(1).cast("long") if dedupe else F.count(F.lit(1))
    rows = sets.select("set_id", F.col("v").cast("string").alias("v")).where(F.col("v").isNotNull())
    return rows.groupBy("set_id", "v").agg(F.max(times).alias("times") if dedupe else times.alias("times"))


def disjoint(sets1: DataFrame, sets2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of each pair of sets that are in one of the two only, as (set_id, v)."""
    tagged = _members(sets1).select("set_id", "v", F.lit(1).alias("side"))
    tagged = tagged.unionByName(_members(sets2).select("set_id", "v", F.lit(2).alias("side")))
    alone = tagged.groupBy("set_id", "v").agg(F.sum("side").alias("side"))
    return tuple(alone.where(F.col("side") == i).select("set_id", "v") for i in (1, 2))


def _per_set(sets: DataFrame, found: DataFrame, **defaults) -> DataFrame:
    """``found`` completed by the sets that are missing in it, with default values."""
    every = sets.select("set_id").distinct().join(found, "set_id", "left")
    return every.select("set_id", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in defaults.items()])


def greedy_edges(degrees: np.ndarray, counts: np.ndarray) -> float:
    """Most edges of a simple graph with ``counts`` vertices of at most ``degrees`` each.

    Repeatedly, vertices without room are dropped, the others are capped at the number of
    possible partners, and the one with most room takes its partners among those with
    most room. Vertices are kept as counts per degree.
    """
    room = np.zeros(int(degrees.max(initial=0)) + 2, np.int64)
    np.add.at(room, degrees.astype(np.int64), counts.astype(np.int64))
    room[0] = 0
    total = 0
    left = int(room.sum())
    top = len(room) - 1
    while left >= 2:
        if top > left - 1:  # cap
            room[left - 1] += room[left : top + 1].sum()
            room[left : top + 1] = 0
            top = left - 1
        while top > 0 and not room[top]:
            top -= 1
        if top < 1:
            break
        total += top
        room[top] -= 1
        need, level = top, top
        # whole levels move down by one, from the top; of the last level only as many as needed
        while need > room[level]:
            need -= int(room[level])
            level -= 1
        partial = need
        moved = room[level + 1 : top + 1].copy()
        room[level + 1 : top + 1] = 0
        room[level] -= partial
        room[level - 1] += partial
        room[level : level + len(moved)] += moved
        room[0] = 0
        left = int(room.sum())
    return float(total)


def _greedy_per_set(levels: pd.DataFrame) -> pd.DataFrame:
    edges = greedy_edges(levels["k"].to_numpy(), levels["n"].to_numpy())
    return pd.DataFrame({"set_id": [levels["set_id"].iloc[0]], "max_edges": [edges]})
