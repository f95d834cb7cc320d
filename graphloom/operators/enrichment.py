"""Terms scored against sets or ranked lists of elements on the bipartite graph of terms and elements."""

from __future__ import annotations

import functools
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import poisson
from graphloom.operators import incidence
from graphloom.operators.expected import METHODS, _capped_sum
from graphloom.operators.graph import Graph
from graphloom.operators.skew import weighted_percentiles
from graphloom.session import durable
from graphloom.sources.edges import read_edges, two_columns

#: Ranks that one task sorts; prefix sums run over blocks of so many, then over the blocks.
RANK_BLOCK = 1 << 16
STATISTICS = ("lambda", "z_score", "log2_anscombe_ratio", "log2_relative_change", "p_value", "element_relative_rank")
SCORES = ("p_value", "z_score", "lambda", "observed_edges", "log2_Anscombe", "log2_RelChange")


@dataclass(frozen=True)
class TermScoring:
    """``pairs`` (term, element) holds every edge once; ``terms`` (term, k) and ``elements`` (element, k) the degrees."""

    graph: Graph
    pairs: DataFrame
    terms: DataFrame
    elements: DataFrame

    @classmethod
    def from_edges(
        cls, df: DataFrame, col_term: int | str = 1, col_element: int | str = 2, check: bool = True
    ) -> TermScoring:
        """The bipartite graph of a term column and an element column; empty input is allowed.

        Rows with an empty or null id make no edge. ValueError if an id is both a term
        and an element (``check``: one small job looks for the first five).
        """
        rows = two_columns(df, col_term, col_element, ("term", "element"))
        rows = rows.where((F.col("term") != "") & (F.col("element") != ""))
        pairs = rows.where(F.col("term") != F.col("element")).distinct()
        if check:
            both = rows.select("term").intersect(rows.select("element")).orderBy("term").limit(5).collect()
            if both:
                raise ValueError("ids are both terms and elements: " + ", ".join(r["term"] for r in both))
        terms = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("k"))
        elements = pairs.groupBy("element").agg(F.count(F.lit(1)).alias("k"))
        return cls(Graph.from_edges(rows), pairs, terms, elements)

    @classmethod
    def from_file(
        cls, spark: SparkSession, path: str, col_term: int | str = 1, col_element: int | str = 2, **options
    ) -> TermScoring:
        """From a delimited file; ``options`` as in ``read_edges``."""
        return cls.from_edges(read_edges(spark, path, **options), col_term, col_element)

    def two_m(self) -> Column:
        """2M, as a scalar subquery; every edge of the bipartite graph counts once for a term."""
        return self.pairs.agg((F.count(F.lit(1)) * 2).alias("k2")).scalar()


def score_element_set(
    scoring: TermScoring, sets: DataFrame, method: str = "optimized", digits: int | None = None
) -> DataFrame:
    """Every term with an edge to a set of elements, for each set (set_id, v).

    Columns: ``set_id``, ``term_id``, ``p_value``, ``z_score``, ``lambda``,
    ``observed_edges``, ``log2_Anscombe``, ``log2_RelChange``. Repeated, unknown and null
    members are ignored; a set without known elements or connected terms gives no rows.
    Doubles are rounded to ``digits`` if they are given.

    The expectation of a term depends on its degree only, and its statistics on the number
    of its edges besides: they are computed once for all terms of a block that share these.
    Up to ``incidence.MEMBERS`` known members are collected when this is called, and a term
    is counted against all sets in one place, so that only edges cross the shuffle; more
    members are joined, which shuffles every pair of a set and a term.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    known = sets.select("set_id", F.col("v").cast("string").alias("element")).distinct().join(scoring.elements, "element")
    members = incidence.collected(
        known.where(F.col("set_id").isNotNull()).withColumn("m2", scoring.two_m()), "set_id", "element"
    )
    if members is None:
        rows = _joined_scores(scoring, known, method)
        return rows if digits is None else rows.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in rows.dtypes])
    shared = sets.sparkSession.sparkContext.broadcast(_set_levels(members) | {"starts": members.starts, "held": members.held})
    edges = incidence.by_key(scoring.pairs, "term", "element", members, others=True)
    kind = known.schema["set_id"].dataType.simpleString()
    schema = f"set_id {kind}, term_id string, " + ", ".join(f"{c} double" for c in SCORES)
    return edges.mapInArrow(_scorer(shared, members.ids, method, digits), schema)


def _set_levels(members: incidence.Members) -> dict:
    """Of every set, its size and sum of degrees, and its distinct degrees with running sums, rising."""
    k, sets, n = members.table.column("k").to_numpy().astype(np.int64), members.sets, len(members.ids)
    two_m = int(members.table.column("m2")[0].as_py()) if len(k) else 0
    span = int(k.max(initial=0)) + 2
    levels, times = np.unique(sets * span + k, return_counts=True)
    degrees = levels % span
    return {
        "size": np.bincount(sets, minlength=n),
        "total": np.bincount(sets, weights=k, minlength=n).astype(np.int64),
        "two_m": two_m,
        "span": span,
        "levels": levels,
        "times": times,
        "ends": np.searchsorted(levels, np.arange(n + 1) * span),
        "members": np.concatenate(([0], np.cumsum(times))),
        "sums": np.concatenate(([0], np.cumsum(times * degrees))),
    }


def _set_lambda(of: dict, sets: np.ndarray, k: np.ndarray, method: str) -> np.ndarray:
    """The expected edges of a term of degree k with a set, for many (set, k)."""
    two_m = of["two_m"]
    if method == "fast":
        return k.astype(float) * of["total"][sets] / two_m
    begin, end = of["ends"][sets], of["ends"][sets + 1]
    if method == "accurate":
        out, degrees = np.zeros(len(sets)), of["levels"] % of["span"]
        for part in incidence.even_slices(end - begin, incidence.CELLS):
            places = incidence.stretches(begin[part], (end - begin)[part])
            at = np.repeat(np.arange(len(sets))[part], (end - begin)[part])
            chance = np.minimum(1.0, k[at].astype(float) * degrees[places] / two_m)
            out += np.bincount(at, of["times"][places] * chance, len(sets))
        return out
    # levels up to 2M / k have a chance below 1; exact integers until the last division
    cut = np.searchsorted(of["levels"], sets * of["span"] + np.minimum(two_m // k, of["span"] - 1), "right")
    below = of["sums"][cut] - of["sums"][begin]
    if int(k.max(initial=0)) * int(below.max(initial=0)) >= 1 << 63:
        k, below = k.astype(object), below.astype(object)
    return (of["members"][end] - of["members"][cut]).astype(float) + (k * below).astype(float) / two_m


def _scorer(shared, ids: pa.Array, method: str, digits: int | None):
    """For ``mapInArrow``: the scores of (key, code) rows sorted by key."""

    def run(batches):
        of = shared.value
        for names, sizes, counts in incidence.counted(batches, of["starts"], of["held"], len(ids)):
            at, sets = np.nonzero(counts)
            degrees, place = np.unique(sizes, return_inverse=True)
            codes, (k, s, x) = incidence.factorized(place[at], sets, counts[at, sets])
            x, m = x.astype(float), of["size"][s]
            both, (pair_k, pair_s) = incidence.factorized(k, s)
            lam = _set_lambda(of, pair_s, degrees[pair_k], method)[both]
            columns = [
                poisson.truncated_tail(x, m, lam),
                (x - lam) / np.sqrt(lam),
                lam,
                x,
                (np.log2(x + 0.375) - np.log2(lam + 0.375)) / 2,
                np.log2(x) - np.log2(lam),
            ]
            columns = [incidence.rounded(c, digits) for c in columns]
            for i in range(0, len(at), incidence.BATCH):
                part = slice(i, i + incidence.BATCH)
                rows = [ids.take(pa.array(sets[part])), names.take(pa.array(at[part]))]
                rows += [pa.array(c[codes[part]], from_pandas=True) for c in columns]
                yield pa.RecordBatch.from_arrays(rows, ["set_id", "term_id", *SCORES])

    return run


def _joined_scores(scoring: TermScoring, known: DataFrame, method: str) -> DataFrame:
    """``score_element_set`` of known members (set_id, element, k) by joins: every pair of a set and a term is shuffled."""
    sized = known.groupBy("set_id").agg(F.count(F.lit(1)).alias("size"), F.sum("k").alias("total"))
    hits = scoring.pairs.join(known.select("set_id", "element"), "element").groupBy("set_id", "term")
    hits = hits.agg(F.count(F.lit(1)).cast("double").alias("observed_edges")).join(scoring.terms, "term")
    two_m = scoring.two_m()
    degrees = hits.select("set_id", "k").distinct().withColumn("m2", two_m)
    if method == "fast":
        lam = degrees.join(sized, "set_id")
        lam = lam.select("set_id", "k", (F.col("k").cast("double") * F.col("total") / F.col("m2")).alias("lambda"))
    else:
        levels = known.groupBy("set_id", F.col("k").alias("l")).agg(F.count(F.lit(1)).alias("n"))
        total = _capped_sum(F.col("k"), F.col("l"), F.col("n"), F.col("m2"))
        if method == "accurate":
            total = F.sum(F.col("n") * F.least(F.lit(1.0), F.col("k") * F.col("l") / F.col("m2")))
        lam = degrees.join(levels, "set_id").groupBy("set_id", "k", "m2").agg(total.alias("lambda")).drop("m2")
    rows = hits.join(lam, ["set_id", "k"]).join(sized, "set_id")
    x, expected = F.col("observed_edges"), F.col("lambda")
    return rows.select(
        "set_id",
        F.col("term").alias("term_id"),
        poisson.p_value(x, F.col("size"), expected).alias("p_value"),
        poisson.z_score(x, expected).alias("z_score"),
        "lambda",
        "observed_edges",
        poisson.anscombe_ratio(x, expected).alias("log2_Anscombe"),
        poisson.relative_change(x, expected).alias("log2_RelChange"),
    )


def _prefix_sum(df: DataFrame, group: list[str], rank: str, value: Column, name: str, blocks: bool) -> DataFrame:
    """Running sum of ``value`` by ``rank`` within ``group``; rows of one rank in a stable order.

    One sort per group, or, with ``blocks``, two levels: within blocks of ``RANK_BLOCK``
    ranks, and over the blocks' totals. No task then holds more than one block, or one
    total per block, of a group.
    """
    order = [F.col(rank).asc_nulls_last(), "element"]
    if not blocks:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(upto))
    block = F.floor((F.col(rank) - 1) / RANK_BLOCK).alias("__block")
    rows = df.select("*", block, value.alias("__value"))
    inner = Window.partitionBy(*group, "__block").orderBy(*order)
    rows = rows.withColumn("__inner", F.sum("__value").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*group, "__block").agg(F.sum("__value").alias("__total"))
    outer = Window.partitionBy(*group).orderBy(F.col("__block").asc_nulls_last())
    outer = outer.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "__block", F.coalesce(F.sum("__total").over(outer), F.lit(0)).alias("__before"))
    on = functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "__block"]])
    joined = rows.alias("a").join(totals.alias("b"), on)
    kept = [F.col(f"a.`{c}`") for c in df.columns]
    return joined.select(*kept, (F.col("a.__inner") + F.col("b.__before")).alias(name))


def rank_profiles(
    scoring: TermScoring,
    ranks: DataFrame,
    terms: DataFrame | None = None,
    rank_mode: str = "cumulative",
    missing: bool = False,
    check: bool = False,
) -> DataFrame:
    """Running enrichment of every term along ranked lists (list_id, element, rank).

    One row per list, term and element of the term: ``list_id``, ``term_id``,
    ``element``, ``element_relative_rank`` (rank over the number of elements known to the
    scoring), ``lambda``, ``observed_ec``, ``max_ec``, ``term_size``, ``z_score``,
    ``log2_anscombe_ratio``, ``log2_relative_change``, ``p_value``. With ``missing``, the
    elements of a term that a list lacks come last, with null statistics; the result then
    has every edge for every list (up to ``incidence.MEMBERS`` rows of lists are collected
    for that when this is called; more are joined). Repeated rows of a list, unknown
    elements and unknown or repeated ``terms`` (term) are ignored; ``check`` warns of the
    unknown ones and raises ValueError if none is known.

    ``rank_mode``: ``cumulative`` expects from a term the degrees of all known elements
    of its rank or better; ``positional`` takes the sum at the position that the rank
    denotes among all known vertices of the list. On a permutation of known elements
    both are the same.
    """
    if rank_mode not in ("cumulative", "positional"):
        raise ValueError("rank_mode is cumulative or positional")
    listed = ranks.select("list_id", F.col("element").cast("string").alias("element"), F.col("rank").cast("long").alias("rank"))
    listed = listed.where(F.col("element").isNotNull() & F.col("rank").isNotNull()).distinct()
    pairs, sizes = scoring.pairs, scoring.terms
    if terms is not None:
        wanted = terms.select(F.col("term").cast("string").alias("term")).distinct()
        pairs, sizes = pairs.join(wanted, "term", "left_semi"), sizes.join(wanted, "term", "left_semi")
    if check:
        _report(listed.select("element"), scoring.elements, "element", "ranked elements")
        if terms is not None:
            _report(wanted, scoring.terms, "term", "terms")
    # lists of at most one block of ranks, which one pass over the lists tells, need one sort
    blocks = (listed.agg(F.max("rank")).first()[0] or 0) > RANK_BLOCK
    known = listed.join(scoring.elements, "element")
    n_elements, two_m, collected = scoring.elements.agg(F.count(F.lit(1)).alias("n")).scalar(), scoring.two_m(), None
    if missing:
        # one pass over the edges gives the ranked elements and both totals
        whole = scoring.elements.agg(F.struct(F.count(F.lit(1)).alias("n"), (F.sum("k") * 2).alias("k2")).alias("t"))
        known = durable(known.where(F.col("list_id").isNotNull()).withColumn("t", whole.scalar()))
        n_elements, two_m = (F.lit(x).cast("long") for x in (known.select("t.n", "t.k2").first() or (None, None)))
        known = known.drop("t")
        collected = incidence.collected(known.select("list_id", "element"), "list_id", "element")
    if rank_mode == "cumulative":
        summed = _prefix_sum(known, ["list_id"], "rank", F.col("k"), "cum_k", blocks)
        tied = Window.partitionBy("list_id", "rank")
        summed = summed.select("list_id", "element", "rank", F.max("cum_k").over(tied).alias("cum_k"))
    else:
        vertices = listed.join(scoring.graph.degrees.select(F.col("v").alias("element"), "k"), "element")
        placed = _prefix_sum(vertices, ["list_id"], "rank", F.lit(1), "position", blocks)
        placed = _prefix_sum(placed, ["list_id"], "rank", F.col("k"), "cum_k", blocks)
        at = placed.select("list_id", F.col("position").alias("rank"), "cum_k")
        summed = known.select("list_id", "element", "rank").join(at, ["list_id", "rank"], "left")
    # a position beyond the list leaves the sum, and so the expectation, null
    members, lacked = pairs.join(sizes, "term"), None
    if collected is not None:
        lacked = _lacked(pairs, sizes, collected, known.schema["list_id"].dataType.simpleString())
        every = members.join(F.broadcast(summed), "element")  # at most incidence.MEMBERS rows
    elif missing:
        lists = summed.select(F.col("list_id").alias("l")).distinct().agg(F.collect_set("l").alias("ls"))
        every = members.select("*", F.explode(lists.scalar()).alias("list_id"))
        every = every.join(summed, ["list_id", "element"], "left")
    else:
        every = summed.join(members, "element")
    counted = _prefix_sum(every, ["list_id", "term"], "rank", F.lit(1), "observed_ec", blocks)
    rows = counted.withColumns({"m2": two_m, "n_e": n_elements})
    rows = rows.withColumn("lambda", F.col("k").cast("double") * F.col("cum_k") / F.col("m2"))
    x, expected = F.col("observed_ec").cast("double"), F.col("lambda")
    profiles = rows.select(
        "list_id",
        F.col("term").alias("term_id"),
        "element",
        (F.col("rank").cast("double") / F.col("n_e")).alias("element_relative_rank"),
        "lambda",
        "observed_ec",
        F.col("rank").alias("max_ec"),
        F.col("k").alias("term_size"),
        poisson.z_score(x, expected).alias("z_score"),
        poisson.anscombe_ratio(x, expected).alias("log2_anscombe_ratio"),
        poisson.relative_change(x, expected).alias("log2_relative_change"),
        poisson.p_value(x, F.col("max_ec"), expected).alias("p_value"),
    )
    if lacked is None:
        return profiles
    kinds = dict(profiles.dtypes)
    return profiles.union(lacked.select(*[c if c in lacked.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds]))


def _lacked(pairs: DataFrame, sizes: DataFrame, ranked: incidence.Members, kind: str) -> DataFrame:
    """(list_id, term_id, element, observed_ec, term_size) of the elements of every term that a list lacks.

    They come after the ranked elements of the term, by element. Only edges are shuffled:
    of a term, first its degree, then its ranked elements, which are counted for every
    list, and then all elements in order, of which the missing ones are numbered.
    """
    spark = pairs.sparkSession
    rows = incidence.coded(pairs, "element", ranked)
    none = F.lit(None).cast("string").alias("element")
    once = F.struct(F.lit(1).alias("kind"), "element", "code")
    before = F.when(F.col("code") >= 0, F.struct(F.lit(0).alias("kind"), none, "code"))
    rows = rows.select("term", F.inline(F.array_compact(F.array(before, once))))
    rows = rows.unionByName(sizes.select("term", F.lit(-1).alias("kind"), none, F.col("k").alias("code")))
    rows = incidence.in_one_place(rows, "term", "kind", "element")
    shared = spark.sparkContext.broadcast((ranked.starts, ranked.held, ranked.ids))
    entry = f"struct<list_id: {kind}, observed_ec: bigint>"
    found = rows.mapInArrow(_numbered(shared), f"term_id string, element string, term_size long, lists array<{entry}>")
    return found.select("term_id", "element", "term_size", F.inline("lists"))


def _numbered(shared):
    """For ``mapInArrow``: (term, element, degree, lists with places) of sorted (term, kind, element, code) rows."""

    def run(batches):
        starts, held, ids = shared.value
        n = len(ids)
        step = max(1, incidence.CELLS // 4 // max(1, n))
        name, degree, seen = None, 0, None  # of the last term, which may go on: its places taken in every list
        for block in incidence.blocks(batches):
            keys = block.column(0).combine_chunks().dictionary_encode()
            terms, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary
            kinds, codes = block.column(1).to_numpy(), block.column(3).to_numpy()
            elements = block.column(2).combine_chunks()
            degrees = np.zeros(len(names), np.int64)
            degrees[terms[kinds < 0]] = codes[kinds < 0]
            if names[0].as_py() == name:
                degrees[0] = degree
            else:
                seen = None
            for a in range(0, len(terms), step):
                part = slice(a, a + step)
                term, kind, code = terms[part], kinds[part], codes[part]
                known = np.flatnonzero((kind >= 0) & (code >= 0))
                lengths = starts[code[known] + 1] - starts[code[known]]
                cells = np.repeat(known * n, lengths) + held[incidence.stretches(starts[code[known]], lengths)]
                met = np.bincount(cells, minlength=len(term) * n).reshape(len(term), n)
                free = (met == 0) & (kind == 1)[:, None]
                upto = np.cumsum(np.where((kind == 0)[:, None], met, free), axis=0)
                first = np.flatnonzero(np.diff(term, prepend=-1))
                before = np.concatenate((np.zeros((1, n), np.int64), upto[first[1:] - 1]))
                if seen is not None and (a == 0 or term[0] == terms[a - 1]):
                    before[0] -= seen
                place = upto - before[term - term[0]]
                seen = place[-1].copy()
                wanted = np.flatnonzero(kind == 1)
                at, lists = np.nonzero(free)
                ends = np.concatenate(([0], np.cumsum(free.sum(axis=1)[wanted]))).astype(np.int32)
                entries = pa.StructArray.from_arrays([ids.take(pa.array(lists)), pa.array(place[at, lists])], ["list_id", "observed_ec"])
                rows = [names.take(pa.array(term[wanted])), elements.take(pa.array(wanted + a)), pa.array(degrees[term[wanted]])]
                rows.append(pa.ListArray.from_arrays(pa.array(ends), entries))
                yield pa.RecordBatch.from_arrays(rows, ["term_id", "element", "term_size", "lists"])
            name, degree = names[-1].as_py(), int(degrees[-1])

    return run


def _report(given: DataFrame, known: DataFrame, column: str, what: str) -> None:
    """Warn of the first unknown ids; raise if none is known."""
    unknown = given.join(known, column, "left_anti").distinct().limit(5).collect()
    if unknown:
        warnings.warn(f"unknown {what}: " + ", ".join(r[column] for r in unknown), stacklevel=3)
        if not given.join(known, column, "left_semi").limit(1).collect():
            raise ValueError(f"none of the {what} is known")


def _summarized(rows: DataFrame, key: list[str]) -> DataFrame:
    """Size, median, and the least, greatest and middle place of every group of (s, p, med) rows."""
    seen = F.col("s").isNotNull()
    away = F.round(F.abs(F.col("s") - F.col("med")), 12).alias("d")
    return rows.groupBy(*key).agg(
        F.max("term_size").alias("size"),
        F.max("med").alias("med"),
        F.min(F.when(seen, F.struct("s", "p"))).alias("lo"),
        F.min(F.when(seen, F.struct((-F.col("s")).alias("s"), "p"))).alias("hi"),
        F.min(F.when(seen, F.struct(away, "p"))).alias("at"),
    )


def summarize_profiles(profiles: DataFrame, statistic: str = "z_score", rank_by: str = "max") -> DataFrame:
    """One row per list and term: where a statistic is least, median and greatest.

    Columns: ``list_id``, ``term_id``, ``term_size`` and, for each of min, median and
    max, ``*_score``, ``element_at_*``, ``rank_at_*`` (relative ranks). Only finite
    scores count; a term without any has nulls throughout. Equal scores are settled by
    the better rank, then by the element; the median's place is the first row closest to it.

    The groups of up to ``RANK_BLOCK`` rows are sorted once each; the medians of larger
    ones, counted exactly, come from the weighted percentiles of value ranges.

    Sorted by the score that ``rank_by`` names (max unless it is min or median):
    descending, but ascending for min, and for p values unless ranked by max; nulls last,
    ties by list and term. An unknown statistic or a missing column warns and gives no
    rows; anything but a DataFrame raises TypeError.
    """
    if not isinstance(profiles, DataFrame):
        raise TypeError("profiles come as a DataFrame of rank_profiles")
    scores = ["min_score", "median_score", "max_score"]
    names = [c for s in ("min", "median", "max") for c in (f"{s}_score", f"element_at_{s}", f"rank_at_{s}")]
    needed = {"list_id", "term_id", "element", "element_relative_rank", "term_size", statistic}
    if statistic not in STATISTICS or not needed <= set(profiles.columns):
        warnings.warn(f"no summary of {statistic!r}", stacklevel=2)
        kinds = "list_id long, term_id string, term_size long, "
        kinds += ", ".join(f"{c} {'string' if c.startswith('element') else 'double'}" for c in names)
        return profiles.sparkSession.createDataFrame([], kinds)
    score = F.col(statistic)
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    place = F.struct(F.col("element_relative_rank").alias("r"), F.col("element").alias("e"))
    key = ["list_id", "term_id"]
    # read twice below: written once
    rows = durable(profiles.select(*key, "term_size", F.when(finite, score).alias("s"), place.alias("p")))
    large = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANK_BLOCK).select(*key)
    if large.isEmpty():
        joined = _summarized(rows.withColumn("med", F.median("s").over(Window.partitionBy(*key))), key)
    else:
        large = durable(large)
        on = functools.reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key])
        few = rows.alias("x").join(large.alias("y"), on, "left_anti")
        joined = _summarized(few.withColumn("med", F.median("s").over(Window.partitionBy(*key))), key)
        many = rows.alias("x").join(large.alias("y"), on, "left_semi")
        scored = many.where(F.col("s").isNotNull()).select(F.struct(*key).alias("key"), "s")
        medians = weighted_percentiles(scored, "key", "s", [0.5])
        medians = medians.select("key.*", F.col("percentile").alias("med"))
        on = functools.reduce(Column.__and__, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key])
        many = many.alias("x").join(medians.alias("y"), on, "left").select("x.*", "med")
        joined = joined.unionByName(_summarized(many, key))
    found = F.col("lo").isNotNull()
    table = joined.select(
        *key,
        F.when(found, F.col("size")).alias("term_size"),
        F.col("lo.s").alias("min_score"),
        F.col("lo.p.e").alias("element_at_min"),
        F.col("lo.p.r").alias("rank_at_min"),
        F.col("med").alias("median_score"),
        F.col("at.p.e").alias("element_at_median"),
        F.col("at.p.r").alias("rank_at_median"),
        (-F.col("hi.s")).alias("max_score"),
        F.col("hi.p.e").alias("element_at_max"),
        F.col("hi.p.r").alias("rank_at_max"),
    )
    by = F.col(scores[("min", "median", "max").index(rank_by)] if rank_by in ("min", "median", "max") else "max_score")
    rising = rank_by == "min" or (statistic == "p_value" and rank_by != "max")
    return table.orderBy(by.asc_nulls_last() if rising else by.desc_nulls_last(), *key)
