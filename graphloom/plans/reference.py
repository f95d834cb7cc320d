"""Queries of the graph, expectation and enrichment operators over the driver's tables."""

from __future__ import annotations

import uuid
from functools import partial
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import poisson
from graphloom.functions.text import filled
from graphloom.operators import expected
from graphloom.operators.enrichment import STATISTICS, TermScoring, rank_profiles, score_element_set, summarize_profiles
from graphloom.operators.graph import Graph
from graphloom.plans.tables import table
from graphloom.session import shared_folder


def network(spark: SparkSession, folder: str) -> Graph:
    """The delivered network, ids as written."""
    return Graph.from_edges(table(spark, folder, "edge_list", "vertex1", "vertex2"))


def hubs(spark: SparkSession, folder: str) -> Graph:
    """Orders linked to their priority and status: a few hubs, where the cap at 1 matters."""
    ends = F.array(F.concat(F.lit("p"), "o_orderpriority"), F.concat(F.lit("s"), "o_orderstatus"))
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return Graph.from_edges(orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.explode(ends)))


def annotations(spark: SparkSession, folder: str) -> TermScoring:
    """Terms and elements; null and blank ids make no edge."""
    rows = table(spark, folder, "term_element_edges", "term", "element")
    return TermScoring.from_edges(rows.where(filled(F.col("term")) & filled(F.col("element"))), check=False)


def sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "vertex_sets", "set_id", "vertex").withColumnRenamed("vertex", "v")


def set_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sets 2i and 2i+1 as the two sides of pair i."""
    rows = sets(spark, folder)
    pair = F.floor(F.col("set_id") / 2).alias("set_id")
    return tuple(rows.where(F.col("set_id") % 2 == i).select(pair, "v") for i in (0, 1))


def everything(graph: Graph) -> DataFrame:
    return graph.degrees.select(F.lit(0).alias("set_id"), "v")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def net_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).degrees


def net_edges(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).to_dataframe()


def net_edges_once(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).to_dataframe(one_direction=True)


def net_graph_object(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees of a graph object with vertices and edges."""
    edges = table(spark, folder, "edge_list", "vertex1", "vertex2").toDF("src", "dst")
    return Graph.from_graph(SimpleNamespace(vertices=sets(spark, folder).select("v"), edges=edges)).degrees


def file_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Degrees from a delimited file with a header, its columns chosen by name."""
    path = f"{shared_folder(spark)}/{uuid.uuid4()}"
    lines = supplier_parts(spark, folder).select(F.concat_ws("\t", "set_id", "p", "s").alias("set_id\tpart\tsupplier"))
    lines.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return Graph.from_file(spark, path, "supplier", "part").degrees


def net_moments(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(network(spark, folder).moments())


def net_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    lists = network(spark, folder).adjacency()
    return lists.select("v", F.array_join("neighbors", "|").alias("neighbors"))


def net_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).neighbors(sets(spark, folder))


def net_count_within(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).count_within(sets(spark, folder))


def net_count_within_repeated(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).count_within(sets(spark, folder), dedupe=False)


def net_count_between(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).count_between(*set_pairs(spark, folder))


def net_max_within(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).max_within(sets(spark, folder))


def net_max_between(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).max_between(*set_pairs(spark, folder))


def net_max_within_repeated(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).max_within(sets(spark, folder), dedupe=False)


def net_max_between_repeated(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).max_between(*set_pairs(spark, folder), dedupe=False)


def net_lambda_within_repeated(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(expected.lambda_within(network(spark, folder), sets(spark, folder), dedupe=False))


def net_max_within_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).max_within_degrees(sets(spark, folder))


def net_max_between_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).max_between_degrees(*set_pairs(spark, folder))


def net_lambda_between(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return _rounded(expected.lambda_between(network(spark, folder), *set_pairs(spark, folder), method=method))


def net_lambda_within(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return _rounded(expected.lambda_within(network(spark, folder), sets(spark, folder), method=method))


def hub_lambda_within(spark: SparkSession, folder: str, method: str) -> DataFrame:
    graph = hubs(spark, folder)
    return _rounded(expected.lambda_within(graph, everything(graph), method=method), 4)


def supplier_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as an edge between its supplier and its part, with its order."""
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    names = [F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("p")]
    return lines.select(*names, F.col("l_orderkey").alias("set_id"))


def order_lambda_within(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """One set per order, its suppliers and parts: many small sets in one job."""
    lines = supplier_parts(spark, folder)
    ends = lines.select("set_id", F.explode(F.array("s", "p")).alias("v"))
    return _rounded(expected.lambda_within(Graph.from_edges(lines), ends, method=method))


def order_lambda_between(spark: SparkSession, folder: str, method: str) -> DataFrame:
    """One pair of sets per order, its suppliers and its parts."""
    lines = supplier_parts(spark, folder)
    sides = [lines.select("set_id", F.col(c).alias("v")) for c in ("s", "p")]
    return _rounded(expected.lambda_between(Graph.from_edges(lines), *sides, method=method))


def hub_suitability(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(expected.suitability(hubs(spark, folder)))


def net_suitability(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(expected.suitability(network(spark, folder)))


def poisson_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The truncated tail over all combinations of counts, bounds and rates in the line items."""
    rows = table(spark, folder, "lineitem", "l_linenumber", "l_quantity", "l_discount")
    grid = rows.select(
        F.col("l_linenumber").cast("long").alias("z"),
        F.col("l_quantity").cast("long").alias("m"),
        F.round(F.col("l_discount") * 100, 0).alias("lambda"),
    ).distinct()
    return _rounded(grid.withColumn("p_value", poisson.p_value(F.col("z"), F.col("m"), F.col("lambda"))))


def net_statistics_within(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(expected.edge_count_statistics(network(spark, folder), sets(spark, folder)))


def net_statistics_between(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(expected.edge_count_statistics(network(spark, folder), *set_pairs(spark, folder)))


def net_statistics_within_by(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return _rounded(expected.edge_count_statistics(network(spark, folder), sets(spark, folder), method=method))


def net_statistics_between_by(spark: SparkSession, folder: str, method: str) -> DataFrame:
    return _rounded(expected.edge_count_statistics(network(spark, folder), *set_pairs(spark, folder), method=method))


def net_statistics_observed(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of a given observation: as many edges as a set has rows."""
    rows = sets(spark, folder)
    seen = rows.groupBy("set_id").agg(F.count(F.lit(1)).cast("double").alias("edge_count"))
    return _rounded(expected.edge_count_statistics(network(spark, folder), rows, observed=seen))


def term_set_scores(spark: SparkSession, folder: str, method: str = "optimized") -> DataFrame:
    return score_element_set(annotations(spark, folder), sets(spark, folder), method, digits=6)


def ecset_small_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers scored against the set of small parts."""
    lines = table(spark, folder, "lineitem", "l_suppkey", "l_partkey")
    named = lines.select(F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey"))
    small = table(spark, folder, "part", "p_partkey", "p_size").where(F.col("p_size") <= 10)
    wanted = small.select(F.lit(0).alias("set_id"), F.concat(F.lit("P"), "p_partkey").alias("v"))
    return _rounded(score_element_set(TermScoring.from_edges(named, check=False), wanted)).drop("set_id")


def _ranks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ranked_list", "list_id", "element", "rank_no").withColumnRenamed("rank_no", "rank")


def term_rank_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(rank_profiles(annotations(spark, folder), _ranks(spark, folder)))


def term_rank_profiles_positional(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(rank_profiles(annotations(spark, folder), _ranks(spark, folder), rank_mode="positional"))


def term_rank_profiles_missing(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(rank_profiles(annotations(spark, folder), _ranks(spark, folder), missing=True))


def term_rank_profiles_of_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of the terms of fifty elements or more only."""
    scoring = annotations(spark, folder)
    large = scoring.terms.where(F.col("k") >= 50).select("term")
    return _rounded(rank_profiles(scoring, _ranks(spark, folder), terms=large))


def term_rank_table(spark: SparkSession, folder: str, statistic: str, rank_by: str) -> DataFrame:
    profiles = rank_profiles(annotations(spark, folder), _ranks(spark, folder))
    # scores that differ in the last bits only are ties
    profiles = profiles.withColumn(statistic, F.round(statistic, 9))
    return _rounded(summarize_profiles(profiles, statistic, rank_by))


TABLES = [(s, by) for s in STATISTICS for by in ("min", "median", "max")]


def queries() -> dict:
    plain = (
        net_degrees,
        net_edges,
        net_edges_once,
        net_graph_object,
        file_degrees,
        net_moments,
        net_adjacency,
        net_neighbors,
        net_count_within,
        net_count_within_repeated,
        net_count_between,
        net_max_within,
        net_max_between,
        net_max_within_repeated,
        net_max_between_repeated,
        net_lambda_within_repeated,
        net_max_within_degrees,
        net_max_between_degrees,
        hub_suitability,
        net_suitability,
        poisson_grid,
        net_statistics_within,
        net_statistics_between,
        net_statistics_observed,
        ecset_small_parts,
        term_rank_profiles,
        term_rank_profiles_positional,
        term_rank_profiles_missing,
        term_rank_profiles_of_terms,
    )
    out = {f.__name__: f for f in plain}
    for method in expected.METHODS:
        out[f"net_lambda_between_{method}"] = partial(net_lambda_between, method=method)
        out[f"net_lambda_within_{method}"] = partial(net_lambda_within, method=method)
        if method != "optimized":
            out[f"net_statistics_within_{method}"] = partial(net_statistics_within_by, method=method)
            out[f"net_statistics_between_{method}"] = partial(net_statistics_between_by, method=method)
        if method != "accurate":
            out[f"hub_lambda_within_{method}"] = partial(hub_lambda_within, method=method)
        out[f"order_lambda_between_{method}"] = partial(order_lambda_between, method=method)
        out[f"order_lambda_within_{method}"] = partial(order_lambda_within, method=method)
        out[f"term_set_scores_{method}"] = partial(term_set_scores, method=method)
    for statistic, rank_by in TABLES:
        out[f"term_rank_table_{statistic}_{rank_by}"] = partial(term_rank_table, statistic=statistic, rank_by=rank_by)
    return out


def _graph_sql(rows: str) -> str:
    return f"""
WITH raw AS ({rows}),
r AS (SELECT a, b FROM raw WHERE coalesce(a, '-') <> '' AND coalesce(b, '-') <> ''),
e AS (SELECT a AS v, b AS nbr FROM r WHERE a <> b UNION SELECT b, a FROM r WHERE a <> b),
d AS (SELECT m.v, count(e.nbr) AS k FROM (SELECT a AS v FROM r WHERE a IS NOT NULL UNION SELECT b FROM r WHERE b IS NOT NULL) m
      LEFT JOIN e USING (v) GROUP BY m.v),
mm AS (SELECT CAST(sum(k) AS BIGINT) AS m2, count(*) AS n FROM d)"""


_NET = _graph_sql("SELECT vertex1 AS a, vertex2 AS b FROM edge_list")
_HUB = _graph_sql(
    "SELECT 'o' || o_orderkey AS a, unnest(['p' || o_orderpriority, 's' || o_orderstatus]) AS b FROM orders"
)
_SETS = """,
si AS (SELECT DISTINCT set_id FROM vertex_sets),
s AS (SELECT DISTINCT set_id, vertex AS v FROM vertex_sets WHERE vertex IS NOT NULL),
sk AS (SELECT s.set_id, s.v, d.k FROM s JOIN d USING (v))"""
_PAIRED = """,
pi AS (SELECT DISTINCT set_id // 2 AS set_id FROM vertex_sets),
t AS (SELECT DISTINCT set_id // 2 AS set_id, set_id % 2 AS side, vertex AS v FROM vertex_sets WHERE vertex IS NOT NULL),
tk AS (SELECT t.*, d.k FROM t JOIN d USING (v)),
x AS (SELECT set_id, v, k, side FROM tk QUALIFY count(*) OVER (PARTITION BY set_id, v) = 1),
x1 AS (SELECT * FROM x WHERE side = 0),
x2 AS (SELECT * FROM x WHERE side = 1)"""
_CAPPED = "sum(least(1.0::DOUBLE, kl / (SELECT m2 FROM mm)) * n)"
_LAMBDA_IN = """,
h AS (SELECT set_id, k, count(*) AS n FROM sk GROUP BY 1, 2),
li AS (SELECT a.set_id, sum(CASE WHEN a.k < b.k THEN a.n * b.n ELSE a.n * (a.n - 1) / 2.0::DOUBLE END
         * least(1.0::DOUBLE, a.k * b.k / (SELECT m2 FROM mm)::DOUBLE)) AS lam
       FROM h a JOIN h b ON a.set_id = b.set_id AND a.k <= b.k GROUP BY 1)"""
_LAMBDA_BETWEEN = """,
lb AS (SELECT a.set_id, sum(a.n * b.n * least(1.0::DOUBLE, a.k * b.k / (SELECT m2 FROM mm)::DOUBLE)) AS lam
       FROM (SELECT set_id, k, count(*) AS n FROM x1 GROUP BY 1, 2) a
       JOIN (SELECT set_id, k, count(*) AS n FROM x2 GROUP BY 1, 2) b USING (set_id) GROUP BY 1)"""


def _tail(z: str, m: str, lam: str) -> str:
    """The truncated tail as sums of probabilities in log space."""
    term = f"exp(i * ln({lam}) - {lam} - lgamma(i + 1))"
    return f"""CASE WHEN {lam} IS NULL OR {lam} < 0 THEN NULL WHEN {z} <= 0 THEN 1.0 WHEN {z} > {m} THEN 0.0 WHEN {lam} = 0 THEN 0.0
  WHEN list_sum(list_transform(range(0, CAST({m} AS BIGINT) + 1), lambda i: {term})) = 0 THEN 1.0
  ELSE list_sum(list_transform(range(CAST({z} AS BIGINT), CAST({m} AS BIGINT) + 1), lambda i: {term}))
     / list_sum(list_transform(range(0, CAST({m} AS BIGINT) + 1), lambda i: {term})) END"""


_EFFECTS = """round(CASE WHEN lam > 0 THEN (x - lam) / sqrt(lam) END, 6) AS z_score,
round(0.5 * (log2(x + 0.375::DOUBLE) - log2(lam + 0.375::DOUBLE)), 6) AS {anscombe},
round(CASE WHEN x > 0 AND lam > 0 THEN log2(x) - log2(lam) END, 6) AS {change}"""
_TERMS = r"""
WITH p AS (SELECT DISTINCT term, element FROM term_element_edges
           WHERE NOT regexp_full_match(term, 'BLANK') AND NOT regexp_full_match(element, 'BLANK')),
tm AS (SELECT term, count(*) AS k FROM p GROUP BY term),
el AS (SELECT element, count(*) AS k FROM p GROUP BY element),
mm AS (SELECT 2 * count(*) AS m2 FROM p)""".replace(
    "BLANK", r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
)
_PARTS = """
WITH p AS (SELECT DISTINCT 'S' || l_suppkey AS term, 'P' || l_partkey AS element FROM lineitem),
tm AS (SELECT term, count(*) AS k FROM p GROUP BY term),
el AS (SELECT element, count(*) AS k FROM p GROUP BY element),
mm AS (SELECT 2 * count(*) AS m2 FROM p),
s AS (SELECT DISTINCT 0 AS set_id, 'P' || p_partkey AS element FROM part WHERE p_size <= 10)"""


def _set_scores(capped: bool) -> str:
    value = "least(1.0::DOUBLE, kk.k * f.k / (SELECT m2 FROM mm)::DOUBLE)" if capped else "kk.k * f.k / (SELECT m2 FROM mm)::DOUBLE"
    return f""",
g AS (SELECT s.set_id, s.element, el.k FROM s JOIN el USING (element)),
z AS (SELECT set_id, count(*) AS size FROM g GROUP BY set_id),
o AS (SELECT g.set_id, p.term, tm.k, CAST(count(*) AS DOUBLE) AS x FROM g JOIN p USING (element) JOIN tm USING (term) GROUP BY 1, 2, 3),
l AS (SELECT kk.set_id, kk.k, sum({value}) AS lam FROM (SELECT DISTINCT set_id, k FROM o) kk JOIN g f ON f.set_id = kk.set_id GROUP BY 1, 2),
q AS (SELECT o.set_id, o.term, o.x, l.lam, z.size FROM o JOIN l USING (set_id, k) JOIN z USING (set_id))
SELECT set_id, term AS term_id, round({_tail("x", "size", "lam")}, 6) AS p_value,
round(lam, 6) AS "lambda", x AS observed_edges, {_EFFECTS.format(anscombe='"log2_Anscombe"', change='"log2_RelChange"')} FROM q"""


_PROFILE = (
    _TERMS
    + f""",
rl AS (SELECT DISTINCT list_id, element, CAST(rank_no AS BIGINT) AS rank FROM ranked_list),
c AS (SELECT rl.list_id, rl.element, rl.rank, sum(el.k) OVER (PARTITION BY rl.list_id ORDER BY rl.rank) AS cum_k
      FROM rl JOIN el USING (element)),
w AS (SELECT c.list_id, p.term, c.element, c.rank, tm.k, tm.k * c.cum_k / (SELECT m2 FROM mm)::DOUBLE AS lam,
             row_number() OVER (PARTITION BY c.list_id, p.term ORDER BY c.rank, c.element) AS x
      FROM c JOIN p USING (element) JOIN tm USING (term)),
f AS (SELECT list_id, term AS term_id, element, rank / (SELECT count(*) FROM el)::DOUBLE AS element_relative_rank, lam, x, rank,
             lam AS "lambda", k AS term_size, CASE WHEN lam > 0 THEN (x - lam) / sqrt(lam) END AS z_score,
             0.5 * (log2(x + 0.375::DOUBLE) - log2(lam + 0.375::DOUBLE)) AS log2_anscombe_ratio,
             CASE WHEN lam > 0 THEN log2(x) - log2(lam) END AS log2_relative_change, {_tail("x", "rank", "lam")} AS p_value FROM w)
"""
)
_PROFILE_ROWS = """SELECT list_id, term_id, element, round(element_relative_rank, 6) AS element_relative_rank, round(lam, 6) AS "lambda",
x AS observed_ec, rank AS max_ec, term_size, round(z_score, 6) AS z_score, round(log2_anscombe_ratio, 6) AS log2_anscombe_ratio,
round(log2_relative_change, 6) AS log2_relative_change, round(p_value, 6) AS p_value FROM f"""
_SUMMED = """sum(el.k) OVER (PARTITION BY rl.list_id ORDER BY rl.rank) AS cum_k
      FROM rl JOIN el USING (element)),"""
_POSITIONAL = _PROFILE.replace(
    "c AS (SELECT rl.list_id, rl.element, rl.rank, " + _SUMMED,
    """vx AS (SELECT list_id, sum(k) OVER o AS cum_k, row_number() OVER o AS rank FROM rl
       JOIN (SELECT element, k FROM el UNION ALL SELECT term, k FROM tm) USING (element) WINDOW o AS (PARTITION BY list_id ORDER BY rank, element
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT rl.list_id, rl.element, rl.rank, vx.cum_k FROM rl JOIN el USING (element) LEFT JOIN vx USING (list_id, rank)),""",
)
_MISSING = _PROFILE.replace(
    "FROM c JOIN p USING (element) JOIN tm USING (term)),",
    """FROM (SELECT DISTINCT list_id FROM c) ls JOIN p ON true JOIN tm USING (term)
      LEFT JOIN c ON c.list_id = ls.list_id AND c.element = p.element),""",
).replace("SELECT c.list_id, p.term, c.element,", "SELECT ls.list_id, p.term, p.element,").replace(
    "PARTITION BY c.list_id, p.term ORDER BY c.rank, c.element", "PARTITION BY ls.list_id, p.term ORDER BY c.rank NULLS LAST, p.element"
)


def _rank_table(statistic: str) -> str:
    return (
        _PROFILE
        + f""",
v AS (SELECT list_id, term_id, term_size, round("{statistic}", 9) AS s, element AS e, element_relative_rank AS r FROM f),
md AS (SELECT list_id, term_id, quantile_cont(s, 0.5) AS med FROM v GROUP BY 1, 2)
SELECT list_id, term_id, max(term_size) AS term_size,
  round(min(s), 6) AS min_score, arg_min(e, (s, r, e)) AS element_at_min, round(arg_min(r, (s, r, e)), 6) AS rank_at_min,
  round(any_value(med), 6) AS median_score, arg_min(e, (round(abs(s - med), 12), r, e)) AS element_at_median,
  round(arg_min(r, (round(abs(s - med), 12), r, e)), 6) AS rank_at_median,
  round(max(s), 6) AS max_score, arg_min(e, (-s, r, e)) AS element_at_max, round(arg_min(r, (-s, r, e)), 6) AS rank_at_max
FROM v JOIN md USING (list_id, term_id) GROUP BY list_id, term_id"""
    )


_SUIT = """,
l AS (SELECT k, count(*) AS n FROM d GROUP BY k),
g AS (SELECT a.k * b.k / (SELECT m2 FROM mm)::DOUBLE AS x, CAST(a.n AS DOUBLE) * b.n AS pairs FROM l a, l b),
u AS (SELECT 'pij' AS measure, x, pairs FROM g UNION ALL SELECT 'capped_pij', least(1.0::DOUBLE, x), pairs FROM g)
SELECT measure, round(min(x), 6) AS minimum, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median,
  round(avg(x), 6) AS mean, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS maximum,
  round(coalesce(sum(pairs) FILTER (x >= 1), 0) / (SELECT n * CAST(n AS DOUBLE) FROM mm), 6) AS pij_over_1
FROM u GROUP BY measure"""


def oracle_sql() -> dict[str, str]:
    zero = "SELECT {i}.set_id, coalesce(q.{c}, 0.0::DOUBLE) AS {c} FROM {i} LEFT JOIN q USING (set_id)"
    by_set, by_pair = (lambda c: zero.format(i="si", c=c)), (lambda c: zero.format(i="pi", c=c))
    count_in = """SELECT s.set_id, count(*) / 2.0::DOUBLE AS edge_count
      FROM e JOIN s ON s.v = e.v JOIN s u ON u.set_id = s.set_id AND u.v = e.nbr GROUP BY 1"""
    count_between = """SELECT x1.set_id, CAST(count(*) AS DOUBLE) AS edge_count
      FROM e JOIN x1 ON x1.v = e.v JOIN x2 ON x2.set_id = x1.set_id AND x2.v = e.nbr GROUP BY 1"""
    max_in = "SELECT set_id, count(*) * (count(*) - 1) / 2.0::DOUBLE AS max_edges FROM sk GROUP BY 1"
    max_between = """SELECT set_id, CAST(count(*) FILTER (side = 0) AS DOUBLE) * count(*) FILTER (side = 1) AS max_edges
      FROM tk GROUP BY 1"""
    stats = _EFFECTS.format(anscombe='"log2_Anscombe_ratio"', change="log2_relative_change")
    tail = _tail("x", "m", "lam")
    out = {
        "net_degrees": _NET + "SELECT v, k FROM d",
        "net_edges": _NET + "SELECT v AS from_id, nbr AS to_id FROM e",
        "net_moments": _NET + "SELECT m2 // 2 AS m, n, round(m2 / n::DOUBLE, 6) AS average_degree FROM mm",
        "net_adjacency": _NET
        + "SELECT d.v, coalesce(string_agg(e.nbr, '|' ORDER BY e.nbr), '') AS neighbors FROM d LEFT JOIN e USING (v) GROUP BY d.v",
        "net_neighbors": _NET + _SETS + "SELECT DISTINCT s.set_id, e.nbr AS v FROM s JOIN e USING (v)",
        "net_count_within": _NET + _SETS + f", q AS ({count_in})" + by_set("edge_count"),
        "net_count_within_repeated": _NET
        + _SETS
        + """, q AS (SELECT r.set_id, count(*) / 2.0::DOUBLE AS edge_count FROM e JOIN vertex_sets r ON r.vertex = e.v
      JOIN s u ON u.set_id = r.set_id AND u.v = e.nbr GROUP BY 1)"""
        + by_set("edge_count"),
        "net_count_between": _NET + _PAIRED + f", q AS ({count_between})" + by_pair("edge_count"),
        "net_max_within": _NET + _SETS + f", q AS ({max_in})" + by_set("max_edges"),
        "net_max_between": _NET + _PAIRED + f", q AS ({max_between})" + by_pair("max_edges"),
        "net_max_within_degrees": _NET.replace("WITH raw", "WITH RECURSIVE raw")
        + _SETS
        + """,
f AS (SELECT set_id, list_sort(list(k), 'DESC') AS r, 0 AS w FROM sk GROUP BY set_id
  UNION ALL
  SELECT set_id, list_sort(list_transform(c[2:], lambda d, i: CASE WHEN i <= c[1] THEN d - 1 ELSE d END), 'DESC'), w + c[1]
  FROM (SELECT set_id, w, list_transform(o, lambda d: least(d, len(o) - 1)) AS c
        FROM (SELECT set_id, w, list_filter(r, lambda d: d >= 1) AS o FROM f) WHERE len(o) >= 2)),
q AS (SELECT set_id, CAST(max(w) AS DOUBLE) AS max_edges FROM f GROUP BY 1)"""
        + by_set("max_edges"),
        "net_max_between_degrees": _NET
        + _PAIRED
        + """,
y AS (SELECT set_id, i, sum(rest) AS rest FROM (
        SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY k DESC, v) AS i,
               coalesce(sum(k) OVER (PARTITION BY set_id ORDER BY k DESC, v ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM x1
        UNION ALL SELECT set_id, 0, sum(k) FROM x1 GROUP BY 1) GROUP BY 1, 2),
h2 AS (SELECT set_id, k, count(*) AS n FROM x2 GROUP BY 1, 2),
q AS (SELECT set_id, CAST(min(f) AS DOUBLE) AS max_edges FROM (
        SELECT y.set_id, y.i, any_value(y.rest) + sum(h2.n * least(h2.k, y.i)) AS f FROM y JOIN h2 USING (set_id) GROUP BY 1, 2) GROUP BY 1)"""
        + by_pair("max_edges"),
        "net_suitability": _NET + _SUIT,
        "hub_suitability": _HUB + _SUIT,
        "poisson_grid": f"""
WITH g AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS z, CAST(l_quantity AS BIGINT) AS m, round(l_discount * 100, 0) AS lam FROM lineitem)
SELECT z, m, lam AS "lambda", round({_tail("z", "m", "lam")}, 6) AS p_value FROM g""",
        "net_statistics_within": _NET
        + _SETS
        + _LAMBDA_IN
        + f""", cn AS ({count_in}), mx AS ({max_in}),
a AS (SELECT si.set_id, coalesce(li.lam, 0) AS lam, coalesce(cn.edge_count, 0) AS x, coalesce(mx.max_edges, 0) AS m
      FROM si LEFT JOIN li USING (set_id) LEFT JOIN cn USING (set_id) LEFT JOIN mx USING (set_id))
SELECT set_id, round({tail}, 6) AS p_value, {stats} FROM a""",
        "net_statistics_between": _NET
        + _PAIRED
        + _LAMBDA_BETWEEN
        + f""", cn AS ({count_between}), mx AS ({max_between}),
a AS (SELECT pi.set_id, coalesce(lb.lam, 0) AS lam, coalesce(cn.edge_count, 0) AS x, coalesce(mx.max_edges, 0) AS m
      FROM pi LEFT JOIN lb USING (set_id) LEFT JOIN cn USING (set_id) LEFT JOIN mx USING (set_id))
SELECT set_id, round({tail}, 6) AS p_value, {stats} FROM a""",
        "ecset_small_parts": _PARTS + _set_scores(True).replace("SELECT set_id, term AS term_id", "SELECT term AS term_id"),
        "net_edges_once": _NET + "SELECT v AS from_id, nbr AS to_id FROM e WHERE v < nbr",
        "net_graph_object": _NET + "SELECT v, k FROM d",
        "file_degrees": _PARTS.partition("s AS (")[0].rstrip(" ,\n")
        + " SELECT term AS v, k FROM tm UNION ALL SELECT element, k FROM el",
        "net_max_within_repeated": _NET
        + _SETS
        + """, q AS (SELECT set_id, count(*) * (count(*) - 1) / 2.0::DOUBLE AS max_edges
  FROM vertex_sets JOIN d ON d.v = vertex GROUP BY 1)"""
        + by_set("max_edges"),
        "net_max_between_repeated": _NET
        + _PAIRED
        + """, q AS (SELECT set_id // 2 AS set_id, CAST(count(*) FILTER (set_id % 2 = 0) AS DOUBLE) * count(*) FILTER (set_id % 2 = 1) AS max_edges
  FROM vertex_sets JOIN d ON d.v = vertex GROUP BY 1)"""
        + by_pair("max_edges"),
        "net_lambda_within_repeated": _NET
        + """,
si AS (SELECT DISTINCT set_id FROM vertex_sets),
sk AS (SELECT set_id, v, k, row_number() OVER (PARTITION BY set_id ORDER BY v) AS i FROM vertex_sets JOIN d ON d.v = vertex),
q AS (SELECT a.set_id, round(sum(least(1.0::DOUBLE, a.k * b.k / (SELECT m2 FROM mm)::DOUBLE)), 6) AS "lambda"
      FROM sk a JOIN sk b ON a.set_id = b.set_id AND a.i < b.i GROUP BY 1)"""
        + by_set('"lambda"'),
        "net_statistics_observed": _NET
        + _SETS
        + _LAMBDA_IN
        + f""", cn AS (SELECT set_id, CAST(count(*) AS DOUBLE) AS x FROM vertex_sets GROUP BY 1), mx AS ({max_in}),
a AS (SELECT si.set_id, coalesce(li.lam, 0) AS lam, cn.x, coalesce(mx.max_edges, 0) AS m
      FROM si LEFT JOIN li USING (set_id) JOIN cn USING (set_id) LEFT JOIN mx USING (set_id))
SELECT set_id, round({tail}, 6) AS p_value, {stats} FROM a""",
        "term_rank_profiles": _PROFILE + _PROFILE_ROWS,
        "term_rank_profiles_positional": _POSITIONAL + _PROFILE_ROWS,
        "term_rank_profiles_missing": _MISSING + _PROFILE_ROWS,
        "term_rank_profiles_of_terms": _PROFILE + _PROFILE_ROWS + " WHERE term_size >= 50",
    }
    pairwise = {
        "accurate": "sum(least(1.0::DOUBLE, {a}.k * {b}.k / (SELECT m2 FROM mm)::DOUBLE))",
        "optimized": "sum(least(1.0::DOUBLE, {a}.k * {b}.k / (SELECT m2 FROM mm)::DOUBLE))",
    }
    for method, total in pairwise.items():
        out[f"net_lambda_between_{method}"] = (
            _NET
            + _PAIRED
            + f", q AS (SELECT x1.set_id, round({total.format(a='x1', b='x2')}, 6) AS \"lambda\" FROM x1 JOIN x2 USING (set_id) GROUP BY 1)"
            + by_pair('"lambda"')
        )
        out[f"net_lambda_within_{method}"] = (
            _NET
            + _SETS
            + f", q AS (SELECT a.set_id, round({total.format(a='a', b='b')}, 6) AS \"lambda\" FROM sk a JOIN sk b ON a.set_id = b.set_id AND a.v < b.v GROUP BY 1)"
            + by_set('"lambda"')
        )
    out["net_lambda_between_fast"] = (
        _NET
        + _PAIRED
        + """, q AS (SELECT a.set_id, round(a.k * CAST(b.k AS DOUBLE) / (SELECT m2 FROM mm), 6) AS "lambda"
  FROM (SELECT set_id, sum(k) AS k FROM x1 GROUP BY 1) a JOIN (SELECT set_id, sum(k) AS k FROM x2 GROUP BY 1) b USING (set_id))"""
        + by_pair('"lambda"')
    )
    fast = """(SELECT set_id, round(CASE WHEN count(*) > 1 THEN (sum(k) * sum(k) - sum(k * k)) / (2.0::DOUBLE * (SELECT m2 FROM mm)) ELSE 0 END, {d}) AS "lambda"
  FROM sk GROUP BY 1)"""
    out["net_lambda_within_fast"] = _NET + _SETS + f", q AS {fast.format(d=6)}" + by_set('"lambda"')
    one = ", sk AS (SELECT 0 AS set_id, v, k FROM d)"
    out["hub_lambda_within_fast"] = _HUB + one + f" SELECT * FROM {fast.format(d=4)}"
    out["hub_lambda_within_optimized"] = _HUB + one + _LAMBDA_IN + 'SELECT set_id, round(lam, 4) AS "lambda" FROM li'
    lines = _graph_sql("SELECT 'S' || l_suppkey AS a, 'P' || l_partkey AS b FROM lineitem") + """,
t AS (SELECT DISTINCT l_orderkey AS set_id, 1 AS side, 'S' || l_suppkey AS v FROM lineitem
      UNION SELECT DISTINCT l_orderkey, 2, 'P' || l_partkey FROM lineitem),
sk AS (SELECT t.*, d.k FROM t JOIN d USING (v)),
si AS (SELECT DISTINCT set_id FROM t)"""
    for method in expected.METHODS:
        kl = "a.k * b.k / (SELECT m2 FROM mm)::DOUBLE"
        total = f"sum({kl if method == 'fast' else f'least(1.0::DOUBLE, {kl})'})"
        for name, condition in (("within", "a.v < b.v"), ("between", "a.side = 1 AND b.side = 2")):
            out[f"order_lambda_{name}_{method}"] = (
                lines
                + f""", q AS (SELECT a.set_id, round({total}, 6) AS "lambda"
  FROM sk a JOIN sk b ON a.set_id = b.set_id AND {condition} GROUP BY 1)"""
                + by_set('"lambda"')
            )
    members = ", s AS (SELECT DISTINCT set_id, vertex AS element FROM vertex_sets)"
    for method in expected.METHODS:
        out[f"term_set_scores_{method}"] = _TERMS + members + _set_scores(method != "fast")
    for statistic, rank_by in TABLES:
        out[f"term_rank_table_{statistic}_{rank_by}"] = _rank_table(statistic)
    uncapped = "least(1.0::DOUBLE, a.k * b.k / (SELECT m2 FROM mm)::DOUBLE)"
    for kind in ("within", "between"):
        exact = out[f"net_statistics_{kind}"]
        assert uncapped in exact
        out[f"net_statistics_{kind}_accurate"] = exact
        out[f"net_statistics_{kind}_fast"] = exact.replace(uncapped, "a.k * b.k / (SELECT m2 FROM mm)::DOUBLE")
    return out
