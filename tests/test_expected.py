import random

import numpy as np
import pytest

from graphloom import Graph, edge_count_statistics, lambda_between, lambda_within, suitability
from graphloom.functions.poisson import truncated_tail
from graphloom.operators.graph import one_set

TOY = [("A", "E"), ("E", "B"), ("B", "C"), ("E", "C"), ("E", "F"), ("F", "C"), ("D", "G"), ("G", "H")]


@pytest.fixture(scope="module")
def toy(spark):
    return Graph.from_edges(spark.createDataFrame(TOY, "a string, b string")).persist()


def value(df):
    return df.first()["lambda"]


@pytest.mark.parametrize("method", ["accurate", "optimized"])
def test_lambda_on_the_toy_graph(spark, toy, method):
    assert value(lambda_within(toy, one_set(spark, list("BCEG")), method)) == 2.75
    assert value(lambda_within(toy, one_set(spark, list("BCEFG")), method)) == 4.125
    assert value(lambda_within(toy, one_set(spark, ["E", "nobody"]), method)) == 0
    assert value(lambda_between(toy, one_set(spark, list("EA")), one_set(spark, list("BCF")), method)) == 2.1875


def test_fast_lambda_and_bad_method(spark, toy):
    assert value(lambda_within(toy, one_set(spark, list("BCEG")), "fast")) == pytest.approx((121 - 33) / 32)
    assert value(lambda_between(toy, one_set(spark, list("EA")), one_set(spark, list("BCF")), "fast")) == 35 / 16
    with pytest.raises(ValueError):
        lambda_within(toy, one_set(spark, ["A"]), "quick")


def test_repeated_members(spark, toy):
    twice = one_set(spark, list("EEC"))
    assert value(lambda_within(toy, twice)) == 0.75
    for method in ("accurate", "optimized"):
        # E-E counts 1 (16/16), E-C twice 12/16
        assert value(lambda_within(toy, twice, method, dedupe=False)) == 2.5
    assert value(lambda_within(toy, twice, "fast", dedupe=False)) == (121 - 41) / 32


def test_methods_agree_where_the_cap_bites(spark):
    rng = random.Random(3)
    edges = [(f"h{rng.randint(0, 3)}", f"v{i}") for i in range(120)] + [("h0", "h1"), ("h1", "h2")]
    edges += [(f"v{rng.randint(0, 119)}", f"v{rng.randint(0, 119)}") for _ in range(40)]
    graph = Graph.from_edges(spark.createDataFrame(edges, "a string, b string")).persist()
    names = sorted(r.v for r in graph.degrees.collect())
    sets = [(s, v) for s in range(12) for v in rng.sample(names, rng.randint(0, 90))]
    sets += [(12, v) for v in names]
    df = spark.createDataFrame(sets, "set_id int, v string")
    other = df.selectExpr("(set_id + 1) % 13 as set_id", "v")
    for f, args in ((lambda_within, (df,)), (lambda_between, (df, other))):
        a, b, c = ({r.set_id: r["lambda"] for r in f(graph, *args, method=m).collect()} for m in ("accurate", "optimized", "fast"))
        assert a == pytest.approx(b, rel=1e-12)
        assert f is lambda_between or any(c[s] > b[s] + 0.5 for s in c)
    shuffled = Graph.from_edges(graph.to_dataframe().repartition(7).orderBy("to_id"))
    found = {r.set_id: r["lambda"] for r in lambda_within(shuffled, df.repartition(5)).collect()}
    assert found == {r.set_id: r["lambda"] for r in lambda_within(graph, df).collect()}


def test_tail_values():
    tail = lambda z, m, lam: truncated_tail(np.array([z]), np.array([m]), np.array([lam]))[0]
    assert tail(5, 10, 2) == pytest.approx(0.052645146507031726, rel=1e-12)
    assert tail(3, 3, 2) == pytest.approx(0.210526315789, rel=1e-9)
    assert tail(0, 5, 1.0) == 1 and tail(-1, 5, 1.0) == 1
    assert tail(1, 5, 0.0) == 0 and tail(6, 5, 1.0) == 0 and tail(9, 5, 1.0) == 0
    assert np.isnan(tail(1, 5, float("nan"))) and np.isnan(tail(1, 5, -1.0))
    assert tail(1, 2, 5000.0) == 1  # nothing of the distribution is left below the bound


def test_tail_against_direct_sums():
    import math

    rng = np.random.default_rng(4)
    for _ in range(300):
        m = int(rng.integers(0, 300))
        z, lam = int(rng.integers(0, m + 1)), float(rng.uniform(1e-3, 300))
        logs = np.array([i * math.log(lam) - lam - math.lgamma(i + 1) for i in range(m + 1)])
        terms = np.exp(logs - logs.max())
        want = terms[z:].sum() / terms.sum()
        assert truncated_tail(np.array([z]), np.array([m]), np.array([lam]))[0] == pytest.approx(want, rel=1e-9)


def test_statistics_of_a_triangle(spark):
    graph = Graph.from_edges(spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C")], "a string, b string"))
    row = edge_count_statistics(graph, one_set(spark, list("ABC"))).first()
    want = (0.210526315789, 0.707106781187, 0.25347999436, 0.584962500721)
    assert tuple(row)[1:] == pytest.approx(want, rel=1e-9)
    given = spark.createDataFrame([(0, 3.0)], "set_id int, edge_count double")
    assert edge_count_statistics(graph, one_set(spark, list("ABC")), observed=given).first() == row
    nothing = edge_count_statistics(graph, one_set(spark, ["A"])).first()
    assert nothing.z_score is None and nothing.log2_relative_change is None and nothing.p_value == 1


def test_suitability(spark, toy):
    rows = {r.measure: r for r in suitability(toy).collect()}
    assert rows["pij"].pij_over_1 == 0.015625 == rows["capped_pij"].pij_over_1
    grid = np.outer([1, 2, 3, 4], [1, 2, 3, 4]).ravel() / 16
    assert (rows["pij"].minimum, rows["pij"].maximum) == (grid.min(), 1)
    assert (rows["pij"].q1, rows["pij"].median, rows["pij"].q3) == tuple(np.quantile(grid, [0.25, 0.5, 0.75]))
    assert rows["pij"]["mean"] == pytest.approx(grid.mean())
    assert suitability(Graph.from_edges(toy.to_dataframe().limit(0))).count() == 0


@pytest.fixture(scope="module")
def uneven(spark):
    """A graph with hubs, many degrees and isolated vertices."""
    rng = random.Random(21)
    rows = [(f"h{i % 3}", f"v{i}") for i in range(120)] + [(f"v{int(90 * rng.random() ** 2)}", f"v{rng.randint(0, 90)}") for _ in range(300)]
    return Graph.from_edges(spark.createDataFrame(rows + [("x1", "x1"), ("x2", "x2")], "a string, b string")).persist()


def test_optimized_is_accurate_with_isolated_vertices(spark, uneven, rows_of):
    rng = random.Random(22)
    names = [f"v{i}" for i in range(120)] + ["h0", "h1", "h2", "x1", "x2", "unknown"]
    picks = [(i, v) for i in range(12) for v in rng.choices(names, k=3 * i)] + [(20, "x1"), (20, "x2"), (21, "x1"), (21, "h0")]
    one = spark.createDataFrame(picks, "set_id int, v string")
    two = spark.createDataFrame([(i, v) for i, _ in picks for v in rng.choices(names, k=2)], "set_id int, v string")
    for dedupe in (True, False):
        both = [dict(rows_of(lambda_within(uneven, one, m, dedupe=dedupe))) for m in ("optimized", "accurate")]
        assert both[0] == pytest.approx(both[1], abs=1e-9) and max(both[0].values()) > 1
    both = [dict(rows_of(lambda_between(uneven, one, two, m))) for m in ("optimized", "accurate")]
    assert both[0] == pytest.approx(both[1], abs=1e-9) and max(both[0].values()) > 1


def test_suitability_of_many_degrees(uneven):
    degrees = [r["k"] for r in uneven.degrees.collect()]
    levels, m2 = np.array(sorted(set(degrees)), float), sum(degrees)
    assert levels[0] == 0
    grid = np.outer(levels, levels).ravel() / m2
    over = np.mean(np.outer(degrees, degrees) >= m2)
    for row in suitability(uneven).collect():
        x = grid if row["measure"] == "pij" else np.minimum(grid, 1)
        want = [x.min(), *np.quantile(x, [0.25, 0.5]), x.mean(), np.quantile(x, 0.75), x.max(), over]
        assert list(row)[1:] == pytest.approx(want)


def test_no_plan_pairs_all_degrees(uneven):
    sets = uneven.degrees.selectExpr("0 as set_id", "v")
    for df in (lambda_within(uneven, sets), suitability(uneven), uneven.max_between_degrees(sets, sets.where("v < 'v5'"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert " Join Cross" not in plan and "(k <= l)" not in plan.replace("#", "")


def test_bound_between_sets_by_brute_force(spark, uneven):
    rng = random.Random(23)
    degrees = {r["v"]: r["k"] for r in uneven.degrees.collect()}
    names = sorted(degrees)
    one, two, want = [], [], {}
    for i in range(25):
        a, b = set(rng.sample(names, rng.randint(0, 12))), set(rng.sample(names, rng.randint(0, 12)))
        one += [(i, v) for v in a]
        two += [(i, v) for v in b]
        if not a and not b:
            continue
        first, second = sorted((degrees[v] for v in a - b), reverse=True), [degrees[v] for v in b - a]
        tries = [sum(first[n:]) + sum(min(k, n) for k in second) for n in range(len(first) + 1)]
        want[i] = min(tries) if first and second else 0
    frames = [spark.createDataFrame(rows, "set_id int, v string") for rows in (one, two)]
    assert {r["set_id"]: r["max_edges"] for r in uneven.max_between_degrees(*frames).collect()} == want
