import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom import Graph, read_edges
from graphloom.operators.graph import greedy_edges, one_set

TOY = [("A", "E"), ("E", "B"), ("B", "C"), ("E", "C"), ("E", "F"), ("F", "C"), ("D", "G"), ("G", "H")]


@pytest.fixture(scope="module")
def toy(spark):
    return Graph.from_edges(spark.createDataFrame(TOY, "prot1 string, prot2 string")).persist()


def value(df):
    return df.first()[-1]


def test_degrees_and_moments(toy):
    assert dict(toy.degrees.collect()) == dict(A=1, B=2, C=3, D=1, E=4, F=2, G=2, H=1)
    assert tuple(toy.moments().first()) == (8, 8, 2.0)


@pytest.mark.parametrize(
    "members, edges", [("", 0), ("E", 0), ("EI", 0), ("ED", 0), ("EDG", 1), ("EDGCB", 4), ("AAE", 1)]
)
def test_count_within(spark, toy, members, edges):
    found = toy.count_within(one_set(spark, list(members)))
    assert (value(found) if members else found.count()) == edges


def test_repeated_members_inflate_without_dedupe(spark, toy):
    assert value(toy.count_within(one_set(spark, list("AAE")), dedupe=False)) == 1.5
    assert value(toy.max_within(one_set(spark, list("AAE")), dedupe=False)) == 3
    assert value(toy.max_within(one_set(spark, list("AAE")))) == 1


@pytest.mark.parametrize("one, two, edges", [("A", "", 0), ("A", "G", 0), ("EA", "DG", 0), ("EA", "BCF", 3), ("HDABCF", "EG", 6)])
def test_count_between(spark, toy, one, two, edges):
    assert value(toy.count_between(one_set(spark, list(one)), one_set(spark, list(two)))) == edges


@pytest.mark.parametrize("members, most", [("E", 0), ("BCE", 3), ("BCEG", 5)])
def test_max_within_degrees(spark, toy, members, most):
    assert value(toy.max_within_degrees(one_set(spark, list(members)))) == most


@pytest.mark.parametrize("one, two, most", [("E", "", 0), ("E", "A", 1), ("E", "DH", 2), ("EF", "DGHBC", 6)])
def test_max_between_degrees(spark, toy, one, two, most):
    assert value(toy.max_between_degrees(one_set(spark, list(one)), one_set(spark, list(two)))) == most


def test_max_between_ignores_overlap(spark, toy):
    assert value(toy.max_between(one_set(spark, list("AEX")), one_set(spark, list("EFG")))) == 6


def test_neighbors_and_round_trip(spark, toy, rows_of):
    assert {r.v for r in toy.neighbors(one_set(spark, list("AEZ"))).collect()} == set("EABCF")
    again = Graph.from_edges(toy.to_dataframe())
    assert rows_of(again.degrees) == rows_of(toy.degrees)
    assert toy.to_dataframe().count() == 16 and toy.to_dataframe(one_direction=True).count() == 8
    assert {r.v: r.neighbors for r in toy.adjacency().collect()}["C"] == ["B", "E", "F"]


def test_ingest_rules(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", None), (None, "e"), ("", "f"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "s string, t string, k int, v string")
    assert dict(Graph.from_edges(df, "s", "t").degrees.collect()) == dict(a=1, b=1, c=0, d=0, e=0)
    loops = spark.createDataFrame([("a", "a")], "s string, t string")
    assert Graph.from_edges(loops).degrees.count() == 0
    empty = Graph.from_edges(loops.limit(0))
    assert tuple(empty.moments().first()) == (0, 0, None)
    assert empty.to_dataframe().count() == 0


def test_wrong_columns(spark):
    df = spark.createDataFrame(TOY, "p string, q string")
    for bad in (0, 3, "none"):
        with pytest.raises(ValueError):
            Graph.from_edges(df, bad, 2)
    with pytest.raises(TypeError):
        Graph.from_edges(df, 1.5, 2)
    with pytest.raises(TypeError):
        Graph.from_edges([("a", "b")])
    with pytest.raises(ValueError):
        Graph.from_edges(df.select("p"))
    with pytest.raises(ValueError):
        read_edges(spark, "/nonexistent/edges.txt").count()


def test_file_source(spark, tmp_path):
    body = "\r\n".join(["prot1\tprot2", ""]) + "\n".join("\t".join(e) for e in TOY) + "\t"
    (tmp_path / "toy.txt").write_bytes(body.encode())
    assert Graph.from_file(spark, str(tmp_path / "toy.txt")).moments().first().m == 8
    (tmp_path / "semi.txt").write_text("007;x\n007;y\n")
    graph = Graph.from_file(spark, str(tmp_path / "semi.txt"), header=False, sep=";")
    assert dict(graph.degrees.collect()) == {"007": 2, "x": 1, "y": 1}
    with pytest.raises(ValueError):
        Graph.from_file(spark, str(tmp_path / "semi.txt"))


def plain_greedy(degrees):
    total = 0
    while len(degrees) >= 2:
        degrees = sorted((min(d, len(degrees) - 1) for d in degrees if d >= 1), reverse=True)
        degrees = sorted((min(d, len(degrees) - 1) for d in degrees), reverse=True)
        if len(degrees) < 2 or degrees[0] < 1:
            break
        first, rest = degrees[0], degrees[1:]
        total += first
        degrees = [d - 1 for d in rest[:first]] + rest[first:]
    return total


@given(st.lists(st.integers(0, 12), max_size=14))
@settings(max_examples=200, deadline=None)
def test_greedy_on_levels_is_the_greedy_on_vertices(degrees):
    levels, counts = np.unique(np.array(degrees, int), return_counts=True)
    assert greedy_edges(levels, counts) == plain_greedy(degrees)


def test_greedy_is_best_on_small_cases():
    rng = random.Random(1)
    pairs = list(itertools.combinations(range(5), 2))
    for _ in range(30):
        degrees = [rng.randint(0, 5) for _ in range(5)]
        best = 0
        for bits in range(1 << len(pairs)):
            used = [0] * 5
            for i, (a, b) in enumerate(pairs):
                if bits >> i & 1:
                    used[a] += 1
                    used[b] += 1
            if all(u <= d for u, d in zip(used, degrees)):
                best = max(best, bits.bit_count())
        assert greedy_edges(*np.unique(degrees, return_counts=True)) == best


def test_between_bound_against_bipartite_greedy(spark):
    rng = random.Random(2)
    edges = list({(f"v{rng.randint(0, 25)}", f"v{int(25 * rng.random() ** 3)}") for _ in range(150)})
    graph = Graph.from_edges(spark.createDataFrame(edges, "a string, b string")).persist()
    degree = dict(graph.degrees.collect())
    one, two, want = [], [], {}
    for s in range(25):
        names = rng.sample(sorted(degree), rng.randint(2, 16))
        cut = rng.randint(1, len(names) - 1)
        one += [(s, v) for v in names[:cut]]
        two += [(s, v) for v in names[cut:]]
        left = sorted((degree[v] for v in names[:cut]), reverse=True)
        right = [degree[v] for v in names[cut:]]
        total = 0
        for d in left:  # each takes partners with most room
            right.sort(reverse=True)
            taken = min(d, sum(r > 0 for r in right))
            right = [r - 1 if i < taken else r for i, r in enumerate(right)]
            total += taken
        want[s] = total
    found = graph.max_between_degrees(*(spark.createDataFrame(x, "set_id int, v string") for x in (one, two)))
    assert {r.set_id: r.max_edges for r in found.collect()} == want
