import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import TermScoring, rank_profiles, score_element_set
from graphloom.operators import incidence


@pytest.fixture
def many(spark):
    """Edges of terms and elements, one term with half of them, and sets with odd members."""
    rng = random.Random(3)
    edges = [(f"T{min(rng.randint(0, 24), 12)}", f"E{int(40 * rng.random() ** 2)}") for _ in range(400)]
    sets = [(rng.choice([1, 5, None, 9]), rng.choice(["E1", None, "none", f"E{rng.randint(0, 45)}"])) for _ in range(80)]
    return (
        TermScoring.from_edges(spark.createDataFrame(edges, "t string, e string")),
        spark.createDataFrame([*sets, (7, "none"), (8, None)], "set_id long, v string"),
    )


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(incidence, "CELLS", 5)
    monkeypatch.setattr(incidence, "EDGES", 3)
    monkeypatch.setattr(incidence, "BATCH", 2)


def same(found, wanted):
    found, wanted = (sorted(map(tuple, x.collect()), key=repr) for x in (found, wanted))
    assert [r[:2] for r in found] == [r[:2] for r in wanted] and len(found)
    for a, b in zip(found, wanted, strict=True):
        for x, y in zip(a[2:], b[2:], strict=True):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-12) if isinstance(y, float) else y)


def scores_in_one_place(many, monkeypatch, method):
    scoring, sets = many
    found = score_element_set(scoring, sets, method)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(set_id" not in plan
    monkeypatch.setattr(incidence, "MEMBERS", 0)
    joined = score_element_set(scoring, sets, method)
    assert "hashpartitioning(set_id" in joined._jdf.queryExecution().executedPlan().toString()
    same(found, joined)


def test_optimized_scores_shuffle_edges_only(spark, many, monkeypatch, small_blocks):
    scores_in_one_place(many, monkeypatch, "optimized")


def test_accurate_scores_shuffle_edges_only(spark, many, monkeypatch, small_blocks):
    scores_in_one_place(many, monkeypatch, "accurate")


def test_fast_scores_shuffle_edges_only(spark, many, monkeypatch, small_blocks):
    scores_in_one_place(many, monkeypatch, "fast")


def test_rounding_equals_that_of_spark(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 5e-7, 1.5e-6, 2.5e-6, -2.5e-6, 1.0000005, 0.3000005, 1e300, -0.0, 123456.7890125, 8.0]
    values += (rng.integers(-(10**6), 10**6, 500) / 2e6).tolist() + rng.normal(size=500).tolist()
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", F.round("x", 6).alias("y")).collect()
    assert incidence.rounded(np.array([r.x for r in rows]), 6).tolist() == [r.y for r in rows]
    assert np.isnan(incidence.rounded(np.array([np.nan]), 6)).all()


def test_neighbors_shuffle_edges_only(spark, many, monkeypatch, small_blocks):
    scoring, sets = many
    found = scoring.graph.neighbors(sets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(set_id" not in plan
    monkeypatch.setattr(incidence, "MEMBERS", 0)
    wanted = scoring.graph.neighbors(sets)
    assert "hashpartitioning(set_id" in wanted._jdf.queryExecution().executedPlan().toString()
    assert {r.set_id for r in wanted.collect()} == {1, 5, 9, None}
    same(found, wanted)
    assert scoring.graph.neighbors(sets.limit(0)).count() == 0


@pytest.mark.parametrize("mode", ["cumulative", "positional"])
@pytest.mark.parametrize("some", [False, True])
def test_missing_elements_are_numbered_in_one_place(spark, many, monkeypatch, small_blocks, mode, some):
    scoring, _ = many
    rng = random.Random(4)
    names = [f"E{i}" for i in rng.sample(range(45), 20)]
    rows = [(i, e, r) for i in (1, 2, None) for r, e in enumerate(rng.sample(names, 12), 1)]
    rows += [(1, rows[0][1], 1), (1, rows[3][1], 7), (3, "none", 1), (4, "E0", None)]
    ranks = spark.createDataFrame(rows, "list_id long, element string, rank int")
    terms = scoring.terms.where("k > 9").select("term") if some else None
    found = rank_profiles(scoring, ranks, terms, rank_mode=mode, missing=True)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(incidence, "MEMBERS", 0)
    wanted = rank_profiles(scoring, ranks, terms, rank_mode=mode, missing=True)
    assert "MapInArrow" not in wanted._jdf.queryExecution().executedPlan().toString()
    assert found.dtypes == wanted.dtypes
    same(found, wanted)
