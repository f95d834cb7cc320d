import random

import pytest

from graphloom import TermScoring, rank_profiles, score_element_set, summarize_profiles
from graphloom.operators import enrichment
from graphloom.operators.graph import one_set

DOC = [("T1", "E1"), ("T1", "E2"), ("T2", "E2")]
RANKED = [("TermA", "Elem1"), ("TermA", "Elem3"), ("TermB", "Elem2")]


def scoring(spark, rows):
    return TermScoring.from_edges(spark.createDataFrame(rows, "t string, e string"))


def ranks(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "list_id int, element string, rank int")


def test_construction(spark, tmp_path):
    rows = [("T1", "E1"), ("T1", "E2"), ("T2", "E2"), ("T2", "E3"), ("T3", "E4"), ("T5", "E1"), ("T5", "E5")]
    made = scoring(spark, rows)
    assert made.graph.moments().first().m == 7
    assert {r.term for r in made.terms.collect()} == {"T1", "T2", "T3", "T5"}
    assert {r.element for r in made.elements.collect()} == {"E1", "E2", "E3", "E4", "E5"}
    empty = TermScoring.from_edges(spark.createDataFrame([], "t string, e string"))
    assert empty.terms.count() == empty.elements.count() == empty.graph.degrees.count() == 0
    with pytest.raises(ValueError, match="vertexC"):
        scoring(spark, [("vertexA", "vertexX"), ("vertexB", "vertexC"), ("vertexC", "vertexY")])
    with pytest.raises(ValueError):
        TermScoring.from_edges(spark.createDataFrame(DOC, "t string, e string"), "t", "nothing")
    (tmp_path / "x").write_text("TermX;ElemA\nTermX;ElemB\n")
    assert TermScoring.from_file(spark, str(tmp_path / "x"), header=False, sep=";").pairs.count() == 2


@pytest.mark.parametrize("method", ["accurate", "optimized"])
def test_element_set(spark, method):
    found = score_element_set(scoring(spark, DOC), one_set(spark, ["E1", "E2", "E2", "none", None]), method)
    rows = {r.term_id: tuple(r)[2:] for r in found.collect()}
    assert rows["T1"] == pytest.approx((0.2, 1, 1, 2, 0.394247947403, 1), rel=1e-9)
    assert rows["T2"] == pytest.approx((0.384615384615, 0.707106781187, 0.5, 1, 0.32603834829, 1), rel=1e-9)


def test_element_set_without_known_elements(spark):
    made = scoring(spark, DOC)
    assert score_element_set(made, one_set(spark, ["T1", "x"])).count() == 0
    with pytest.raises(ValueError):
        score_element_set(made, one_set(spark, ["E1"]), "quick")


@pytest.mark.parametrize("mode", ["cumulative", "positional"])
@pytest.mark.parametrize("block", [1, 2, 1 << 16])
def test_rank_profile(spark, monkeypatch, mode, block):
    monkeypatch.setattr(enrichment, "RANK_BLOCK", block)
    listed = ranks(spark, [("Elem1", 1), ("Elem2", 2), ("Elem3", 3), ("Elem4", 4), ("Elem1", 1)])
    found = rank_profiles(scoring(spark, RANKED), listed, rank_mode=mode)
    rows = {(r.term_id, r.element): tuple(r)[3:] for r in found.collect()}
    want = {
        ("TermA", "Elem1"): (1 / 3, 1 / 3, 1, 1, 2, 1.15470053838, 0.478465639054, 1.58496250072, 0.25),
        ("TermA", "Elem3"): (1, 1, 2, 3, 2, 1, 0.394247947403, 1, 0.25),
        ("TermB", "Elem2"): (2 / 3, 1 / 3, 1, 2, 1, 1.15470053838, 0.478465639054, 1.58496250072, 0.28),
    }
    assert set(rows) == set(want)
    for key, row in want.items():
        assert rows[key] == pytest.approx(row, rel=1e-9)


def test_missing_elements_come_last(spark):
    made = scoring(spark, RANKED)
    found = rank_profiles(made, ranks(spark, [("Elem3", 1)]), missing=True).collect()
    rows = {r.element: r for r in found}
    assert (rows["Elem3"].observed_ec, rows["Elem1"].observed_ec) == (1, 2)
    assert rows["Elem1"]["lambda"] is None and rows["Elem1"].z_score is None and rows["Elem1"].p_value is None
    assert rank_profiles(made, ranks(spark, [("Elem3", 1)])).count() == 1


def test_rank_warnings(spark):
    made = scoring(spark, RANKED)
    with pytest.warns(UserWarning, match="Elem4"):
        rank_profiles(made, ranks(spark, [("Elem1", 1), ("Elem4", 2)]), check=True)
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        rank_profiles(made, ranks(spark, [("x", 1)]), check=True)
    some = spark.createDataFrame([("TermB",), ("TermB",), ("none",)], "term string")
    assert rank_profiles(made, ranks(spark, [("Elem1", 1), ("Elem2", 2)]), terms=some).count() == 1


def test_block_sums_equal_one_window(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(f"T{rng.randint(0, 8)}", f"E{rng.randint(0, 60)}") for _ in range(300)]
    names = [f"E{i}" for i in range(61)]
    rng.shuffle(names)
    made, listed = scoring(spark, edges), ranks(spark, [(e, i + 1) for i, e in enumerate(names)])
    whole = sorted(map(tuple, rank_profiles(made, listed).collect()))
    monkeypatch.setattr(enrichment, "RANK_BLOCK", 7)
    assert sorted(map(tuple, rank_profiles(made, listed).collect())) == whole


def test_summary(spark):
    profiles = spark.createDataFrame(
        [
            (1, "a", "e1", 0.1, 3, 2.0),
            (1, "a", "e2", 0.2, 3, 5.0),
            (1, "a", "e3", 0.3, 3, 5.0),
            (1, "b", "e1", 0.1, 2, 1.0),
            (1, "b", "e2", 0.2, 2, 3.0),
            (1, "c", "e1", 0.1, 1, None),
            (1, "d", "e1", 0.1, 1, float("nan")),
        ],
        "list_id int, term_id string, element string, element_relative_rank double, term_size long, z_score double",
    )
    rows = [tuple(r)[1:] for r in summarize_profiles(profiles, "z_score", "max").collect()]
    assert rows[0] == ("a", 3, 2.0, "e1", 0.1, 5.0, "e2", 0.2, 5.0, "e2", 0.2)
    assert rows[1] == ("b", 2, 1.0, "e1", 0.1, 2.0, "e1", 0.1, 3.0, "e2", 0.2)
    assert rows[2] == ("c", *[None] * 10) and rows[3] == ("d", *[None] * 10)
    assert [r.term_id for r in summarize_profiles(profiles, "z_score", "min").collect()] == ["b", "a", "c", "d"]
    with pytest.warns(UserWarning):
        assert summarize_profiles(profiles, "unknown").count() == 0
    with pytest.warns(UserWarning):
        assert summarize_profiles(profiles.drop("element"), "z_score").count() == 0
    with pytest.raises(TypeError):
        summarize_profiles([profiles])
    assert summarize_profiles(profiles.limit(0), "z_score").count() == 0
