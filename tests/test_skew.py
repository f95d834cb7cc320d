import random
from collections import Counter

import numpy as np
import pytest

from graphloom import hot_values, key_profile, weighted_percentiles
from graphloom.operators.skew import dominant_keys


def skewed(n=3000):
    rng = random.Random(6)
    rows = []
    for _ in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None, "", f"k{rng.randint(0, 200)}"])
        rows.append((key, rng.choice([None, "x", "y"]) if rng.random() < 0.3 else f"v{rng.randint(0, 50)}", 7, 8))
    return rows


def test_key_profile(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v string, key int, value int")
    want = {}
    for key in {r[0] for r in rows}:
        counts = Counter(r[1] for r in rows if r[0] == key)
        known = {v: n for v, n in counts.items() if v is not None}
        mode = min(known, key=lambda v: (-known[v], v)) if known else None
        want[key] = (counts.total(), len(known), mode, known.get(mode))
    assert {r.key: tuple(r)[1:] for r in key_profile(df, "k", "v").collect()} == want
    assert key_profile(df.limit(0), "k", "v").count() == 0


def test_dominant_keys_at_the_border(spark):
    rows = [("a", str(i)) for i in range(2)] + [(None, "z")] * 50 + [(f"k{i}", "x") for i in range(48)]
    df = spark.createDataFrame(rows, "k string, v string")
    assert [r.key for r in dominant_keys(df, "k", "v", 0.02).collect()] == ["a"]


@pytest.mark.parametrize("splitters", [1, 2, 16])
def test_percentiles(spark, splitters):
    rng = np.random.default_rng(7)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.integers(5)}", float(rng.integers(40)) / 8) for _ in range(2000)]
    rows += [(None, 1.5), (None, 2.5), ("nulls", None), ("nan", float("nan")), ("one", -3.0)]
    df = spark.createDataFrame(rows, "key string, value double")
    asked = [0.0, 0.1, 0.5, 0.93, 1.0]
    found = {(r.key, r.probability): r.percentile for r in weighted_percentiles(df, "key", "value", asked, splitters).collect()}
    keys = {k for k, v in rows if v is not None and v == v}
    assert {k for k, _ in found} == keys
    for key in keys:
        values = [v for k, v in rows if k == key and v is not None]
        for p in asked:
            assert found[key, p] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert weighted_percentiles(df.limit(0), "key", "value", [0.5]).count() == 0


def test_hot_values(spark):
    df = spark.createDataFrame(skewed(), "k string, v string, key int, value int")
    hot = hot_values(df, ["k", "v"], share=0.1)
    assert hot["k"][0] == "hot" and None not in hot["k"]
    assert hot_values(df.limit(0), ["k"]) == {"k": []}
