"""Problems 1, 2, 4 and 7 against brute force on tables with nulls, blanks, repetitions and hot keys."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import layout
from graphloom.llm.cooccurrence import cooccurring_items
from graphloom.llm.frequencies import value_frequencies
from graphloom.llm.set_overlap import set_overlaps
from graphloom.llm.similar_sets import forest_shape, similar_keys, similar_sets

BLANKS = [None, "", " ", "\t", "  "]


def make(seed, n=2500):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        term = "T0" if rng.random() < 0.35 else f"T{rng.randint(1, 120)}"
        element = "E0" if rng.random() < 0.2 else f"E{int(400 * rng.random() ** 2)}"
        rows.append((rng.choice(BLANKS) if rng.random() < 0.02 else term, rng.choice(BLANKS) if rng.random() < 0.02 else element))
    rows += [("T7", "E9")] * 900  # one pair holds a large part of all rows
    for copy in ("X1", "X2", "X3"):
        rows += [(copy, f"Y{i}") for i in range(12)]
    rows += [("X4", f"Y{i}") for i in range(10)] + [("X5", f"Y{i}") for i in range(9)] + [("X6", f"Y{i}") for i in range(3)]
    rows += [("big", f"B{i}") for i in range(150)] + [("big2", f"B{i}") for i in range(60, 190)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return make(1)


@pytest.fixture(scope="module")
def sets(rows):
    found = defaultdict(set)
    for t, e in rows:
        if t and e and t.strip() and e.strip():
            found[t].add(e)
    return found


@pytest.fixture(scope="module")
def df(spark, rows):
    extra = [(t, e, "k", "m", 1, i) for i, (t, e) in enumerate(rows)]
    return spark.createDataFrame(extra, "term string, element string, key string, member string, n int, code int").repartition(5)


def test_frequencies(df, rows, sets):
    lists = defaultdict(set)
    for t, es in sets.items():
        for e in es:
            lists[e].add(t)
    times = Counter((t, e) for t, e in rows if t in sets and e in sets[t])
    want = {}
    for field, groups, other in (("term", sets, len(lists)), ("element", lists, len(sets))):
        for value, partners in groups.items():
            n = len(partners)
            mark = "rare" if n == 1 else "common" if n * 10 >= other else None
            pairs = ((value, p) if field == "term" else (p, value) for p in partners)
            want[field, value] = (sum(times[p] for p in pairs), n, mark)
    found = {(r.field_name, r.field_value): (r.n_rows, r.n_records, r.mark) for r in value_frequencies(df).collect()}
    assert found == want
    assert value_frequencies(df.limit(0)).count() == 0


@pytest.mark.parametrize("lift", [None, 10, 1.5])
def test_cooccurrence(df, sets, lift):
    small = {t: e for t, e in sets.items() if len(e) <= 60}
    single = Counter(e for es in small.values() for e in es)
    pairs = Counter(p for es in small.values() for p in itertools.combinations(sorted(es), 2))
    n = len(small)
    want = {}
    for (a, b), k in pairs.items():
        if k >= 3 and (lift is None or k * n >= lift * single[a] * single[b]):
            odds = (k + 0.5) * (n - single[a] - single[b] + k + 0.5) / ((single[a] - k + 0.5) * (single[b] - k + 0.5))
            want[a, b] = (single[a], single[b], k, n, math.log(odds))
    found = cooccurring_items(df, most_items=60, least_together=3, least_lift=lift).collect()
    assert {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_together, r.n_all) for r in found} == {k: v[:4] for k, v in want.items()}
    for r in found:
        assert r.log_odds == pytest.approx(want[r.item_a, r.item_b][4])
    assert cooccurring_items(df.limit(0)).count() == 0


def test_packed_codes_over_small_runs(df, sets, monkeypatch):
    from graphloom.llm import cooccurrence

    monkeypatch.setattr(cooccurrence, "RUN", 50)
    first = sorted(map(tuple, cooccurring_items(df, most_items=60, least_together=2).collect()))
    monkeypatch.setattr(cooccurrence, "RUN", 1 << 22)
    assert first == sorted(map(tuple, cooccurring_items(df, most_items=60, least_together=2).collect()))


def test_a_record_within_the_limit_counts_whatever_its_members_hash_to(spark):
    # of many members those that a sketch of 512 registers takes for thousands
    hashed = spark.range(400_000).select(F.format_string("E%06d", "id").alias("e")).withColumn("h", F.xxhash64("e"))
    tail = F.shiftrightunsigned(F.shiftleft("h", 9), 1)
    rarest = hashed.groupBy(F.shiftrightunsigned("h", 55)).agg(F.min_by("e", tail).alias("e")).collect()
    items = sorted(r.e for r in rarest)[:500]
    assert len(items) == 500
    rows = [("K", e) for e in items] + [(f"T{i}", e) for i in range(3) for e in items[:2]]
    found = cooccurring_items(spark.createDataFrame(rows, "term string, element string"), most_items=500, least_together=4)
    assert [(r.item_a, r.item_b, r.n_a, r.n_together, r.n_all) for r in found.collect()] == [(*items[:2], 4, 4, 4)]


@pytest.mark.parametrize("most", [0, 1, 5, 60, 100, 149, 150, 189, 5000])
def test_keys_are_proven_large_only_if_they_are(df, sets, most):
    rows = layout.clean_pairs(df, "term", "element")
    large = {t for t, e in sets.items() if len(e) > most}
    proven = layout.proven_large(rows, list(sets), most)
    assert large >= set(proven) >= {t for t, e in sets.items() if len(e) > 2 * most} and len(proven) == len(set(proven))
    found = {r.key: set(r.members) for r in layout.small_sets(rows, most).collect()}
    assert found == {t: e for t, e in sets.items() if t not in large}


def test_spellings_that_are_equal_under_a_collation_are_one_member(spark):
    spelled = ["".join(c) for w in "uvwxyz" for c in itertools.product(*[(x, x.upper()) for x in f"item{w}"])]
    rows = [(k, e) for e in spelled for k in "Kk"] + [("L", f"item{i}") for i in range(40)]
    pairs = spark.createDataFrame(rows, "key string, member string")
    key, member = F.collate("key", "UTF8_LCASE").alias("key"), F.collate("member", "UTF8_LCASE").alias("member")
    found = layout.small_sets(pairs.select(key, member), 10).collect()
    assert [(r.key.upper(), {m.lower() for m in r.members}) for r in found] == [("K", {f"item{w}" for w in "uvwxyz"})]
    assert layout.small_sets(pairs.select(key, "member"), 10).count() == 0
    bytewise = layout.small_sets(pairs.select(key, "member"), 6 * 32).collect()
    assert sorted((r.key.upper(), len(r.members)) for r in bytewise) == [("K", 6 * 32), ("L", 40)]


@pytest.mark.parametrize("size, split, listed", [(1 << 17, 1 << 20, 128), (50, 1 << 20, 4), (50, 40, 2), (400, 40, 128)])
def test_overlaps(df, sets, size, split, listed, monkeypatch):
    from graphloom.llm import set_overlap

    for name, value in (("RANGE", size), ("SPLIT", split), ("LISTED", listed)):
        monkeypatch.setattr(set_overlap, name, value)
    large = {t: e for t, e in sets.items() if len(e) >= 10}
    want = {
        (a, b): (len(large[a]), len(large[b]), len(large[a] & large[b]))
        for a, b in itertools.combinations(sorted(large), 2)
        if large[a] & large[b]
    }
    found = {(r.set_a, r.set_b): (r.n_a, r.n_b, r.shared) for r in set_overlaps(df, least=10).collect()}
    assert found == want and len(want) > 100
    assert set_overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_range_counts(monkeypatch, parts):
    import numpy as np

    from graphloom.llm import set_overlap

    rng = np.random.default_rng(5)
    for _ in range(10):
        for name in ("LISTED", "STEP", "HELD"):
            monkeypatch.setattr(set_overlap, name, int(rng.integers(1, 200)))
        codes = np.unique(rng.integers(0, 60, 800) << 32 | (rng.random(800) ** 3 * 90).astype(np.int64))
        numbers, ids = codes >> 32, codes & 0xFFFFFFFF
        held = defaultdict(set)
        for s, e in zip(numbers.tolist(), ids.tolist()):
            held[s].add(e)
        want = {
            (a << 32) | b: len(held[a] & held[b])
            for a, b in itertools.combinations(sorted(held), 2)
            if held[a] & held[b] and (parts == 1 or a % parts != b % parts)
        }
        code, count = set_overlap.range_counts(numbers, ids, numbers % parts if parts > 1 else None)
        assert dict(zip(code.tolist(), count.tolist())) == want


def test_a_range_of_many_small_sets_is_not_compared_set_by_set():
    import time

    import numpy as np

    from graphloom.llm import set_overlap

    codes = np.unique(np.repeat(np.arange(8000), 100) << 32 | np.random.default_rng(1).integers(0, 1 << 15, 800_000))
    began = time.perf_counter()
    code, count = set_overlap.range_counts(codes >> 32, codes & 0xFFFFFFFF)
    assert time.perf_counter() - began < 30 and len(code) > 8_000_000 and count.sum() > len(code)


def brute_similar(sets, threshold, least):
    kept = {t: e for t, e in sets.items() if len(e) >= least}
    return {
        (a, b)
        for a, b in itertools.combinations(sorted(kept), 2)
        if len(kept[a] & kept[b]) * 10_000 >= round(threshold * 10_000) * len(kept[a] | kept[b])
    }


@pytest.mark.parametrize("chunk, crowd, block", [(20_000, 100, 1 << 16), (3, 100, 1 << 16), (3, 1, 1 << 16), (20_000, 1, 7)])
def test_similar_keys(df, sets, chunk, crowd, block, monkeypatch):
    from graphloom.llm import similar_sets as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    monkeypatch.setattr(module, "CROWD", crowd)
    monkeypatch.setattr(module, "HOT_ROWS", 100 * crowd)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 10 * chunk)
    monkeypatch.setattr(module._grouped, "__defaults__", (block, True))
    want = brute_similar(sets, 0.7, 4)
    assert {("X1", "X2"), ("X1", "X4"), ("X2", "X5"), ("X4", "X5")} <= want
    assert {tuple(r) for r in similar_keys(df).collect()} == want
    if block > 7:
        pairs, members = similar_sets(df)
        classes = {r.key: r for r in members.collect()}
        assert set(classes) == {t for t, e in sets.items() if len(e) >= 4}
        assert classes["X3"].class_key == "X1" and classes["X3"].links == 2
        assert {(r.class_a, r.class_b): (r.shared, r.either) for r in pairs.collect()}["X1", "X4"] == (10, 12)
        assert similar_keys(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [100, 5])
def test_recall_of_many_planted_pairs(spark, crowd, monkeypatch):
    from graphloom.llm import similar_sets as module

    monkeypatch.setattr(module, "CROWD", crowd)
    rng = random.Random(9)
    rows, planted = [], set()
    for i in range(400):
        base = [f"e{rng.randint(0, 10**9)}" for _ in range(17)]
        rows += [(f"a{i:03}", e) for e in base]
        other = base[:14] + [f"f{rng.randint(0, 10**9)}" for _ in range(3)]  # 14 / 20
        rows += [(f"b{i:03}", e) for e in other]
        planted.add((f"a{i:03}", f"b{i:03}"))
    found = {tuple(r) for r in similar_keys(spark.createDataFrame(rows, "term string, element string")).collect()}
    assert found == planted


def test_recall_where_every_neighbourhood_is_crowded(spark, monkeypatch):
    """Sets around a common core, so that short prefixes are shared by many that are not similar enough."""
    from graphloom.llm import similar_sets as module

    monkeypatch.setattr(module, "CROWD", 3)
    rng = random.Random(10)
    sets = {f"s{i:03}": set(range(12)) | {100 * i + k for k in range(8)} for i in range(1, 300)}
    for i in range(1, 60):
        sets[f"t{i:03}"] = set(sorted(sets[f"s{i:03}"])[:17]) | {10**6 + 10 * i + k for k in range(3)}  # 17 / 23
    rows = [(k, f"e{x}") for k, v in sets.items() for x in v]
    rng.shuffle(rows)
    found = {tuple(r) for r in similar_keys(spark.createDataFrame(rows, "term string, element string")).collect()}
    assert found == brute_similar(sets, 0.7, 4)


def test_forest_shape_grows_with_the_table():
    shapes = [forest_shape(n, 0.7, 0.9999) for n in (0, 100, 10_000, 10_000_000)]
    assert [d for d, *_ in shapes] == [3, 3, 3, 5]
    for deepest, first, trees in shapes:
        assert 1 - (1 - 0.7**2) ** first >= 0.9999
        assert 1 - (1 - 0.7**deepest) ** trees >= 0.9999 and deepest * trees >= 128


def test_neighbourhoods_deepen_where_they_are_crowded(monkeypatch):
    import numpy as np

    from graphloom.llm import similar_sets as module

    monkeypatch.setattr(module, "CROWD", 2)
    words = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 2], [1, 1, 3], [2, 2, 1], [2, 2, 2], [2, 2, 9]], np.uint16)
    first, depth = module.neighbourhoods(np.array([5, 5, 5, 5, 7, 7, 8]), words, np.full(7, 2))
    assert depth.tolist() == [3, 3, 3, 3, 2, 2, 2] and first.tolist() == [0, 0, 2, 3, 4, 4, 6]


def test_a_crowd_is_laid_over_many_labels(spark, monkeypatch):
    """A crowd far below 1/10,000 of the rows is split all the same."""
    from pyspark.sql import functions as F

    from graphloom.llm import similar_sets as module

    monkeypatch.setattr(module, "CHUNK", 10)
    rows = spark.range(60_000).select(F.lit(0).alias("tree"), F.col("id").cast("string").alias("key"))
    prefix = F.when(F.col("key").cast("long") < 50, F.lit("same!!")).otherwise(F.lpad("key", 6, "0")).cast("binary")
    laid = module.laid_out(rows.withColumn("prefix", prefix), 3).where("cast(key as long) < 50")
    labels = laid.groupBy("label").count().collect()
    assert len(labels) == 15 and max(r["count"] for r in labels) < 40
    pairs = laid.alias("x").join(laid.alias("y"), "label").where("x.key < y.key and (not x.cross or x.chunk <> y.chunk)")
    assert pairs.count() == pairs.select("x.key", "y.key").distinct().count() == 50 * 49 // 2


def test_a_long_group_is_streamed_in_pieces():
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import similar_sets as module

    rng = np.random.default_rng(3)
    rows = sorted((f"k{int(k)}", int(h)) for k, h in zip(rng.integers(0, 5, 4000) ** 2 // 4, rng.integers(-99, 99, 4000)))

    def signatures(size):
        batches = (
            pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int64())], ["key", "h"])
            for part in (rows[i : i + size] for i in range(0, len(rows), size))
        )
        out = {}
        for keys, sizes, prints, least in module._signatures(batches, 5):
            for i, k in enumerate(keys.to_pylist()):
                assert k not in out
                out[k] = (int(sizes[i]), int(prints[0][i]), int(prints[1][i]), least[i].tolist())
        return out

    whole = signatures(10**6)
    assert {k: v[0] for k, v in whole.items()} == {k: len({h for x, h in rows if x == k}) for k, _ in rows}
    defaults = module._grouped.__defaults__
    try:
        module._grouped.__defaults__ = (50, True)
        assert signatures(20) == whole and signatures(1) == whole
    finally:
        module._grouped.__defaults__ = defaults


def test_codes_are_unique(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as v")
    codes = [r.c for r in layout.with_codes(df, "v", "c", buckets=16).collect()]
    assert len(set(codes)) == 3000 and min(codes) >= 0
