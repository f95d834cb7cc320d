"""Problems 3, 8 and 10 against brute force."""

import random
import unicodedata
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import lookalikes, tokenizer
from graphloom.llm.format_duplicates import distinct_edges, edge_copies

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def bare(v):
    return "".join(c for c in v if unicodedata.category(c)[0] not in "PZC" and not c.isspace()).lower()


@pytest.mark.parametrize("constant_hash, hot", [(False, 100_000), (True, 100_000), (False, 100)])
def test_edge_copies(spark, monkeypatch, constant_hash, hot):
    from pyspark.sql import functions as F

    from graphloom.llm import format_duplicates

    monkeypatch.setattr(format_duplicates, "HOT_ROWS", hot)
    if constant_hash:  # every row shares its fingerprint with strangers: the exact ends must decide
        def weak(fields, seed):
            return F.length(fields[0]).cast("long") + F.length(fields[1])

        monkeypatch.setattr(format_duplicates, "_fingerprint", weak)
    rng = random.Random(10)
    marks = [" ", " ", " ", "-", "‐", "·", "«", "(", "\t", ".", "​", "'"]
    rows = []
    for i in range(1200):
        ends = [f"ab{rng.choice('cd')}{rng.randint(1, 30):03}" for _ in range(2)] if rng.random() > 0.4 else ["abc001", "abd002"]
        rng.shuffle(ends)
        ends = ["".join(c.upper() if rng.random() < 0.2 else c for c in e) for e in ends]
        ends = [e[:3] + rng.choice(marks) * rng.randint(0, 2) + e[3:] + rng.choice(["", " ", ")"]) for e in ends]
        if rng.random() < 0.03:
            ends[rng.randint(0, 1)] = rng.choice([None, "", "  ", "--"])
        rows.append((i, *ends, "x", i))
    groups = defaultdict(list)
    for i, v, w, *_ in rows:
        if v and w and bare(v) and bare(w):
            groups[tuple(sorted((bare(v), bare(w))))].append(i)
    want = {(g[0], i, len(g)) for g in groups.values() for i in g}
    df = spark.createDataFrame(rows, "edge_id long, vertex1 string, vertex2 string, fp string, key int").repartition(4)
    assert sorted(tuple(r) for r in edge_copies(df).collect()) == sorted(want)
    assert {tuple(r) for r in distinct_edges(df).collect()} == {(f, n) for f, _, n in want}
    assert edge_copies(df.limit(0)).count() == 0 and distinct_edges(df.limit(0)).count() == 0


TEXTS = [
    None,
    "",
    " ",
    "\n\n ",
    "don't 's 'S we'll I'd they've you're it'm 'tis",
    "''s'''s ' s",
    "a  b  c 　d\n\n  e\t\tf ",
    "<|endoftext|> x <|endoftext|>",
    "مرحبا 你好！12½Ⅷ \U0001f600\U0001f468‍\U0001f469 é",
    "x" * 20_000,
    " " * 5000 + "y",
    "ab" * 30_000 + "\n" * 3000,
    "l'",
    "'",
    "a'l",
    "a'll'",
]


@pytest.fixture(scope="module")
def reference_ids():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_encoding(spark, reference_ids):
    rng = random.Random(11)
    alphabet = " \n\t'sdtmlvreéя12■　 .,"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t, "ids", [1]) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids array<int>")
    coded = tokenizer.encode_texts(df, PATH, offsets=True).collect()
    assert len(coded) == len(texts)
    for r in coded:
        text = texts[r.doc_id] or ""
        assert r.ids == reference_ids(text), repr(text)[:80]
        assert sum(r.slice_chars) == len(text) and sum(r.slice_ids) == len(r.ids)
    again = tokenizer.decode_texts(tokenizer.encode_texts(df, PATH), PATH).collect()
    assert {r.doc_id: r.text for r in again} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode_texts(df.limit(0), PATH).count() == 0


def test_blocks_and_cache_do_not_matter(spark, reference_ids, monkeypatch):
    monkeypatch.setattr(tokenizer, "BLOCK", 7)
    monkeypatch.setattr(tokenizer, "CACHE", 3)
    df = spark.createDataFrame(list(enumerate(TEXTS[:9])), "doc_id long, text string")
    for r in tokenizer.encode_texts(df, PATH).collect():
        assert r.ids == reference_ids(TEXTS[r.doc_id])


def shape(text):
    letters = dict(zip(lookalikes.CYRILLIC + lookalikes.GREEK, lookalikes.AS_LATIN + lookalikes.AS_LATIN_GREEK))
    letters |= dict(zip(lookalikes.CYRILLIC_ONLY, lookalikes.AS_GREEK))
    out = []
    for c in unicodedata.normalize("NFD", text):
        c = unicodedata.normalize("NFKC", c) if 0xFF00 <= ord(c) <= 0xFFEF or 0xFB00 <= ord(c) <= 0xFB06 else c
        c = " " if unicodedata.category(c[0]) == "Zs" else c
        out.append("" if c in lookalikes.WIDTHLESS else letters.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def test_look_alikes(spark):
    rng = random.Random(12)
    swaps = {"a": "аａ", "o": "оοｏ", "e": "е", " ": "  　", "T": "ТΤ", "1": "１", ".": "．"}
    rows, texts = [], ["To a1. café fine\nfoe", "To a1. cafe fine\nfoe", "to a1. café fine\nfoe", "ёй а", "12", "a b", "ab", "a\nb", "To a1, café fine\nfoe"]
    for i in range(400):
        text = "".join(rng.choice(swaps[c]) if c in swaps and rng.random() < 0.15 else c for c in rng.choice(texts))
        if rng.random() < 0.3:
            text = text.replace("fi", "ﬁ").replace("é", "é")
        if rng.random() < 0.2:
            text = text[:1] + rng.choice("​⁠﻿") + text[1:]
        rows.append((i, text))
    rows += [(1000 + i, t) for i, t in enumerate(["", " ", " ", None, "​", "\n", "x" * 200_000, "x" * 199_999 + "х"])]
    rows += rows[:3]
    df = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, shape string, key int").repartition(4)
    classes = defaultdict(set)
    for i, t in rows:
        if t and any(unicodedata.category(c)[0] not in "Z" and unicodedata.category(c) not in ("Cc", "Cf") for c in t):
            classes[shape(t)].add((i, t))
    pairs = {(a[0], b[0]) for g in classes.values() for a in g for b in g if a[0] < b[0] and a[1] != b[1]}
    assert {tuple(r) for r in lookalikes.alike_pairs(df).collect()} == pairs
    first = {i: min(g)[0] for g in classes.values() for i, _ in g}
    want = sorted((i, first.get(i, i)) for i, _ in rows)
    assert sorted(tuple(r) for r in lookalikes.canonical_rows(df).collect()) == want
    assert lookalikes.alike_pairs(df.limit(0)).count() == 0


def test_distinctions_stay(spark):
    texts = ["resume", "résume", "Resume", "resume.", "resume\n", "re sume", "resume1", "rèsume"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert lookalikes.alike_pairs(df).count() == 0


def test_accents_without_a_composed_form(spark):
    pairs = [("ΠΟΥΛΉΘΗ", "ΠΟΥΛΗ\u0301ΘΗ"), ("Ўсё", "У\u0306сё"), ("ΠΟΥΛΉΘΗ", "ΠOΥΛH\u0301ΘH"), ("ГΦ", "ΓФ"), ("Ѓ", "Γ\u0301")]
    for a, b in pairs:
        df = spark.createDataFrame([(1, a), (2, b), (3, a + "x")], "doc_id long, text string")
        assert [tuple(r) for r in lookalikes.alike_pairs(df).collect()] == [(1, 2)], (a, b)


def test_forms_of_every_script_are_coarse_apart(spark):
    from pyspark.sql import functions as F

    rng = random.Random(14)
    for letters in ("абвгд", "αβγδε", "あいうえお", "가각난닫랄", "אבגדה"):
        texts = ["".join(rng.choices(letters, k=30)) for _ in range(2000)]
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        coarse = df.groupBy(lookalikes.coarse_shape(F.col("text"))).count().agg(F.max("count")).first()[0]
        assert coarse < 20


def test_every_character_has_the_coarse_form_of_its_shape():
    bare, shapes, spelled = lookalikes.bare_map(), lookalikes.shape_map(), lookalikes.spelled_out()

    def coarse(text):
        return "".join(bare.get(c, c) for c in text)

    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))):
        same = "".join(shapes.get(x, x) for x in spelled.get(c, c))
        plain = lookalikes.ligatures().get(c, c)
        for form in ("NFC", "NFD"):
            assert coarse(unicodedata.normalize(form, same)) == coarse(plain) == coarse(unicodedata.normalize(form, plain)), hex(ord(c))


def test_slices_stand_where_their_offsets_say(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = tokenizer.decode_slices(tokenizer.encode_texts(df, PATH, offsets=True), PATH).collect()
    whole = defaultdict(str)
    for r in sorted(found, key=lambda r: (r.doc_id, r.slice_no)):
        assert TEXTS[r.doc_id][r.begins :].startswith(r.text) and len(whole[r.doc_id]) == r.begins
        whole[r.doc_id] += r.text
    assert whole == {i: t for i, t in enumerate(TEXTS) if t}
