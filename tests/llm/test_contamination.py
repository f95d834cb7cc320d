"""Problem 9: planted reprints with damage, and look-alike sentences that are none."""

import random

import pytest

from graphloom.llm import contamination as c

WORDS = [f"{a}{b}" for a in ("stone", "wood", "river", "field", "lamp", "cord") for b in ("gate", "mark", "holt", "wick", "ley", "ford", "burn", "dale")]


def page(lines, y=0, x=80):
    return [(line, x, y + 30 * i, x + 10 * len(line)) for i, line in enumerate(lines)]


def wrapped(words, rng, width=30, marks="-=¬­"):
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) + 1 > width:
            if rng.random() < 0.3 and len(w) > 5:
                lines.append(f"{line} {w[:3]}{rng.choice(marks)}")
                line = w[3:]
                continue
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return [*lines, line]


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(13)
    items = [(i, " ".join(rng.choices(WORDS, k=60)).capitalize() + ".") for i in range(40)]
    items += [(90, None), (91, ""), (92, "too short to be found")]
    pages, want = [], set()

    def add(lines):
        rng.shuffle(lines)
        boxes = [(x0, y0, x1, y0 + 20, None) for _, x0, y0, x1 in lines]
        pages.append((len(pages), "\n".join(t for t, *_ in lines), boxes))

    def noise(n):
        return rng.choices([w[::-1] for w in WORDS] + ["the", "and", "of", "was"], k=n)

    def damaged(words):
        out = list(words)
        for at in range(rng.randint(0, 5), len(out), 6):
            w = out[at]
            out[at] = w[:2] + rng.choice(["■", "1", "rn", ""]) + w[3:]
        return out

    for i in range(40):
        words = items[i][1].rstrip(".").split()
        at = rng.randint(0, 40)
        n = rng.randint(14, 20)
        part = words[at : at + n]
        if i % 4 == 0:  # adverts between the lines
            lines = wrapped(part[: n // 2], rng) + ["GRAND SALE, Friday, 12 lots."] + wrapped(part[n // 2 :], rng)
            body = wrapped(noise(20), rng) + lines + wrapped(noise(20), rng)
        elif i % 4 == 1:
            body = wrapped(noise(20) + damaged(part) + noise(20), rng)
        elif i % 4 == 2:  # other letters of one shape, without punctuation, in capitals
            text = " ".join(part).upper().replace("O", "О").replace("E", "Ε").replace("A", "A​")
            body = wrapped(noise(20) + text.split() + noise(20), rng)
        else:
            body = wrapped(noise(15) + part + noise(15), rng)
        want.add((len(pages), i))
        half = len(body) // 2
        if i % 3 == 0:
            add(page(body[:half]) + page(body[half:], x=500))
        elif i % 3 == 1:
            add(page(body))
        else:  # both columns read as one
            left, right = body[:half], body[half:]
            lines = []
            for k in range(max(len(left), len(right))):
                a, b = left[k] if k < len(left) else "", right[k] if k < len(right) else ""
                if a and b:
                    lines.append((f"{a.ljust(30)} | {b}", 80, 30 * k, 80 + 10 * (33 + len(b))))
                else:
                    lines.append((a or b, 80 if a else 410, 30 * k, 380))
            add(lines)
    for i in range(40):  # eleven words, or every fourth word another
        words = items[i][1].rstrip(".").split()
        add(page(wrapped(noise(10) + words[20:31] + noise(10), rng)))
        other = [w if k % 4 else rng.choice(["north", "south", "92"]) for k, w in enumerate(words)]
        add(page(wrapped(other, rng)))
    pages += [(900, None, None), (901, "", []), (902, "\n\n", [(1, 1, 1, 1, None)] * 3), (903, items[5][1] * 300, None)]
    pages.append((904, items[6][1] + "\n" + items[7][1], [(1, 1, 9, 9, None)]))  # boxes do not fit the lines
    want |= {(903, 5), (904, 6), (904, 7)}
    pages.append((905, " ".join(noise(60_000)), None))
    kind = "doc_id long, text string, boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:double>>"
    return spark.createDataFrame(pages, kind).repartition(3), spark.createDataFrame(items, "item_id long, passage string"), want


def test_reprints(world):
    pages, items, want = world
    found = {(r["key"], r["item"]): r.n_words for r in c.leaked_items(pages, items).collect()}
    assert set(found) == want
    assert found[904, 6] == 60


@pytest.mark.parametrize("bits", [1 << 27, 1 << 8])
def test_passages_joined_by_their_seeds(world, monkeypatch, bits):
    pages, items, _ = world
    want = sorted(map(tuple, c.leaked_items(pages, items).collect()))
    monkeypatch.setattr(c, "BLOCK_CHARS", 10)
    monkeypatch.setattr(c, "FILTER_BITS", bits)
    assert sorted(map(tuple, c.leaked_items(pages, items).collect())) == want
    assert c.leaked_items(pages.limit(0), items).count() == 0
    twice = c.leaked_items(pages.unionByName(pages), items.unionByName(items))
    assert sorted(map(tuple, twice.collect())) == sorted(want * 4)


def test_long_passages_in_pieces(world, monkeypatch):
    pages, items, want = world
    monkeypatch.setattr(c, "PIECE", 40)
    assert {(r["key"], r["item"]) for r in c.leaked_items(pages, items).collect()} == want


def test_arrays_grow_with_the_words_of_passages():
    texts = ["some few words only"] * 500 + [" ".join(f"w{i}" for i in range(100_000))]
    made = c.Passages(list(range(501)), texts, c.look_alikes())
    arrays = sum(x.nbytes for x in vars(made).values() if hasattr(x, "nbytes"))
    assert arrays < 64e6 and made.width == c.PIECE
    assert {made.keys[i] for i in made.first} == set(range(501))


def test_columns_and_bars_are_parameters():
    lines, left, top, right = ["a1", "b1", "a2 / b2"], [0, 60, 0], [0, 0, 30], [40, 100, 100]
    assert c.reading_order(lines, left, top, right, gap=50, bar=" / ") == ["a1", "a2", "b1", "b2"]
    assert c.reading_order(lines, left, top, right) == ["a1", "b1", "a2 / b2"]


def test_empty_tables(world):
    pages, items, _ = world
    assert c.leaked_items(pages.limit(0), items).count() == 0
    assert c.leaked_items(pages, items.limit(0)).count() == 0


def test_seeds_find_twelve_words_with_two_damaged():
    import itertools

    import numpy as np

    for a, b in itertools.combinations(range(12), 2):
        numbers = np.arange(1, 13)
        numbers[[a, b]] = 0
        assert sum(len(c.seed_hashes(numbers, m)[0]) for m in range(len(c.MASKS))) >= 3


@pytest.mark.parametrize(
    "states, words",
    [
        ([0] * 12, 12),
        ([0] * 11, 0),
        ([0, 1] + [0] * 8 + [1, 0], 12),
        ([0, 1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0], 0),
        ([0] * 6 + [2] + [0] * 6, 0),
        ([2] * 3 + [0] * 15 + [2], 15),
    ],
)
def test_longest_reprint(states, words):
    import numpy as np

    assert c.longest_reprint(np.array(states)) == words


def found_in(words, lines):
    passages = c.Passages([7], [" ".join(words)], c.look_alikes())
    return c.search_block([c.page_words(lines)], passages, c._Words(passages.vocabulary, passages.table))


BEFORE, BEHIND = ["so far the older news of that week", "which nobody asked for"], ["then came rain", "and all went home"]


@pytest.mark.parametrize("word, read", [("from", "frorn"), ("must", "rnust"), ("will", "vvill"), ("warm", "vvarrn"), ("mum", "rnurn")])
def test_letters_misread_as_two(word, read):
    words = [*WORDS[:7], word, *WORDS[8:16]]
    body = [*WORDS[:7], read, *WORDS[8:16]]
    assert found_in(words, [*BEFORE, " ".join(body), *BEHIND]) == [(0, 0, 16)]


@pytest.mark.parametrize("word, other", [("boy", "born"), ("cow", "corn"), ("man", "barn"), ("from", "front")])
def test_two_letters_are_not_any_letter(word, other):
    assert not c._near(other, word)


ADVERT = ["GRAND SALE of pots on Friday", "TWELVE LOTS, see the bills"]


@pytest.mark.parametrize(
    "first, advert, second",
    [
        ("wint-", ADVERT, "ersgate"),  # the halves are 12 words apart
        ("wint-", ["SALE"], "ersgate"),
        ("vvint-", ADVERT, "ersgate"),  # and a letter is misread
        ("wint-", [*ADVERT, "all must-"], "ersgate"),  # the advert's last line ends broken, too
        ("wintersgate~", ADVERT, ""),  # a stain behind a whole word
        ("", [*ADVERT, "all must-"], "wintersgate"),
    ],
)
def test_word_broken_by_an_advert(first, advert, second):
    words = [*WORDS[:8], "wintersgate", *WORDS[8:15]]
    lines = [" ".join([*WORDS[:8], first]), *advert, " ".join([second, *WORDS[8:15]])]
    assert found_in(words, [*BEFORE, *lines, *BEHIND]) == [(0, 0, 16)]


def test_other_half_is_missing():
    words = [*WORDS[:8], "wintersgate", *WORDS[8:15]]
    lines = [" ".join([*WORDS[:8], "wint-"]), *ADVERT, " ".join(["lamp", *WORDS[8:15]])]
    assert found_in(words, [*BEFORE, *lines, *BEHIND]) == []


def inserted(n):
    return [f"item {i} of the long list of goods" for i in range(n // 8)]


@pytest.mark.parametrize("gap", [40, 80, 400])
def test_parts_far_from_each_other(gap):
    words = WORDS[:18]
    lines = [*BEFORE, " ".join(words[:6]), *inserted(gap), " ".join(words[6:12]), *inserted(gap), " ".join(words[12:]), *BEHIND]
    assert found_in(words, lines) == [(0, 0, 18)]


def test_far_parts_in_other_order_or_within_lines():
    words = WORDS[:14]
    one, other = " ".join(words[:7]), " ".join(words[7:])
    assert found_in(words, [*BEFORE, other, *inserted(80), one, *BEHIND]) == []
    assert found_in(words, [*BEFORE, f"{one} was said", *inserted(80), f"and so {other}", *BEHIND]) == []


def test_word_broken_by_many_lines():
    words = [*WORDS[:8], "wintersgate", *WORDS[8:15]]
    lines = [" ".join([*WORDS[:8], "wint-"]), *inserted(80), " ".join(["ersgate", *WORDS[8:15]])]
    assert found_in(words, [*BEFORE, *lines, *BEHIND]) == [(0, 0, 16)]


@pytest.mark.parametrize("sizes", [(3, 9), (9, 3), (2, 10), (11, 1), (3, 9, 3), (3, 6, 3)])
def test_short_parts_behind_adverts(sizes):
    words, lines, at = WORDS[: sum(sizes)], [], 0
    for n in sizes:
        lines += [*(ADVERT if lines else []), " ".join(words[at : at + n])]
        at += n
    assert found_in(words, [*BEFORE, *lines, *BEHIND]) == [(0, 0, len(words))]


def test_short_part_begins_with_a_broken_word():
    lines = [" ".join([*WORDS[:9], WORDS[9][:4] + "-"]), *ADVERT, " ".join([WORDS[9][4:], *WORDS[10:12]])]
    assert found_in(WORDS[:12], [*BEFORE, *lines, *BEHIND]) == [(0, 0, 12)]
    lines = [" ".join([*WORDS[:2], WORDS[2][:4] + "-"]), *ADVERT, " ".join([WORDS[2][4:], *WORDS[3:12]])]
    assert found_in(WORDS[:12], [*BEFORE, *lines, *BEHIND]) == [(0, 0, 12)]


def test_word_within_a_line_is_no_part():
    words = [*WORDS[:11], "which"]
    assert found_in(words, [*BEFORE, " ".join(words[:11]), "and which", *ADVERT, "the which", *BEHIND]) == []
    assert found_in([*WORDS[:11], "the"], [*BEFORE, " ".join(words[:11]), *ADVERT, "the pots", *BEHIND]) == []
