"""Held-out test passages in training pages: spaced-seed hashing with tolerant verification."""

from __future__ import annotations

import hashlib
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.session import durable

#: Seeds: which of the consecutive words of a window must agree (1); the others are ignored.
MASKS = ("1111", "11011", "10111", "11101", "110011", "101101")
#: Marks that break a word at the end of a line.
BREAKS = "-=\u00ac~\u00ad\u2010\u2011\u2e17"
#: Stands in a word where a line begins, before it or where two halves met; no letter of its plain form.
JOINT = "\n"
#: Characters of all passages together up to which they are broadcast (about 100 bytes each word); more are joined by shuffle.
BLOCK_CHARS = 1 << 22
#: Words of a passage that are compared at once; longer ones are cut into pieces that overlap by half.
PIECE = 256
#: Bits of the filter of all seeds of the passages, and hits that make a page and a passage a candidate.
FILTER_BITS, HITS = 1 << 27, 3
#: Words of a reprint, exact words that make a candidate worth verifying, words per misread and per missing one.
WORDS, EXACT, MISREAD_EVERY, MISSING_EVERY = 12, 9, 6, 24
#: Words between two parts of a reprint that need not be whole lines, and words that run together.
INSERTED, SHIFTED = 60, 3
#: Exact words from which a stretch is completed by parts without a seed, and letters such a part has to share.
STRETCH, LETTERS = 5, 6
#: Single letters that are misread as two.
CONFUSED = {"m": "rn", "w": "vv"}
UNSURE = set("mrnwv")
_GAP = 8


def plain_word(word: str, table: dict[int, str]) -> str:
    """Letters and digits of a word in one form: no case, accents, look-alikes or marks."""
    word = unicodedata.normalize("NFKD", word.translate(table)).casefold()
    return "".join(c for c in word if c.isalnum())


class _Words(dict):
    """Word as written -> number of its plain form in the passages' vocabulary, 0 if in none, -1 if empty."""

    def __init__(self, vocabulary: dict[str, int], table: dict[int, str]):
        self.vocabulary, self.table, self.plains, self.compared = vocabulary, table, {}, {}

    def near(self, word: str, other: str) -> bool:
        """``_near``, remembered: the same words stand at many line ends."""
        if (found := self.compared.get((word, other))) is None:
            if len(self.compared) >= 1 << 20:
                self.compared.clear()
            found = self.compared[word, other] = _near(word, other)
        return found

    def plain(self, word: str) -> str:
        if (plain := self.plains.get(word)) is None:
            if len(self.plains) >= 1 << 20:
                self.plains.clear()
            plain = self.plains[word] = plain_word(word, self.table)
        return plain

    def __missing__(self, word: str) -> int:
        plain = self.plain(word)
        number = self.vocabulary.get(plain, 0) if plain else -1
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = number
        return number


def reading_order(
    lines: list[str], left: list[int], top: list[int], right: list[int], gap: int = 150, bar: str | None = " | "
) -> list[str]:
    """The page's lines column by column, from top to bottom.

    Left edges more than ``gap`` apart begin another column. A line in which
    neighbouring columns were read as one, parted by a ``bar``, is cut at the bars; where
    each part stands follows from its share of the line.
    """
    parts = []
    for line, x0, y0, x1 in zip(lines, left, top, right):
        if bar and bar in line:
            at, width = 0, (x1 - x0) / max(len(line), 1)
            for part in line.split(bar):
                parts.append((x0 + at * width, y0, part))
                at += len(part) + len(bar)
        else:
            parts.append((x0, y0, line))
    edges = sorted(p[0] for p in parts)
    cuts = [b for a, b in zip(edges, edges[1:]) if b - a > gap]
    if not cuts:
        return [p[2] for p in sorted(parts, key=lambda p: p[1])]
    return [p[2] for p in sorted(parts, key=lambda p: (sum(p[0] >= c for c in cuts), p[1]))]


def page_words(lines: list[str]) -> list[str]:
    """The words of ordered lines, those broken at a line's end put together.

    What the next line begins with need not be the other half, so ``JOINT`` keeps both
    apart; it also stands before the first word of every other line.
    """
    words: list[str] = []
    carried = ""
    for line in lines:
        own = line.split()
        if not own:
            continue
        own[0] = carried + JOINT + own[0]
        carried = ""
        if own[-1][-1] in BREAKS and len(own[-1]) > 1:
            carried = own.pop()[:-1]
        words += own
    if carried:
        words.append(carried)
    return words


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def seed_hashes(numbers: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows in which all words that the mask asks for are known."""
    asked = [i for i, c in enumerate(MASKS[mask]) if c == "1"]
    n = len(numbers) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = np.ones(n, bool)
    for i in asked:
        known &= numbers[i : i + n] > 0
    at = np.flatnonzero(known)
    h = np.full(len(at), mask + 1, np.uint64)
    for i in asked:
        h = _scramble(h * np.uint64(0xBF58476D1CE4E5B9) + numbers[at + i].astype(np.uint64))
    return at, h


def look_alikes() -> dict[int, str]:
    """The characters of one shape, for ``plain_word``; built on the driver only."""
    from graphloom.llm.lookalikes import shape_map

    return {ord(c): x for c, x in shape_map().items()}


class Passages:
    """The passages of one block as arrays: word numbers, and all seed hashes in order.

    A passage of more than ``PIECE`` words is several overlapping pieces of one key, so
    the arrays grow with the words, not with the longest passage.
    """

    def __init__(self, keys: list, texts: list[str | None], table: dict[int, str]):
        self.table = table
        self.keys: list = []
        self.first: list[int] = []  # the first piece of the same passage
        plain: list[list[str]] = []
        for key, text in zip(keys, texts):
            words = [p for w in (text or "").split() if (p := plain_word(w, table))]
            for at in range(0, max(1, len(words) - PIECE // 2), PIECE // 2) if len(words) > PIECE else (0,):
                plain.append(words[at : at + PIECE])
                self.first.append(len(self.keys) if not at else self.first[-1])
                self.keys.append(key)
        self.words = plain
        self.vocabulary: dict[str, int] = {}
        for words in plain:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.lengths = np.array([len(w) for w in plain], np.int64)
        self.width = int(self.lengths.max(initial=0))
        self.numbers = np.full((len(plain), self.width), -2, np.int32)
        for i, words in enumerate(plain):
            self.numbers[i, : len(words)] = [self.vocabulary[w] for w in words]
        hashes, items, places = [], [], []
        for i, words in enumerate(plain):
            for mask in range(len(MASKS)):
                at, h = seed_hashes(self.numbers[i, : len(words)], mask)
                hashes.append(h)
                places.append(at.astype(np.int32))
                items.append(np.full(len(at), i, np.int32))
        empty = [np.empty(0, np.int32)]
        self.hashes = np.concatenate(hashes or [np.empty(0, np.uint64)])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.items, self.places = (np.concatenate(x or empty)[order] for x in (items, places))
        self.bits = max(16, int(self.hashes.size).bit_length() + 4)
        self.known = np.zeros(1 << self.bits, bool)
        self.known[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    @classmethod
    def restored(cls, state: dict) -> Passages:
        """The passages whose ``vars`` were broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def join(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index into h, index into the passages' seeds) of equal hashes."""
        maybe = np.flatnonzero(self.known[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, h[maybe])
        times = np.searchsorted(self.hashes, h[maybe], "right") - lo
        left = np.repeat(maybe, times)
        first = np.repeat(lo - np.concatenate(([0], np.cumsum(times)[:-1])), times) if len(times) else lo
        return left, first + np.arange(len(left))


def _edits(word: str, other: str) -> int:
    """The edit distance of two words, by the bits of one whole number per letter of ``other``."""
    n = len(word)
    last, every = 1 << (n - 1), (1 << n) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(word):
        places[c] = places.get(c, 0) | 1 << i
    rising, falling, edits = every, 0, n
    for c in other:
        same = places.get(c, 0)
        across = same | falling
        down = (((same & rising) + rising) ^ rising) | same
        up, down_up = falling | (every & ~(down | rising)), rising & down
        edits += bool(up & last) - bool(down_up & last)
        up = (up << 1 | 1) & every
        rising = (down_up << 1 & every) | (every & ~(across | up))
        falling = up & across
    return edits


def _near(word: str, other: str) -> bool:
    """Whether one word may be a misreading of the other: few edits for its length.

    Another number is another statement, unless one digit of three or more is lost. A
    letter against the two it is misread as (``CONFUSED``) is no edit.
    """
    if word == other:
        return True
    if not word or not other:
        return False
    if word.isdigit() and other.isdigit():
        short, long = sorted((word, other), key=len)
        return len(long) == len(short) + 1 >= 3 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
    most = max(1, max(len(word), len(other)) // 3)
    least = [len(w) - sum(w.count(two) for two in CONFUSED.values()) for w in (word, other)]
    if least[0] - len(other) > most or least[1] - len(word) > most:
        return False
    letters, others = set(word), set(other)  # a letter that only one has is an edit, but for the confused ones
    if len(letters - others - UNSURE) > most or len(others - letters - UNSURE) > most:
        return False
    plain = _edits(word, other)
    pairs = sum(min(x.count(one), y.count(two)) for one, two in CONFUSED.items() for x, y in ((word, other), (other, word)))
    if plain <= most or plain - 2 * pairs > most:  # each pair of confused letters saves two edits at most
        return plain <= most
    rows = [list(range(len(other) + 1))]
    for i, a in enumerate(word, 1):
        row = [i]
        for j, b in enumerate(other, 1):
            edits = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (a != b))
            if CONFUSED.get(b) == word[i - 2 : i]:
                edits = min(edits, rows[i - 2][j - 1])
            if CONFUSED.get(a) == other[j - 2 : j]:
                edits = min(edits, rows[i - 1][j - 2])
            row.append(edits)
        if min(row) > most and min(rows[-1]) > most:
            return False
        rows.append(row)
    return rows[-1][-1] <= most


def longest_reprint(states: np.ndarray) -> int:
    """Most consecutive words that make a reprint: 0 exact, 1 misread, 2 missing.

    A reprint has at least ``WORDS`` words, begins and ends with one that was found; at
    most one word in ``MISREAD_EVERY`` is misread or missing, and at most one in
    ``MISSING_EVERY`` missing, since other names and numbers in a like sentence are not
    misread letters.
    """
    n = len(states)
    bad = np.concatenate(([0], np.cumsum(states > 0)))
    gone = np.concatenate(([0], np.cumsum(states == 2)))
    found = np.flatnonzero(states < 2)
    a, b = found[:, None], found[None, :] + 1
    length = b - a
    fits = (
        (length >= WORDS)
        & ((bad[b] - bad[a]) * MISREAD_EVERY <= length)
        & ((gone[b] - gone[a]) * MISSING_EVERY <= length)
    )
    return int((length * fits).max(initial=0)) if n else 0


def _broken(
    page: list[str], cache: _Words, offsets: list[int], asked: np.ndarray
) -> Iterator[tuple[int, str, bool]]:
    """(passage word's number, what it may be, if of two halves) where line ends put other words together.

    A half may be a whole word; else the first one is continued by what a later diagonal
    has for the same word.
    """

    def halves(p: int) -> list[tuple[str, str]]:
        if not 0 <= p < len(page) or JOINT not in page[p][1:]:
            return []
        parts = [cache.plain(x) for x in page[p].split(JOINT)]
        return [("".join(parts[:i]), "".join(parts[i:])) for i in range(1, len(parts))]

    for offset, row in zip(offsets, asked):
        for k in np.flatnonzero(row).tolist():
            for head, tail in halves(offset + k):
                yield k, head, False
                yield k, tail, False
                for later in np.flatnonzero(asked[:, k]).tolist() if head else ():
                    q = offsets[later] + k
                    if offsets[later] > offset and 0 <= q < len(page):
                        for rest in (cache.plain(page[q]), *(x for x, _ in halves(q)), *(x for _, x in halves(q))):
                            yield k, head + rest, True


def _states(
    passage: list[str], page: list[str], cache: _Words, offsets: list[int], exact: np.ndarray, held: np.ndarray
) -> np.ndarray:
    """Per passage word, whether some diagonal has it exactly (0), misread (1) or not at all (2).

    A word that was cut in two, or run together with its neighbour, is not misread; nor
    is one broken at a line's end whose other half stands behind an advert.
    """
    n = len(passage)
    states = np.where(exact.any(axis=0)[:n], 0, 2)
    broken = list(_broken(page, cache, offsets, held[:, :n] & (states == 2)))
    for k, word, _ in broken:
        if word == passage[k]:
            states[k] = 0
    for offset, trusted in zip(offsets, held):
        for k in np.flatnonzero(trusted[:n] & (states == 2)).tolist():
            p = offset + k
            if not 0 <= p < len(page):
                continue
            before, own, after = (cache.plain(page[q]) if 0 <= q < len(page) else "" for q in (p - 1, p, p + 1))
            word = passage[k]
            if own + after == word or before + own == word:
                states[k] = 0
            elif k + 1 < n and own == word + passage[k + 1]:
                states[k : k + 2] = 0
            elif k and own == passage[k - 1] + word:
                states[k - 1 : k + 1] = 0
            elif cache.near(own, word):
                states[k] = 1
    for k, word, both in broken:
        if both and states[k] == 2 and cache.near(word, passage[k]):
            states[k] = 1
    return states


def _followers(fresh: np.ndarray, at: np.ndarray, found: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Per diagonal, the first passage word it may add to the diagonals ``near`` each other: 0 for those.

    Another diagonal follows where one of them ends, in the passage's order and the
    page's, if no word is missing there and at most ``INSERTED`` words or only whole lines
    stand between. The number of words is that of the passage where a diagonal does not follow.
    """
    n = found.shape[1]
    since = np.where(near, 0, n)
    if near.all():
        return since
    place = at[:, None] + np.arange(n)
    line = (place >= 0) & (place < len(fresh)) & fresh[np.clip(place, 0, len(fresh) - 1)]
    for k in range(1, n):
        last = found[:, k - 1] & (since < k)
        if not last.any():
            continue
        new = (at > at[last].min()) & (at <= at[last].max() + INSERTED)
        if (last := last & line[:, k]).any():
            new |= (at > at[last].min()) & line[:, k]
        for y in at[new & found[:, k] & (since == n)].tolist():
            since[(since == n) & (at >= y - SHIFTED) & (at <= y + INSERTED)] = k
    return since


def _verified(
    passage: list[str],
    page: list[str],
    fresh: np.ndarray,
    cache: _Words,
    offsets: list[int],
    exact: np.ndarray,
    held: np.ndarray,
) -> int:
    """The longest reprint of a passage on a page, over the given diagonals.

    ``exact`` says which passage words agree with the page on each diagonal, ``held``
    where the diagonal is to be trusted; other words there are compared letter by letter.
    ``fresh`` says which of the page's words begin a line. Diagonals work together if no
    more than ``INSERTED`` words lie between them, or if they follow one another.
    """
    at, n = np.array(offsets), len(passage)
    exact, held = exact[:, :n], held[:, :n]
    found = exact.copy()
    for d, k in np.argwhere(held & ~exact).tolist() if at.max() - at.min() > INSERTED else ():
        if 0 <= at[d] + k < len(page) and (own := cache.plain(page[at[d] + k])):
            found[d, k] = passage[k].endswith(own) or cache.near(own, passage[k])
    best, seen = 0, None
    for offset in sorted(set(offsets)):
        since = _followers(fresh, at, found, (at >= offset - SHIFTED) & (at <= offset + INSERTED))
        if seen is not None and (since >= seen).all():
            continue
        seen = since
        near = np.flatnonzero(since < n)
        allowed = np.arange(n) >= since[near, None]
        states = _states(passage, page, cache, at[near].tolist(), exact[near] & allowed, held[near] & allowed)
        best = max(best, longest_reprint(states))
        if best == n:
            break
    return best


def _short_parts(
    passage: list[str], page: list[str], fresh: np.ndarray, cache: _Words, offsets: list[int], exact: np.ndarray
) -> list[tuple[int, list[int], list[int]]]:
    """(diagonal, its passage words, those that are exact) of parts too short for a seed.

    Where a stretch ends with a line, the passage's next words are looked for at the
    beginnings of the next lines, up to ``INSERTED`` words on; where it begins with a
    line, those before at the ends of the lines before. Words are exact or, from four
    letters on, misread; the exact ones have at least ``LETTERS`` letters together.
    """
    n, lines = len(passage), np.flatnonzero(fresh).tolist()

    def agrees(p: int, k: int, head: str = "") -> int:  # 2 exact, 1 misread
        if not (0 <= p < len(page) and 0 <= k < n):
            return 0
        own, word = head + cache.plain(page[p].split(JOINT)[-1] if head else page[p]), passage[k]
        return 2 if own == word else int(len(word) >= 4 and cache.near(own, word))

    def head(p: int) -> str:
        return cache.plain(page[p].rpartition(JOINT)[0])

    def part(p: int, k: int, step: int, joined: int) -> tuple[list[int], list[int]]:
        run, same = ([k], [k] * (joined == 2)) if joined else ([], [])
        i = step if joined or step < 0 else 0
        while how := agrees(p + i, k + i):
            run.append(k + i)
            same += [k + i] * (how == 2)
            i += step
        return run, same

    queue = [(o, row[:n].tolist()) for o, row in zip(offsets, exact)]
    done, found = set(), []
    while queue:
        offset, row = queue.pop()
        for p in lines[bisect_left(lines, offset + 1) : bisect_left(lines, offset + n)]:
            k = p - offset
            tries = []
            if any(row[max(0, k - 3) : k]) and not all(row[k : k + 2]) and agrees(p - 1, k - 1):
                behind = lines[bisect_left(lines, p + 1) : bisect_right(lines, p + INSERTED)]
                first = head(p)
                tries += [(q, 1, agrees(q, k, first) if first else 0) for q in behind]
            if any(row[k : k + 3]) and not all(row[max(0, k - 2) : k]):
                before = lines[bisect_left(lines, p - INSERTED) : bisect_left(lines, p)]
                whole = agrees(p, k)
                for q in before:
                    joined = agrees(p, k, first) if (first := head(q)) else 0
                    if joined or whole:
                        tries.append((q, -1, joined))
            for q, step, joined in tries:
                if (q - k, k, step) in done:
                    continue
                done.add((q - k, k, step))
                run, same = part(q, k, step, joined)
                if sum(len(passage[j]) for j in same) >= LETTERS:
                    found.append((q - k, run, [j for j in same if j != k or not joined]))
                    new = [False] * n
                    for j in run:
                        new[j] = True
                    queue.append((q - k, new))
    return found


def _sliding(flags: np.ndarray, width: int) -> np.ndarray:
    """Sums over windows of ``width`` columns."""
    sums = np.cumsum(np.pad(flags.astype(np.int16), ((0, 0), (1, 0))), axis=1, dtype=np.int16)
    return sums[:, width:] - sums[:, :-width]


def search_block(pages: list[list[str]], passages: Passages, cache: _Words) -> list[tuple[int, int, int]]:
    """(page, item, words) of all reprints in a block of pages, given as words as written."""
    if passages.width < WORDS:
        return []
    arrays, kept = [], []
    for words in pages:
        numbers = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
        full = numbers >= 0
        kept.append(np.flatnonzero(full))
        arrays += [numbers[full], np.zeros(_GAP, np.int64)]
    numbers = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    begins = np.cumsum([0] + [len(k) + _GAP for k in kept])
    found = []
    for mask in range(len(MASKS)):
        at, h = seed_hashes(numbers, mask)
        left, right = passages.join(h)
        page = np.searchsorted(begins, at[left], "right") - 1
        offset = at[left] - passages.places[right]
        found.append(np.stack([page, passages.items[right], offset], axis=1))
    hits, times = np.unique(np.concatenate(found), axis=0, return_counts=True)
    if not len(hits):
        return []
    # a (page, item) of too few hits altogether cannot hold enough exact words
    reprints = []
    change = np.flatnonzero((np.diff(hits[:, :2], axis=0) != 0).any(axis=1)) + 1
    starts = np.concatenate(([0], change))
    total = np.add.reduceat(times, starts)
    counts = np.diff(np.append(starts, len(hits)))
    hits = hits[np.repeat(total >= HITS, counts)]
    padded = np.concatenate((np.zeros(passages.width, np.int64), numbers, np.zeros(passages.width, np.int64)))
    at, opened = 0, -1
    while at < len(hits):  # blocks of whole (page, item) pairs
        end = min(at + 20_000, len(hits))
        while end < len(hits) and (hits[end, :2] == hits[end - 1, :2]).all():
            end += 1
        block = hits[at:end]
        at = end
        window = block[:, 2, None] + np.arange(passages.width) + passages.width
        exact = padded[np.clip(window, 0, len(padded) - 1)] == passages.numbers[block[:, 1]]
        inside = (window - passages.width >= begins[block[:, 0], None]) & (
            window - passages.width < begins[block[:, 0] + 1, None] - _GAP
        )
        exact &= inside
        # words count where three of four neighbours agree
        held = np.zeros_like(exact)
        good = _sliding(exact, 4) >= 3
        for i in range(4):
            held[:, i : i + good.shape[1]] |= good
        wide = held.copy()
        for shift in (1, 2):  # a misread word at either end of what agrees
            wide[:, shift:] |= held[:, :-shift]
            wide[:, :-shift] |= held[:, shift:]
        exact &= wide
        change = np.flatnonzero((np.diff(block[:, :2], axis=0) != 0).any(axis=1)) + 1
        starts = np.concatenate(([0], change))
        covered = np.logical_or.reduceat(exact, starts, axis=0)
        most = _sliding(covered, WORDS).max(axis=1)
        enough = np.flatnonzero(most >= STRETCH)
        ends = np.append(starts[1:], len(block))
        for i in enough:
            rows = block[starts[i] : ends[i]]
            page, item = int(rows[0, 0]), int(rows[0, 1])
            near = slice(starts[i], ends[i])
            offsets = (rows[:, 2] - begins[page]).tolist()
            if page != opened:
                opened, words = page, [pages[page][k] for k in kept[page]]
                lines = np.cumsum([JOINT in w for w in pages[page]])[kept[page]]
                fresh = np.diff(lines, prepend=0) > 0
            asked, length = (passages.words[item], words, fresh, cache), 0
            if most[i] >= EXACT:
                length = _verified(*asked, offsets, exact[near], wide[near])
            if not length and (short := _short_parts(*asked, offsets, exact[near])):
                same, trusted = (np.zeros((len(short), exact.shape[1]), bool) for _ in range(2))
                for j, (_, run, agreed) in enumerate(short):
                    trusted[j, run] = same[j, agreed] = True
                more = offsets + [o for o, *_ in short]
                length = _verified(*asked, more, np.vstack((exact[near], same)), np.vstack((wide[near], trusted)))
            if length:
                reprints.append((page, item, length))
    return reprints


def read_pages(batch: pa.RecordBatch, gap: int, bar: str | None) -> list[list[str]]:
    """The words, as written and in reading order, of the pages of a (key, text, boxes) batch."""
    boxes = batch.column(2)
    bounds = boxes.offsets.to_numpy()
    valid = boxes.is_valid().to_pylist()
    x0, y0, x1 = (boxes.values.field(n).fill_null(0).to_numpy(zero_copy_only=False).tolist() for n in ("x0", "y0", "x1"))
    pages = []
    for i, text in enumerate(batch.column(1).to_pylist()):
        lines = (text or "").split("\n")
        a, b = int(bounds[i]), int(bounds[i + 1])
        if valid[i] and b - a == len(lines):
            lines = reading_order(lines, x0[a:b], y0[a:b], x1[a:b], gap, bar)
        pages.append(page_words(lines))
    return pages


def _found(pages: list[list[str]], passages: Passages, cache: _Words) -> Iterator[tuple[int, int, int]]:
    """(page, a piece of the passage, words) of all reprints, once for each page and passage."""
    at = 0
    while at < len(pages):  # about a million words at a time
        end, size = at, 0
        while end < len(pages) and (end == at or size + len(pages[end]) <= 1 << 19):
            size += len(pages[end])
            end += 1
        best: dict[tuple[int, int], int] = {}
        for page, piece, length in search_block(pages[at:end], passages, cache):
            pair = at + page, passages.first[piece]
            best[pair] = max(best.get(pair, 0), length)
        yield from ((page, piece, length) for (page, piece), length in best.items())
        at = end


def _searcher(shared, item_type: pa.DataType, gap: int, bar: str | None):
    """(key, text, boxes) rows -> reprints of the broadcast passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages.restored(shared.value)
        cache = _Words(passages.vocabulary, passages.table)
        for batch in batches:
            if found := list(_found(read_pages(batch, gap, bar), passages, cache)):
                page, piece, length = zip(*found)
                columns = [batch.column(0).take(pa.array(page)), pa.array([passages.keys[i] for i in piece], item_type)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(length, pa.int32())], ["key", "item", "n_words"])

    return run


class _Hashes(_Words):
    """Word as written -> a hash of its plain form, -1 if that is empty."""

    def __init__(self, table: dict[int, str]):
        super().__init__({}, table)

    def __missing__(self, word: str) -> int:
        plain = self.plain(word)
        number = 1 + (int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest()) >> 2) if plain else -1
        if len(self) >= 1 << 20:
            self.clear()
        self[word] = number
        return number


def text_seeds(words: list[str], hashes: _Hashes) -> np.ndarray:
    """The distinct seed hashes of a text."""
    numbers = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
    numbers = numbers[numbers >= 0]
    return np.unique(np.concatenate([seed_hashes(numbers, mask)[1] for mask in range(len(MASKS))]))


def _seeds(table, known, gap: int, bar: str | None, broken: bool):
    """(id, text, boxes) rows -> (h, id): the seeds of every page, or passage, that the filter ``known`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(table.value)
        bits = np.frombuffer(known.value, np.uint64) if known is not None else None
        for batch in batches:
            texts = read_pages(batch, gap, bar) if broken else [(t or "").split() for t in batch.column(1).to_pylist()]
            seeds = []
            for words in texts:
                h = text_seeds(words, hashes)
                if bits is not None:
                    bucket = h >> np.uint64(64 - FILTER_BITS.bit_length() + 1)
                    h = h[(bits[(bucket >> np.uint64(6)).astype(np.int64)] >> (bucket & np.uint64(63))) & np.uint64(1) == 1]
                seeds.append(h)
            rows = np.repeat(np.arange(len(texts)), [len(h) for h in seeds])
            flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(pa.array(rows))], ["h", "id"])

    return run


def _verifier(table, item_type: pa.DataType, gap: int, bar: str | None):
    """(key, text, boxes, item, passage) rows, candidates -> those that are reprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i, (words, passage) in enumerate(zip(read_pages(batch, gap, bar), batch.column(4).to_pylist())):
                passages = Passages([None], [passage], table.value)
                out += [(i, length) for _, _, length in _found([words], passages, _Words(passages.vocabulary, passages.table))]
            row, length = zip(*out) if out else ((), ())
            taken = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 3)]
            yield pa.RecordBatch.from_arrays([taken[0], taken[1].cast(item_type), pa.array(length, pa.int32())], ["key", "item", "n_words"])

    return run


def _joined(rows: DataFrame, asked: DataFrame, schema: str, item_type: pa.DataType, gap: int, bar: str | None) -> DataFrame:
    """Reprints of any number of passages: the seeds of both sides meet in a shuffle, two passes over the pages.

    A fixed-size filter of the passages' seeds (``FILTER_BITS``, however many there are)
    keeps most seeds of the pages out of the shuffle. Pairs with ``HITS`` common seeds are
    fetched and verified.
    """
    context = rows.sparkSession.sparkContext
    table = context.broadcast(look_alikes())
    asked = durable(asked.withColumn("id", F.monotonically_increasing_id()))
    none = rows.select("boxes").schema["boxes"].dataType
    texts = asked.select("id", F.col("passage").alias("text"), F.lit(None).cast(none).alias("boxes"))
    wanted = durable(texts.mapInArrow(_seeds(table, None, gap, bar, False), "h long, id long"))
    shift = 64 - FILTER_BITS.bit_length() + 1
    bucket = F.shiftrightunsigned("h", shift)
    word = F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 as int))"))
    filled = wanted.groupBy(F.shiftright(bucket, 6).alias("at")).agg(word.alias("bits")).collect()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(max(1, FILTER_BITS // 64), np.int64)
    bits[[r["at"] for r in filled]] = [r["bits"] for r in filled]
    known = context.broadcast(bits.tobytes())
    # a page is its key and two hashes of its text
    named = rows.select(F.struct("key", *[F.xxhash64(F.lit(i), F.col("text")).alias(f"x{i}") for i in (0, 1)]).alias("id"), "text", "boxes")
    kind = named.schema["id"].dataType.simpleString()
    pages = named.mapInArrow(_seeds(table, known, gap, bar, True), f"h long, id {kind}")
    hits = pages.join(wanted.withColumnRenamed("id", "passage_id"), "h").groupBy("id", "passage_id").agg(F.count(F.lit(1)).alias("n"))
    hits = durable(hits.where(F.col("n") >= HITS).select("id", F.col("passage_id")))
    pairs = named.join(hits, "id").join(asked.withColumnRenamed("id", "passage_id"), "passage_id")
    pairs = pairs.select(F.col("id.key").alias("key"), "text", "boxes", "item", "passage")
    return pairs.mapInArrow(_verifier(table, item_type, gap, bar), schema)


def leaked_items(
    pages: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    boxes: str = "boxes",
    item: str = "item_id",
    passage: str = "passage",
    column_gap: int = 150,
    bar: str | None = " | ",
) -> DataFrame:
    """(key, item, n_words): every page that reprints at least ``WORDS`` consecutive words of a passage.

    A page is read column by column, from the boxes of its lines (without boxes, or with
    another number of them than lines, in the order of the text): left edges more than
    ``column_gap`` apart begin another column, a ``bar`` parts columns read as one line
    (None: no such lines). Words broken at line ends are put together and brought to one
    form. ``n_words`` is the longest stretch in which at most one word in six is misread or missing; what stands between two parts of
    it, such as an advert, does not count: any number of whole lines, or ``INSERTED`` words
    where a part ends or begins within a line. Of a passage of more than ``PIECE`` words it
    is the longest stretch within one of its pieces. Null and empty texts and passages, and
    passages of fewer words, match nothing; repeated rows each give their own; an empty
    table gives no rows; other columns are not read.

    Every window of the words gives one hash per mask of ``MASKS``; hashes of pages and
    passages are joined, the diagonals around the hits are compared word by word, and
    pages with enough exact words are verified with misreadings allowed. Any twelve words
    with two damaged ones contain several seeds. Passages of ``BLOCK_CHARS`` characters or
    less altogether are broadcast, and pages are neither shuffled nor read twice; more are
    joined to the pages by the hashes of their seeds.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(boxes).alias("boxes"))
    rows = rows.where(F.length("text") > 0)
    asked = items.select(F.col(item).alias("item"), F.col(passage).alias("passage")).where(F.length("passage") > 0)
    item_type, key_type = asked.schema["item"].dataType, pages.schema[key].dataType
    schema = f"key {key_type.simpleString()}, item {item_type.simpleString()}, n_words int"
    if (asked.agg(F.sum(F.length("passage"))).first()[0] or 0) > BLOCK_CHARS:
        return _joined(rows, asked, schema, to_arrow_type(item_type), column_gap, bar)
    listed = asked.collect()
    passages = Passages([r["item"] for r in listed], [r["passage"] for r in listed], look_alikes())
    shared = pages.sparkSession.sparkContext.broadcast(vars(passages))
    return rows.mapInArrow(_searcher(shared, to_arrow_type(item_type), column_gap, bar), schema)
