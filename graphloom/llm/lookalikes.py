"""One form for texts that look the same: look-alike mapping under Unicode collation."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import durable

#: Cyrillic and Greek letters with the shape of the Latin letter below them.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮӀԌԚԜаеѕіјорсухһӏԁԛԝѵ"
AS_LATIN = "ABESIJKMHOPCTYXYIGQWaesijopcyxhldqwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹνορϲϳ"
AS_LATIN_GREEK = "ABEZHIKMNOPTYXCvopcj"
#: Cyrillic letters with the shape of the Greek letter below them, but of no Latin one.
CYRILLIC_ONLY = "ГПФ"
AS_GREEK = "ΓΠΦ"
#: Characters without width.
WIDTHLESS = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
#: Leading consonants start here, syllables there, so many syllables per leading consonant.
JAMO, HANGUL, PER_JAMO = 0x1100, 0xAC00, 588

#: Keys that are broadcast to fetch their texts (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000


def _letters() -> dict[str, str]:
    return dict(zip(CYRILLIC + GREEK + CYRILLIC_ONLY, AS_LATIN + AS_LATIN_GREEK + AS_GREEK, strict=True))


def _code_points() -> Iterator[str]:
    return (chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code < 0xE000)


@functools.cache
def shape_map() -> dict[str, str]:
    """Single characters to the character they look like, the empty string for nothing at all.

    Full-width forms, space characters and the accented forms of look-alike letters
    follow from the Unicode data; accents themselves stay. Forms of several characters
    are in ``spelled_out``.
    """
    letters = _letters()
    out = dict(letters)
    for c in _code_points():
        if c in out:
            continue
        kind = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif kind.startswith(("<wide>", "<narrow>")):
            wide = unicodedata.normalize("NFKC", c)
            if len(wide) == 1:
                out[c] = letters.get(wide, wide)
        elif len(plain := _accented(c, letters)) == 1:
            out[c] = plain
    return out | dict.fromkeys(WIDTHLESS, "")


def _accented(c: str, letters: dict[str, str]) -> str:
    """The composed form of an accented look-alike with its new base, empty for other characters."""
    kind = unicodedata.decomposition(c)
    if not kind or kind.startswith("<"):
        return ""
    base = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", letters[base[0]] + base[1:]) if base[0] in letters else ""


@functools.cache
def ligatures() -> dict[str, str]:
    """Latin ligatures with a compatibility form, to their letters."""
    out = {}
    for code in range(0x80, 0x10000):
        name = unicodedata.name(chr(code), "")
        plain = unicodedata.normalize("NFKC", chr(code))
        if name.startswith("LATIN") and "LIGATURE" in name and len(plain) > 1:
            out[chr(code)] = plain
    return out


@functools.cache
def spelled_out() -> dict[str, str]:
    """Ligatures, and accented look-alikes whose new base has no composed form with the accent."""
    letters = _letters()
    return ligatures() | {c: x for c in _code_points() if len(x := _accented(c, letters)) > 1}


@functools.cache
def bare_map() -> dict[str, str]:
    """``shape_map`` with every accented letter brought down to its base, and what a collation may ignore to nothing.

    A Hangul syllable becomes its leading consonant, as its parts do.
    """
    shapes = shape_map()
    out = dict(shapes)
    for c in _code_points():
        if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") or (unicodedata.category(c) == "Cc" and not c.isspace()):
            out[c] = ""
            continue
        if ord(c) < 0x80:
            continue
        x = shapes.get(c, c)
        base = unicodedata.normalize("NFD", x)[:1] if x else ""
        base = shapes.get(base, base)
        if unicodedata.category(base or " ")[0] == "M" or JAMO + 0x60 <= ord(base or " ") < JAMO + 0x100:
            base = ""
        if base != c:
            out[c] = base
    for code in range(HANGUL, HANGUL + 19 * PER_JAMO):
        out[chr(code)] = chr(JAMO + (code - HANGUL) // PER_JAMO)
    return out | {chr(code): "" for code in range(JAMO + 0x60, JAMO + 0x100)}  # vowels and final consonants


def _translated(text: Column, table: dict[str, str]) -> Column:
    kept = [c for c, x in table.items() if x]
    gone = [c for c, x in table.items() if not x]
    return F.translate(text, "".join(kept + gone), "".join(table[c] for c in kept))


def _split(text: Column, table: dict[str, str]) -> Column:
    """Characters that stand for several, spelled out; a text without any is not rewritten."""
    split = text
    for c, letters in table.items():
        split = F.replace(split, F.lit(c), F.lit(letters))
    return F.when(text.rlike("[" + "".join(table) + "]"), split).otherwise(text)


def same_shape(text: Column) -> Column:
    """The text with look-alikes mapped, under a collation that tells accents and case apart.

    Two values of this column are equal if and only if the texts look the same: composed
    and combining accents, and characters without width, are settled by the collation.
    """
    return F.collate(_translated(_split(text, spelled_out()), shape_map()), "UNICODE")


def coarse_shape(text: Column) -> Column:
    """The mapped text without accents and ignorable characters, in every script: equal for all texts of one shape."""
    plain = text.rlike(r"\A[\t\n\r\x20-\x7e]*+\z")  # nothing to map in it
    return F.when(plain, text).otherwise(_translated(_split(text, ligatures()), bare_map()))


def visible(text: Column) -> Column:
    """True for a text with at least one character that is neither space, control nor format."""
    return F.coalesce(text.rlike(r"[^\p{Z}\p{Cc}\p{Cf}]"), F.lit(False))


def _hashes(value: Column, *names: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), value).alias(n) for i, n in enumerate(names)]


def mixed_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text has the look, but not the characters, of another row's text.

    Columns: ``key``, ``canonical_key`` (smallest key of its class), ``text_id`` (equal
    for equal texts of a class). Texts without a visible character and null texts belong
    to no class; an empty table gives no rows; other columns are not read.

    Texts are not shuffled: rows are grouped by a 128-bit hash of a coarse form, which
    looks alike texts share, reduced on the map side to the extremes of their text
    hashes. Only one text per distinct string of a group with different strings is
    fetched, mapped and grouped under the collation. The smallest key of each class is
    joined back to its rows.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(visible(F.col("text")))
    keyed = docs.select("key", *_hashes(coarse_shape(F.col("text")), "h0", "h1"), *_hashes(F.col("text"), "x0", "x1"))
    keyed = durable(keyed)  # 40 bytes a row, read twice; mapping the texts costs far more
    group, string = ["h0", "h1"], ["h0", "h1", "x0", "x1"]
    both = F.struct("x0", "x1")
    mixed = keyed.groupBy(*group).agg(F.min(both).alias("lo"), F.max(both).alias("hi")).where("lo <> hi")
    rows = durable(keyed.join(mixed.select(*group), group))
    firsts = rows.groupBy(*string).agg(F.min("key").alias("key"))
    if rows.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    # a repeated key may bring several texts; only the one that bears the hash counts
    own = [F.xxhash64(F.lit(i), F.col("text")) == F.col(f"x{i}") for i in (0, 1)]
    shaped = docs.join(firsts, "key").where(own[0] & own[1])
    shaped = shaped.select(*string, "key", same_shape(F.col("text")).alias("shape"))
    classes = shaped.groupBy(*group, "shape").agg(
        F.min("key").alias("canonical_key"), F.collect_set(F.struct("x0", "x1")).alias("strings")
    )
    classes = classes.where(F.size("strings") > 1)
    named = classes.select(*group, "canonical_key", F.inline("strings").alias("x0", "x1"))
    found = rows.join(named, string)
    return found.select("key", "canonical_key", F.struct("x0", "x1").alias("text_id"))


def canonical_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, canonical_key): every row with the smallest key of those that look the same.

    Rows without a visible character stand for themselves. Exact copies need no look:
    they share the hash of their text.
    """
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    seen = docs.where(visible(F.col("text"))).select("key", *_hashes(F.col("text"), "x0", "x1"))
    blank = docs.where(~visible(F.col("text"))).select("key", F.col("key").alias("canonical_key"))
    alike = mixed_classes(df, key, text).select(
        F.col("text_id.x0").alias("x0"), F.col("text_id.x1").alias("x1"), "canonical_key"
    )
    alike = alike.groupBy("x0", "x1").agg(F.min("canonical_key").alias("alike"))
    copies = seen.groupBy("x0", "x1").agg(F.min("key").alias("copy"))
    firsts = copies.join(alike, ["x0", "x1"], "left").select(
        "x0", "x1", F.coalesce("alike", "copy").alias("canonical_key")
    )
    return seen.join(firsts, ["x0", "x1"]).select("key", "canonical_key").unionByName(blank)


def alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b): every two rows whose texts look the same but are different strings."""
    rows = mixed_classes(df, key, text)
    a, b = (rows.select(F.col("canonical_key").alias("class"), F.col("key").alias(f"key_{s}"), "text_id") for s in "ab")
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.class") == F.col("b.class")) & (F.col("key_a") < F.col("key_b"))
    return a.join(b, same & (F.col("a.text_id") != F.col("b.text_id"))).select("key_a", "key_b").distinct()
