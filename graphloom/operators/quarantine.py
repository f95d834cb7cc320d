"""Parsing delivered lines: valid rows are loaded, the others set aside with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vertex id, a score and a day as they may be written.
VERTEX = r"^[A-Za-z]{3}[-:_.][0-9]{9}\z"
SCORE = r"^[0-9]+([.][0-9]+)?([eE][-+]?[0-9]+)?\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
FIELDS = ("vertex1", "vertex2", "score", "seen_on")

_QUOTED_TAB = "\x01"


def _raw_fields(line: Column) -> Column:
    """The line's fields, still quoted: split at the tabs outside quotes.

    Every second piece between double quotes is inside a quoted field. Its tabs are set
    aside while the line is split; the stand-in is doubled first, so any text survives.
    """
    escaped = F.replace(line, F.lit(_QUOTED_TAB), F.lit(_QUOTED_TAB * 2))
    pieces = F.split(escaped, '"', -1)
    hidden = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit("\t"), F.lit(f"{_QUOTED_TAB}t"))).otherwise(p)
    )
    joined = F.when(F.contains(line, F.lit('"')), F.array_join(hidden, '"')).otherwise(escaped)
    return F.split(joined, "\t", -1)


def _shown(field: Column) -> Column:
    """A field with its own tabs and stand-ins again."""
    double = F.lit(_QUOTED_TAB * 2)
    parts = F.transform(
        F.split(field, _QUOTED_TAB * 2, -1), lambda p: F.replace(p, F.lit(f"{_QUOTED_TAB}t"), F.lit("\t"))
    )
    return F.when(F.contains(field, F.lit(_QUOTED_TAB)), F.array_join(parts, _QUOTED_TAB)).otherwise(field)


def _inner(field: Column) -> Column:
    """What stands between a quoted field's quotes, doubled quotes still doubled."""
    return F.substring(field, F.lit(2), F.length(field) - 2)


def _is_quoted(field: Column) -> Column:
    return field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)


def _is_broken(field: Column) -> Column:
    """A quote that is never closed, stands in a plain field, or is followed by text."""
    lone = F.contains(F.replace(_inner(field), F.lit('""'), F.lit("")), F.lit('"'))
    return F.contains(field, F.lit('"')) & (~_is_quoted(field) | lone)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that the optimizer computes once per row.

    A generator of one row is a barrier: without it, filters on the result would be
    pushed to the scan with every nested expression repeated inside them.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_edge_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """``df`` with the parsed columns and an array of errors per line.

    Adds ``vertex1``, ``vertex2`` (string), ``score`` (double), ``seen_on`` (date) and
    ``errors`` (array of reasons, in the order ``quoting``, ``columns``, ``value``); any
    columns of these names that ``df`` has already are replaced. A line is valid when the
    array is empty; the parsed columns of other lines are null. A null line counts as one
    without fields (``columns``), an empty one has a single empty field (``columns``).

    Every field is first read as nullable text; the casts are ``try_cast`` and cannot
    raise. All of it is column expressions over one scan, without a shuffle.
    """
    text = F.col("`" + line.replace("`", "``") + "`")
    body = F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    base = _once(df.drop(*FIELDS, "errors"), "__fields", _raw_fields(body))
    fields = F.col("__fields")
    quoting = F.contains(text, F.lit('"')) & F.exists(fields, _is_broken)
    columns = F.coalesce(F.size(fields) != 4, F.lit(True))
    base = _once(base, "__shape", F.struct(quoting.alias("quoting"), columns.alias("columns")))
    sound = ~F.col("__shape.quoting") & ~F.col("__shape.columns")

    def value(i: int) -> Column:
        raw = F.when(sound, F.get(fields, F.lit(i)))
        plain = F.when(_is_quoted(raw), F.replace(_inner(raw), F.lit('""'), F.lit('"'))).otherwise(raw)
        return F.trim(_shown(plain))

    base = _once(base, "__text", F.struct(*[value(i).alias(f"c{i}") for i in range(4)]))
    vertex1, vertex2, written, seen = (F.col(f"__text.c{i}") for i in range(4))
    number = F.when(written.rlike(SCORE), written.try_cast("double"))
    # a double may round to 1 what is written as a little more; the mantissa's digits decide
    digits = F.regexp_replace(F.regexp_replace(written, "[eE].*$", ""), "[.]", "")
    at_most_one = (number < 1) | ((number == 1) & digits.rlike("^0*(10*|9[0-9]*)$"))
    day = F.when(seen.rlike(DAY) & ~seen.startswith("0000"), seen.try_cast("date"))
    fits = vertex1.rlike(VERTEX) & vertex2.rlike(VERTEX) & (number >= 0) & at_most_one & day.isNotNull()
    errors = F.array_compact(
        F.array(
            F.when(F.col("__shape.quoting"), F.lit("quoting")),
            F.when(F.col("__shape.columns"), F.lit("columns")),
            F.when(sound & ~F.coalesce(fits, F.lit(False)), F.lit("value")),
        )
    )
    typed = F.struct(errors.alias("errors"), number.alias("score"), day.alias("seen_on"))
    base = _once(base, "__typed", typed)
    valid = F.size("__typed.errors") == 0
    return base.withColumns(
        {
            "vertex1": F.when(valid, vertex1),
            "vertex2": F.when(valid, vertex2),
            "score": F.when(valid, F.col("__typed.score")),
            "seen_on": F.when(valid, F.col("__typed.seen_on")),
            "errors": F.col("__typed.errors"),
        }
    ).drop("__fields", "__shape", "__text", "__typed")


def loaded_lines(parsed: DataFrame) -> DataFrame:
    """The valid lines of ``parse_edge_lines``, without the error array."""
    return parsed.where(F.size("errors") == 0).drop("errors")


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """The other lines with ``reason``, the first that applies, in place of the parsed columns."""
    return parsed.where(F.size("errors") > 0).withColumn("reason", F.get("errors", F.lit(0))).drop(*FIELDS, "errors")
