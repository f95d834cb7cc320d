"""Predicates on identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def filled(column: Column) -> Column:
    """True where the string is neither null nor made of white space alone."""
    # most strings begin with a printable ASCII character; only others are looked through
    printable = (column >= "!") & (column < "\x7f")
    return column.isNotNull() & (printable | (F.btrim(column, F.lit(WHITE_SPACE)) != ""))
