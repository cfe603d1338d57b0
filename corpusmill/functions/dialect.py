"""Text conventions of the web pages' tool chain: which characters are blanks, how numbers round, how long a text is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Body of a regex class with every blank, line ends included (Java and RE2 spelling).
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Body of a regex class with the line ends.
EOL = r"\n\r\x{2028}\x{2029}"
#: Every blank as text, for btrim.
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(text(x), F.lit(WS_CHARS))


def collapse(x: Column | str) -> Column:
    """Each run of blanks as one space, none at the ends. Single spaces, nearly all of them, are no match."""
    return F.btrim(F.regexp_replace(text(x), f" [{WS}]+|[{WS.replace(' ', '')}][{WS}]*", " "), F.lit(" "))


def lines(x: Column | str) -> Column:
    return F.split(text(x), "\n")


def join_lines(x: Column) -> Column:
    return F.array_join(x, "\n")


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards also below zero."""
    return F.floor(x + F.lit(0.5))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))



def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once a row, however often a lambda inside uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
