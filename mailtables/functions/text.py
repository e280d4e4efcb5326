"""Small column helpers shared by the text jobs."""

from functools import reduce

from pyspark.sql import Column, functions as F

from .patterns import WHITE_SPACE


def trim_ws(col) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def plain_breaks(col) -> Column:
    """Line ends beyond LF (U+0085, U+2028, U+2029), on which regex engines differ, become LF."""
    for old in "\u0085\u2028\u2029":
        col = F.replace(col, F.lit(old), F.lit("\n"))
    return col


def normalise(col) -> Column:
    """Every kind of line end becomes LF, no-break spaces become spaces."""
    for old, new in [("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " ")]:
        col = F.replace(col, F.lit(old), F.lit(new))
    return plain_breaks(col)


def split_lines(col) -> Column:
    return F.split(col, "\n", -1)


def join_lines(col) -> Column:
    return F.array_join(col, "\n")


def any_match(col, patterns) -> Column:
    return reduce(lambda a, b: a | b, [col.rlike(f"(?i){p}") for _, p in patterns])


def text_before(col, regex) -> Column:
    """Text in front of the first match; the whole text when there is none."""
    return F.regexp_replace(col, rf"(?im:{regex})(?s:.*)", "")


def remove_first(col, regex) -> Column:
    return F.regexp_replace(col, rf"(?im:{regex})(?s:(?<rest>.*))", "${rest}")


def empty_to_null(col) -> Column:
    return F.nullif(col, F.lit(""))


def left_chars(col, n) -> Column:
    return F.substring(col, 1, n)
