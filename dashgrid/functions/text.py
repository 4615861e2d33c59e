"""Text, label and number functions over recognised lines; all are built-in expressions on columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits read as letters, and letters read as digits.
DIGIT_TO_LETTER = ("012568", "OIZSGB")
LETTER_TO_DIGIT = ("OQDILZSGB", "000112568")

#: White space as trimmed from both ends: Unicode's, with the information separators.
BLANK = r"[\t-\r\x1c-\x20\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EDGES = f"^{BLANK}+|{BLANK}+$"

#: The forms of numbers and of lines that hold nothing but a value.
PERCENT = r"([0-9]{1,3})\s*%"
UP_TO_THREE = r"\b([0-9]{1,3})\b"
UP_TO_SIX = r"\b([0-9]{1,6})(?:\.[0-9]+)?\b"
BARE_PERCENT = r"^[0-9]{1,3}\s*%$"
BARE_ODO = r"^[0-9O][0-9O.,]{0,7}\s*[KLI][A-Z]{0,2}$"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def normalise_line(c: Column) -> Column:
    """Upper case, without surrounding white space."""
    return trim(F.upper(c))


def normalise_name(c: Column) -> Column:
    """File name behind the last slash, lower case, trimmed."""
    return trim(F.lower(F.substring_index(c, "/", -1)))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[^A-Z0-9]+"), lambda x: x != "")


def fold_digits(c: Column) -> Column:
    """Digits that look like letters become those letters."""
    return F.translate(c, *DIGIT_TO_LETTER)


def repair_digits(c: Column) -> Column:
    """Letters that look like digits become digits, in words that hold a digit already."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.rlike("[0-9]"), F.translate(w, *LETTER_TO_DIGIT)).otherwise(w)), " ")


def token_matches(token: Column, label: str) -> Column:
    """Whether a token is the label up to a few misread letters: one in short labels, two in longer ones."""
    most = 1 if len(label) <= 6 else 2
    near = F.levenshtein(fold_digits(token), F.lit(label)) <= most
    near = near & (F.abs(F.length(token) - len(label)) <= most)
    return near & (F.length(token) >= len(label)) if len(label) <= 4 else near


def line_matches(c: Column, labels: Sequence[str], words: Column | None = None) -> Column:
    """Whether a line holds one of the labels, or a token (of ``words``, if they are known) that is one up to misread letters."""
    any_of = lambda test: reduce(Column.__or__, map(test, labels))
    return any_of(c.contains) | F.exists(tokens(c) if words is None else words, lambda t: any_of(lambda label: token_matches(t, label)))


def strict_int(c: Column) -> Column:
    """An integer with an optional sign and nothing else, null if it isn't one or is out of range."""
    t = trim(c)
    return F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def battery_value(c: Column, repaired: bool = False) -> Column:
    """The first number before a percent sign, else the first number of up to three digits; only 0 to 100."""
    t = c if repaired else repair_digits(c)
    v = F.coalesce(_first(t, PERCENT), _first(t, UP_TO_THREE)).cast("int")
    return F.when(v.between(0, 100), v)


def range_value(c: Column, repaired: bool = False) -> Column:
    t = F.replace(c if repaired else repair_digits(c), F.lit("KM"), F.lit(" "))
    return _first(t, UP_TO_THREE).cast("int")


def odo_value(c: Column, repaired: bool = False) -> Column:
    """The first number of up to six digits, integer part; groups of digits are joined."""
    t = trim(F.replace(F.replace(c if repaired else repair_digits(c), F.lit(","), F.lit("")), F.lit("KM"), F.lit(" ")))
    t = F.when(t.rlike(r"^[0-9 .]+$"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    return _first(t, UP_TO_SIX).cast("int")


def is_bare_percent(c: Column) -> Column:
    return c.rlike(BARE_PERCENT)


def is_bare_odo(c: Column) -> Column:
    return c.rlike(BARE_ODO)


def normalise_separators(c: Column) -> Column:
    """Dots before a last group of three digits are thousands and go; else only the last dot stays."""
    last = F.substring_index(c, ".", -1)
    bare = F.replace(c, F.lit("."), F.lit(""))
    kept = F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(last)), F.lit("."), last)
    return F.when(~c.contains("."), c).when(F.length(last) == 3, bare).otherwise(kept)


def csv_escape(c: Column) -> Column:
    return F.when(c.rlike("[,\"\n\r]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_split(c: Column) -> Column:
    """Cells of a CSV line: a quote toggles quoting anywhere, a doubled quote inside quotes is one, commas split outside.

    One pass over the characters: a quote that closes is held back, for the next may make it a quote of the text.
    """
    comma = "\u0001"
    state = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"), F.lit(False).alias("held")),
        lambda s, x: F.when(
            x == '"',
            F.when(s["held"], F.struct(F.concat(s["out"], F.lit('"')).alias("out"), F.lit(True).alias("inside"), F.lit(False).alias("held")))
            .when(s["inside"], F.struct(s["out"].alias("out"), F.lit(False).alias("inside"), F.lit(True).alias("held")))
            .otherwise(F.struct(s["out"].alias("out"), F.lit(True).alias("inside"), F.lit(False).alias("held"))),
        ).otherwise(F.struct(
            F.concat(s["out"], F.when((x == ",") & ~s["inside"], F.lit(comma)).otherwise(x)).alias("out"), s["inside"].alias("inside"), F.lit(False).alias("held"))),
    )
    return F.split(state["out"], comma)


def ratio_text(hits: Column, total: Column) -> Column:
    """``h/t (p%)``, halves rounded up; a dash for nothing."""
    return F.when(total == 0, "—").otherwise(F.concat(hits.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("),
                                                      F.floor(hits * 100.0 / total + 0.5).cast("string"), F.lit("%)")))
