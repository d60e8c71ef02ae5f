"""Text expressions: normalisation, identifiers, labels, rendering."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# An identifier and the marks it may not touch.
IDENTIFIER = r"[A-Za-z]{1,6}-\d+[A-Za-z]?"
BOUNDARY = "[A-Za-z0-9]"
# What is taken off a name, each in the order in which it is tried.
ARTICLES = ("the ", "a ", "an ")
TYPE_WORDS = ("application ", "control ", "procedure ", "obligation ")
TRAILING = (" business service",)


def squashed(c: Column) -> Column:
    """Line ends unified, runs of blanks made one, lines and the whole trimmed, lower-cased: all built-in."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0B]+", " ")
    c = F.regexp_replace(c, r" ?\n ?", "\n")
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def folded(c: Column) -> Column:
    """NFC and case folding, for which there is no built-in expression."""

    @F.pandas_udf(StringType())
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())

    return fold(c)


def identifiers(c: Column) -> Column:
    """Distinct identifiers of a text, upper-cased, in the order of their first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(rf"\b({IDENTIFIER})\b"), 1), F.upper))


def occurrences(c: Column, identifier: Column) -> Column:
    """How often the identifier stands in the text between characters that cannot belong to it; case counts."""
    quoted = F.concat(F.lit(f"(?<!{BOUNDARY})\\Q"), identifier, F.lit(f"\\E(?!{BOUNDARY})"))
    return F.regexp_count(c, quoted)


def contained_labels(c: Column, labels: list[str]) -> Column:
    """The labels that the text contains, in the order of the list, whatever their case."""
    low = F.lower(c)
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in labels)))


def entity_key(c: Column) -> Column:
    """A name reduced to what tells it apart: blanks squashed, lower case, without articles, one leading type word and the ending."""
    c = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    c = reduce(lambda x, a: F.regexp_replace(x, f"^{a}", ""), ARTICLES, c)
    c = F.regexp_replace(c, f"^({'|'.join(TYPE_WORDS)})(?=.)", "")
    return F.trim(reduce(lambda x, t: F.regexp_replace(x, f"{t}$", ""), TRAILING, c))


def as_percent(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.concat(F.format_number(c * 100, digits), F.lit(" %")))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def html_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
