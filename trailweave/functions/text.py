"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalised(name: Column) -> Column:
    """A name in lower case, other signs as one space, ends stripped, double spaces collapsed once."""
    return F.replace(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " ")), F.lit("  "), F.lit(" "))


def slug(name: Column) -> Column:
    """Lower case with white space as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\s+", "_")


def without_articles(text: Column) -> Column:
    """Tokens but the articles, joined by spaces."""
    return F.array_join(F.filter(tokens(text), lambda t: ~t.isin("the", "a", "an")), " ")


def alias_keys(title: Column) -> Column:
    """The normalised title, and that without a qualifier in parentheses at its end."""
    bare = F.regexp_replace(title, r"\s*\([^)]*\)\s*$", "")
    return F.array_distinct(F.filter(F.array(normalised(title), normalised(bare)), lambda k: k != ""))
