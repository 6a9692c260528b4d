"""Small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abbreviated(name: Column) -> Column:
    """`Escherichia coli K12` -> `E. coli`."""
    words = F.split(name, " ")
    return F.when(F.size(words) > 1, F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.lit(". "), F.get(words, F.lit(1)))).otherwise(name)


def without_version(accession: Column) -> Column:
    return F.substring_index(accession, ".", 1)


def without_last_word(name: Column) -> Column:
    words = F.split(F.trim(name), r"\s+")
    return F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")


def wrapped(text: Column, width: int = 15) -> Column:
    """Greedy line breaks: words fill lines of `width`; longer words are cut with a hyphen."""
    cut = F.regexp_replace(text, rf"(\S{{{width - 1}}})(?=\S{{2}})", "$1- ")
    return F.trim(F.regexp_replace(cut, rf"(\S.{{0,{width - 1}}})(?:\s+|$)", "$1\n"), F.lit("\n"))


def hex_colour(rgba: Column) -> Column:
    """array(r, g, b, ...) of 0 to 1 -> #rrggbb."""
    part = lambda i: F.lpad(F.lower(F.hex(F.round(F.get(rgba, F.lit(i)) * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(1), part(2))
