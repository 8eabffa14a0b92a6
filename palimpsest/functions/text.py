"""String functions on columns: trimming, tokens, structural terms, lengths and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that structured search ignores.
STOP_WORDS = """a an and are be been being did do does find for get how implementation implemented in is located of on or that the
this to was were what where which with work works""".split()

#: Words are maximal runs of letters, digits and underscores of the lower-cased text.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}_]+"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SEPARATOR), lambda t: t != "")


def normalise_structural(c: Column) -> Column:
    """Camel case and acronyms cut apart, everything but letters and digits a blank, trimmed, lower case."""
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def structural_terms(c: Column) -> Column:
    """Distinct query terms without stop words, then their stems: -s from four letters, -ed from five unless -zed, -ing from six."""
    first = F.filter(F.split(normalise_structural(c), " "), lambda t: (t != "") & ~t.isin(STOP_WORDS))

    def stems(t: Column) -> Column:
        n = F.length(t)
        return F.array_compact(
            F.array(
                F.when((n > 3) & t.endswith("s"), F.left(t, n - 1)),
                F.when((n > 4) & t.endswith("ed") & ~t.endswith("zed"), F.left(t, n - 2)),
                F.when((n > 5) & t.endswith("ing"), F.left(t, n - 3)),
            )
        )

    return F.array_distinct(F.concat(first, F.flatten(F.transform(first, stems))))


def symbol_terms(c: Column) -> Column:
    """Distinct ASCII terms of two letters and more, camel case cut apart."""
    c = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"))
    return F.array_distinct(F.filter(F.split(c, r"[^a-z0-9]+"), lambda t: F.length(t) > 1))


def path_terms(c: Column) -> Column:
    """The terms of a path or symbol in the structural vector: slashes, dots, underscores and dashes separate."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[/._\-\s]+"), lambda t: t != "")


def normalise_path(c: Column) -> Column:
    """Backslashes to slashes, no leading ./"""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^\./", "")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    """The last ending of a file name with its dot, lower case; empty where there is none or the name begins with it."""
    return F.lower(F.regexp_extract(basename(c), r"^.+?(\.[^.]*)$", 1))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: code points, those beyond the basic plane twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x{0000}-\x{FFFF}]", ""))


def identity(*parts: Column) -> Column:
    """SHA-256 over the parts, each led by its length in UTF-16 units."""
    return F.sha2(F.concat(*[F.concat(utf16_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def truncate_lines(c: Column, room: Column, marker: str = "\n[truncated to context budget]") -> Column:
    """A text cut to `room` code points at a line boundary, with a marker; without room for the marker cut hard."""
    keep = room - F.lit(len(marker))
    head = F.left(c, F.greatest(keep, F.lit(0)))
    cut = F.length(head) - F.locate("\n", F.reverse(head))
    at_line = F.when(F.locate("\n", head) > 0, F.left(head, cut)).otherwise(head)
    return F.when(F.length(c) <= room, c).when(keep <= 0, F.left(c, F.greatest(room, F.lit(0)))).otherwise(F.concat(at_line, F.lit(marker)))


def estimated_tokens(characters: Column) -> Column:
    return F.ceil(characters / 4).cast("int")
