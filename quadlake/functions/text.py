"""Column functions on names, paths and text fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approx_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def canonical(name: Column) -> Column:
    """Lower case without white space at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^\s+", ""), r"\s+$", ""))


def simple_name(qual: Column) -> Column:
    """The part after ``::`` and after its last dot."""
    return F.element_at(F.split(F.element_at(F.split(qual, "::", 2), -1), r"\."), -1)


def short_name(qual: Column) -> Column:
    """What follows the first ``::``, or all of it."""
    at = F.instr(qual, "::")
    return F.when(at > 0, F.substring(qual, at + 2, F.length(qual))).otherwise(qual)


def stem(name: Column) -> Column:
    """A file name up to its last dot, unless that is its first character."""
    cut = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(cut != "", cut).otherwise(name)


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def parent_dir(path: Column) -> Column:
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def package_path(path: Column) -> Column:
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def tokens(name: Column) -> Column:
    """Distinct parts of a name at dots and underscores, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(name), "[._]+"), lambda x: x != ""))


def split_identifier(name: Column) -> Column:
    """Parts of a name at dots, underscores and where a capital follows something else, in lower case and in order."""
    marked = F.regexp_replace(name, r"(?<=[^\p{Lu}._])(?=\p{Lu})", "_")
    return F.transform(F.filter(F.split(marked, "[._]"), lambda x: x != ""), F.lower)


def valid_entity(text: Column) -> Column:
    """Not blank, under 200 code points and under 15 words."""
    body = F.trim(text)
    return (body != "") & (F.length(body) < 200) & (F.size(F.split(body, r"\s+")) < 15)
