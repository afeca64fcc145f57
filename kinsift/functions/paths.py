"""Module paths: directories, folding of specifiers, distance. `/` separates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def directories(path: Column) -> Column:
    """Named directories above a file; the root, `.` and `..` are left out."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(above, lambda x: x != "..")


def is_relative(specifier: Column) -> Column:
    return specifier.startswith("./") | specifier.startswith("../") | (specifier == "..")


def climb(segments: Column) -> Column:
    """One directory up; a leading `..` stays where there is nothing to leave."""
    last = F.try_element_at(segments, F.lit(-1))
    return F.when((F.size(segments) > 0) & (last != ".."), F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))).otherwise(F.concat(segments, F.array(F.lit(".."))))


def folded(start: Column, specifier: Column) -> Column:
    step = lambda at, part: F.when(part.isin("", "."), at).when(part == "..", climb(at)).otherwise(F.concat(at, F.array(part)))
    return F.array_join(F.aggregate(F.split(specifier, "/"), start, step), "/")


def module_path(specifier: Column, importer: Column) -> Column:
    """Where a specifier points from its importer; one that isn't relative, as written. Files are never looked at."""
    return F.when(is_relative(specifier), folded(directories(importer), specifier)).otherwise(specifier)


def common_prefix(a: Column, b: Column) -> Column:
    """How many first items two arrays share."""
    upto = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))


def steps(a: Column, b: Column) -> Column:
    """Directories up from one and down to the other."""
    return F.size(a) + F.size(b) - 2 * common_prefix(a, b)


def url_directories(url: Column) -> Column:
    """A page's host, then the directories of its path; query and fragment are left out."""
    parts = F.split(F.regexp_extract(url, r"^[^:]*://([^?#]*)", 1), "/")
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(parts, 1, 1), F.filter(inner, lambda x: x != ""))
