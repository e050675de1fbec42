"""Path parts as columns. Paths use ``/`` and are relative to the root of their repository."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.split(path, "/")


def first_part(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last dotted ending of the file name, with its dot.

    A leading dot starts no suffix (``.env`` has none) and neither does a trailing one.
    """
    return F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1)


def lower_suffix(path: Column) -> Column:
    return F.lower(suffix(path))


def stem(path: Column) -> Column:
    """File name without its suffix."""
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def parent_dir(path: Column) -> Column:
    """Folder of the file, empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def any_part_in(path: Column, names: tuple[str, ...]) -> Column:
    """True when a folder of the path, or the file itself, carries one of ``names``."""
    return F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names]))


def has_part(path: Column, name: str) -> Column:
    return F.array_contains(parts(path), name)


def exists_at(path: Column, wanted: str) -> Column:
    """True for the file at ``wanted`` and for every file below a folder of that name."""
    return (path == wanted) | path.startswith(wanted + "/")
