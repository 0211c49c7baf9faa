"""Parts of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows; empty without one, or if only dots stand before it."""
    return F.regexp_extract(file_name(path), r"(?s)[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def derived_path(path: Column, target: str, kind: str) -> Column:
    """{target}/{stem}_{kind}{ext}; for HDR the stem loses its last three characters."""
    base = F.substring(stem(path), F.lit(1), F.greatest(F.length(stem(path)) - 3, F.lit(0))) if kind == "HDR" else stem(path)
    return F.concat(F.lit(target.rstrip("/") + "/"), base, F.lit(f"_{kind}"), extension(path))
