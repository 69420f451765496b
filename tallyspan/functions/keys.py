"""Keys of a series: ``path``, ``path#item`` or a bare measure name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_of(key: Column) -> Column:
    """The part before the first ``#``."""
    return F.substring_index(key, "#", 1)


def item_of(key: Column) -> Column:
    """The part after the first ``#``; null for a key without one."""
    at = F.instr(key, "#")
    return F.when(at > 0, F.substr(key, at + 1))


def last_item_of(key: Column) -> Column:
    """The part after the last ``#``; null for a key without one."""
    return F.when(F.instr(key, "#") > 0, F.substring_index(key, "#", -1))


def under(path: Column, directory: Column) -> Column:
    """Whether a path lies below a directory; the directory itself doesn't."""
    return F.startswith(path, F.concat(directory, F.lit("/")))


def machine_path(key: Column) -> Column:
    """Whether a key names a place on one machine: an absolute path, a drive, or a way up out of the tree."""
    return key.rlike(r"^(/|[A-Za-z]:[\\/]|\\\\)|(^|/)\.\.(/|$)")
