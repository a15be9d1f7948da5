"""File-name expressions. Both slash kinds separate folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def base_name(path: Column | str) -> Column:
    """What follows the last separator; a pattern bound to the end would try every place of a long path."""
    return F.substring_index(F.substring_index(_col(path), "/", -1), "\\", -1)


def parent_folder(path: Column | str) -> Column:
    """Everything before the last separators; a file in the root keeps the root itself."""
    cut = F.regexp_extract(_col(path), r"^(.*?)[/\\]+[^/\\]*$", 1)
    root = F.regexp_extract(_col(path), r"^([/\\])[^/\\]*$", 1)
    return F.when(root != "", root).otherwise(cut)


def stem(path: Column | str) -> Column:
    """Base name without its last dot suffix."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """Last dot suffix with its dot, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def sibling(parent: Column, file_name: Column) -> Column:
    """Join a folder and a file name, adding a separator only where one is missing."""
    bare = (parent == "") | F.endswith(parent, F.lit("/")) | F.endswith(parent, F.lit("\\"))
    return F.concat(parent, F.when(bare, "").otherwise("/"), file_name)
