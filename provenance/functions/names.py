"""Scalar functions on names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_name(c: Column) -> Column:
    """Equal for two names that agree without letter case, spaces and punctuation."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", "")


def blank(c: Column) -> Column:
    """Whether the text is empty or white space only."""
    return c.rlike(r"(?U)\A\s*\z")


def plain_path(c: Column) -> Column:
    """The path with `.`, `..` and repeated slashes resolved. Paths without any of these skip the work on arrays."""
    absolute = c.startswith("/")

    def up(a: Column) -> Column:
        can = (F.size(a) > 0) & F.coalesce(F.get(a, F.size(a) - 1) != "..", F.lit(False))
        return F.when(can, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(absolute, a).otherwise(F.concat(a, F.array(F.lit(".."))))

    parts = F.filter(F.split(c, "/"), lambda x: (x != "") & (x != "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    resolved = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(done, "/"))
    return F.when(c.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), resolved).otherwise(c)
