"""Dates in folder and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Pattern, and the groups of year, month and day; the first pattern that fits decides, valid or not.
PATTERNS = (
    (r"^(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)),
    (r"^(\d{4})_(\d{2})_(\d{2})", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    (r"^(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1)),
    (r"^(\d{4})[-_](\d{2})$", (1, 2, None)),
    (r"^(\d{2})(\d{2})(\d{2})(?:\D|$)", (1, 2, 3)),
)


def dir_date(name: Column) -> Column:
    """The date a name begins with, else null; two-digit years from 70 on are of the last century, a month alone is its first day."""
    name = strip(name)
    branches = []
    for pattern, (y, m, d) in PATTERNS:
        group = lambda i, p=pattern: F.regexp_extract(name, p, i)
        year = F.when(F.length(group(y)) == 4, group(y)).otherwise(F.concat(F.when(group(y) >= "70", "19").otherwise("20"), group(y)))
        text = F.concat_ws("-", year, group(m), group(d) if d else F.lit("01"))
        branches.append((name.rlike(pattern), F.try_to_date(text, "yyyy-MM-dd")))
    out = F.when(*branches[0])
    for b in branches[1:]:
        out = out.when(*b)
    return out
