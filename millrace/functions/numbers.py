"""Deterministic uniform draws and human-readable counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip


def draw_key(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) fixed by ``parts`` alone, so re-runs and repartitioning agree."""
    return F.conv(F.substring(draw_key(*parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def parse_count(value: Column) -> Column:
    """``1m``, ``500k``, ``1_000`` or ``1.5m`` as a whole number, truncated."""
    text = F.replace(F.lower(strip(value)), F.lit("_"), F.lit(""))
    unit = F.right(text, F.lit(1))
    factor = F.when(unit == "m", 1_000_000).when(unit == "k", 1_000).otherwise(1)
    digits = F.when(factor > 1, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return (digits.cast("double") * factor).cast("bigint")


def format_count(n: Column) -> Column:
    return (
        F.when((n >= 1_000_000) & (n % 1_000_000 == 0), F.concat((n / 1_000_000).cast("bigint").cast("string"), F.lit("m")))
        .when((n >= 1_000) & (n % 1_000 == 0), F.concat((n / 1_000).cast("bigint").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def count_label(n: int) -> str:
    """The same label for a path that is built before any job runs."""
    for size, unit in ((1_000_000, "m"), (1_000, "k")):
        if n >= size and n % size == 0:
            return f"{n // size}{unit}"
    return str(n)


def count_of(text: str) -> int:
    """A count given as a parameter, in the notation ``parse_count`` reads from a column."""
    match = re.fullmatch(r"\s*([^\skKmM]+)([kKmM]?)\s*", text)
    if match is None:
        raise ValueError(f"not a count: {text!r}")
    return int(float(match[1].replace("_", "")) * {"": 1, "k": 1_000, "m": 1_000_000}[match[2].lower()])
