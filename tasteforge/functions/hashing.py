"""Repeatable random numbers.

``rand(seed)`` depends on how rows are spread over partitions, so a result
drawn with it changes when the cluster does, or when a lost task is run again.
These numbers depend only on the values hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 13 hexadecimal digits = 52 bits, the most that a double holds exactly.
HEX_DIGITS = 13


def uniform(seed: int | str, *cols: str | Column) -> Column:
    """A number in [0, 1) made from the columns and the seed."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    number = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double")
    return number / F.lit(float(16**HEX_DIGITS))


def uniform_sql(seed: int | str, *cols: str) -> str:
    """The same number as DuckDB text, for the oracle queries."""
    inner = ", ".join(f"cast({c} as varchar)" for c in cols)
    digest = f"md5(concat_ws('|', {inner}, '{seed}'))"
    return f"(cast(cast('0x' || substr({digest}, 1, {HEX_DIGITS}) as bigint) as double) / {float(16**HEX_DIGITS)!r})"
