"""Uniform draws that are functions of a seed and of keys, so that every task, retry and engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 10


def uniform(seed: int, salt: int, *keys: Column) -> Column:
    """A number from 0 up to 1: the first 40 bits of the MD5 of seed, salt and keys."""
    text = F.concat_ws(":", F.lit(seed), F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / float(16**_DIGITS)


def uniform_sql(seed: int | str, salt: int | str, *keys: str) -> str:
    """The same draw in DuckDB's SQL."""
    text = ", ".join(f"({k})::VARCHAR" for k in (seed, salt, *keys))
    return f"(('0x' || substr(md5(concat_ws(':', {text})), 1, {_DIGITS}))::BIGINT / {16**_DIGITS}e0)"
