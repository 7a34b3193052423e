"""Pseudo-random numbers from MD5 of a seed and keys: the same in every engine and run."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *keys: Column) -> Column:
    """MD5 of ``seed|key|key…`` as hexadecimal text; sorts as a random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def _unit(hexadecimal: Column) -> Column:
    return (F.conv(F.substring(hexadecimal, 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform in (0, 1)."""
    return _unit(digest(seed, *keys))


def normal(seed: int | str, *keys: Column) -> Column:
    """Standard normal by Box and Muller from two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(seed, *keys, F.lit("a")))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("b")))


def half_gamma(seed: int | str, halves: int, *keys: Column) -> Column:
    """Gamma with shape halves/2: exponentials, and half a squared normal if odd."""
    total = F.lit(0.0)
    for i in range(halves // 2):
        total = total - F.ln(uniform(seed, *keys, F.lit(f"e{i}")))
    return total + F.pow(normal(seed, *keys, F.lit("z")), 2) / 2 if halves % 2 else total


# The same numbers as SQL text, for callers that state a query in SQL.


def sql_digest(seed: int | str, *keys: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]) + "))"


def sql_uniform(seed: int | str, *keys: str) -> str:
    return f"((CAST('0x' || substr({sql_digest(seed, *keys)}, 1, 8) AS BIGINT)::DOUBLE + 1) / 4294967297.0::DOUBLE)"


def sql_normal(seed: int | str, *keys: str) -> str:
    a, b = sql_uniform(seed, *keys, "'a'"), sql_uniform(seed, *keys, "'b'")
    return f"(sqrt(-2 * ln({a})) * cos(2 * pi() * {b}))"


def sql_half_gamma(seed: int | str, halves: int, *keys: str) -> str:
    parts = [f"-ln({sql_uniform(seed, *keys, repr(f'e{i}'))})" for i in range(halves // 2)]
    if halves % 2:
        parts.append(f"{sql_normal(seed, *keys, repr('z'))} ** 2 / 2")
    return "(" + " + ".join(parts) + ")"
