"""Checks of inputs and settings, as counts that should be zero or errors before planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bad_samples(df: DataFrame, width: int, classes: int, client: str = "client", x: str = "x", label: str = "y") -> DataFrame:
    """Per client: rows of another width, rows of an unknown class, rows with a value that is not finite."""
    odd = F.exists(x, lambda a: F.isnan(a) | a.isNull() | (F.abs(a) == float("inf")))
    return df.groupBy(client).agg(
        F.count_if(F.size(x) != width).alias("bad_width"),
        F.count_if(~F.col(label).between(0, classes - 1)).alias("bad_label"),
        F.count_if(odd).alias("bad_value"),
    )


def check_settings(classes: int, dims: int, ranks: list[int], wrong: int, correct: int) -> None:
    """Raises if a fixture or run can't be built: too many classes or ranks, uneven counts."""
    if classes < 2 or classes > dims:
        raise ValueError(f"{classes} classes don't fit {dims} dimensions")
    if any(r <= 0 or r > dims for r in ranks):
        raise ValueError(f"ranks {ranks} don't fit {dims} dimensions")
    if wrong % classes or correct % classes:
        raise ValueError("wrong and correct rows must divide evenly over the classes")


def shared_rank(total: int, ratio: float | None = None, fixed: int | None = None) -> tuple[int, int]:
    """Common and global parts of a shared rank: a fixed common part, or a ratio half to even."""
    common = min(total, fixed if fixed is not None else round(total * (1.0 if ratio is None else ratio)))
    return common, total - common


def due(round_: int, every: int, strength: float = 1.0) -> bool:
    """Whether something that is done every so many rounds is due after this one."""
    return every > 0 and strength > 0 and round_ % every == 0
