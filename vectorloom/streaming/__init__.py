"""Prototypes kept up to date over a stream of samples (an extension)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_means(stream: DataFrame, client: str = "client", label: str = "y", x: str = "x") -> DataFrame:
    """Class means per client as samples arrive: client, y, n, w after every batch that touches them.

    State is a count and a sum per client and class, whatever passes by.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, [])
        total = np.array(total)
        for rows in batches:
            if len(rows):
                m = np.stack(rows[x].to_numpy()).astype(np.float64)
                n, total = n + len(m), m.sum(axis=0) + (total if total.size else 0.0)
        state.update((n, total.tolist()))
        yield pd.DataFrame({client: [key[0]], label: [key[1]], "n": [n], "w": [(total / max(n, 1)).tolist()]})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{client} {kinds[client]}, {label} {kinds[label]}, n bigint, w array<double>"
    return stream.groupBy(client, label).applyInPandasWithState(update, out, "n bigint, total array<double>", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and means per time window; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")
