"""Results as a stream: new deliveries are compared with the last status known of each target."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attesta.functions.text import canonical_status, target_key

_RANK = {"valid_trusted": 2, "valid_untrusted": 1}


def regressions(results: DataFrame) -> DataFrame:
    """A row (set_name, target, was, now, loaded_at) whenever a target's status ranks lower than when last seen.

    ``results`` is a stream with set_name, target, status and loaded_at. State is one status per target; rows of one
    micro-batch are taken in the order of loaded_at, and rows older than what is known of a target change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, at = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("loaded_at", kind="stable").itertuples():
            if at is not None and row.loaded_at < at:
                continue
            if was is not None and _RANK.get(row.status, 0) < _RANK.get(was, 0):
                out.append((key[0], key[1], was, row.status, pd.Timestamp(row.loaded_at, unit="us", tz="UTC")))
            was, at = row.status, row.loaded_at
        if was is not None:
            state.update((was, at))
        yield pd.DataFrame(out, columns=["set_name", "target", "was", "now", "loaded_at"])

    rows = results.select("set_name", target_key(F.col("target")).alias("target"), F.coalesce(canonical_status(F.col("status")), F.lit("error")).alias("status"), F.unix_micros("loaded_at").alias("loaded_at"))
    return rows.groupBy("set_name", "target").applyInPandasWithState(step, "set_name string, target string, was string, now string, loaded_at timestamp", "status string, at long", "append", GroupStateTimeout.NoTimeout)
