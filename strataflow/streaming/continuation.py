"""Streaming continuation: each series' target is carried on as its readings arrive, with one small state a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "well_id bigint, row_seq bigint, tvt_filled double, rows_since_known int, trend double"
STATE = "last double, trend double, since int"


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, trend, since = state.get if state.exists else (None, 0.0, 0)
    rows = []
    for p in batches:
        for r in p.sort_values("row_seq").itertuples(index=False):
            if pd.notna(r.tvt_input):
                if last is not None:
                    trend = 0.7 * trend + 0.3 * (r.tvt_input - last) / max(1, since + 1)
                last, since = float(r.tvt_input), 0
                rows.append((key[0], r.row_seq, last, since, trend))
            else:
                since += 1
                rows.append((key[0], r.row_seq, None if last is None else last + trend * since, since, trend))
    state.update((last, float(trend), int(since)))
    yield pd.DataFrame(rows, columns=["well_id", "row_seq", "tvt_filled", "rows_since_known", "trend"])


def continued(readings: DataFrame) -> DataFrame:
    """readings: a stream of well_id, row_seq, tvt_input, in order within a series across batches. Append mode."""
    return readings.select("well_id", "row_seq", "tvt_input").groupBy("well_id").applyInPandasWithState(_carry, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_means(readings: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mean reading by series and event-time window; rows later than the watermark are dropped by Spark."""
    from pyspark.sql import functions as F

    return readings.withWatermark(time, late).groupBy("well_id", F.window(time, width)).agg(F.avg("gr").alias("gr_mean"), F.count("*").alias("n"))
