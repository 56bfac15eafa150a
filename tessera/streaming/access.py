"""Accesses as a stream: hotspots as they form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def hotspots(accesses: DataFrame, minutes: int = 10, baseline: int = 1, factor: int = 5, floor: int = 10) -> DataFrame:
    """object_key, accesses, detected_at of a stream of accesses (object_key, access_time): a row for each batch in which an
    object has more than baseline * factor and more than floor accesses in some trailing window.

    An object's state holds the times of its last window and no more than that; times before the newest are taken in
    their place if the window still reaches them.
    """
    width, least = pd.Timedelta(minutes=minutes), max(baseline * factor, floor)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.Series(pd.to_datetime(list(state.get[0]), unit="us")) if state.exists else pd.Series([], dtype="datetime64[ns]")
        new = pd.concat([f["access_time"] for f in frames])
        times = pd.concat([held, new]).sort_values().reset_index(drop=True)
        first = times.searchsorted(times - width, side="right")
        count = pd.Series(range(1, len(times) + 1)) - first
        hot = (count > least) & times.isin(new)
        if hot.any():
            yield pd.DataFrame({"object_key": [key[0]], "accesses": [int(count[hot].max())], "detected_at": [times[hot].max()]})
        kept = times[times > times.iloc[-1] - width]
        state.update(([int(t.value // 1000) for t in kept],))

    return accesses.groupBy("object_key").applyInPandasWithState(run, "object_key string, accesses long, detected_at timestamp", "times array<long>", "append", "NoTimeout")
