"""The result cache as streaming state: compute once per time to live and key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.schemas import CACHE_TTL_SECONDS
from newsloom.session import ship_package

OUTPUT = "key string, computed_at timestamp, expires_at timestamp, n_requests bigint"


def computed_once(
    requests: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, watermark: str = "1 day"
) -> DataFrame:
    """A stream of requests (key, ts) to the computations it causes.

    The first request for a key computes; requests before the expiry are hits and
    do not prolong it; the next one computes again. ``n_requests`` counts the
    requests of the micro-batch that the computation served. The state is one
    expiry time per key and is dropped once the watermark has passed it. Requests
    that come later than ``watermark`` behind the latest are the only ones dropped;
    a request before the last expiry is a hit, whatever the order of arrival.

    Expiries chain, so one key is one task's work; it needs the times only, eight
    bytes per request of the key in the micro-batch, and skips from expiry to
    expiry. The source's trigger options bound the micro-batch.
    """
    ship_package(requests.sparkSession)
    ttl = np.timedelta64(ttl_seconds, "s")

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([b["ts"].to_numpy("datetime64[us]") for b in batches]))
        start = 0
        if state.exists:
            expires = np.datetime64(state.get[0], "us")
            start = int(np.searchsorted(times, expires, side="left"))
        out = []
        while start < len(times):
            expires = times[start] + ttl
            stop = int(np.searchsorted(times, expires, side="left"))
            out.append((key[0], times[start], expires, stop - start))
            start = stop
        if out:
            state.update((int(out[-1][2].astype("datetime64[us]").astype(np.int64)),))
        # The watermark may already be past the expiry; a timeout has to lie after it.
        state.setTimeoutTimestamp(max(state.get[0] // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "computed_at", "expires_at", "n_requests"])

    timed = requests.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return timed.groupBy("key").applyInPandasWithState(
        serve, OUTPUT, "expires_us bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def computed_once_native(requests: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """The same idea with Spark's own operator and no Python worker.

    State is kept until the watermark passes, so a request that comes after the
    expiry but before the watermark catches up is still dropped.
    """
    timed = requests.select("key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", ttl)
    return timed.dropDuplicatesWithinWatermark(["key"])
