"""Sessions of a stream.  An extension: the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """Sessions per key of a streaming DataFrame; each comes out once, when the watermark has passed its end plus the gap.

    Rows later than ``late`` behind the latest time are dropped; state of closed sessions is freed.
    """
    seen = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    s = seen.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last_ts"))
    return s.select(key, F.col("w.start").alias("first_ts"), "last_ts", "n_events")
