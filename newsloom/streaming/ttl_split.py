"""Compute once per time to live, with the requests of one key spread over tasks.

The expiries of a key chain: a computation at t is followed by the first request at
t + ttl or later. Each request's time is given that next time by windows over short
slices of a key's time, and the chain is then found by doubling: the steps of one,
two, four ... computations are composed by joins on (key, time). No task ever holds
all requests of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.schemas import CACHE_TTL_SECONDS
from newsloom.session import shared_dir

COMPUTED = "key string, computed_at timestamp, expires_at timestamp, n_requests bigint"
STATE = "key string, expires_at timestamp, latest timestamp"
SLICES = 64


def next_steps(requests: DataFrame, ttl_seconds: int, slices: int = SLICES) -> DataFrame:
    """(key, t, to, n): each distinct request time, the next one a time to live later, the requests until then.

    Times are microseconds. A slice is a ``slices``-th of the time to live and one
    window partition; per key there is one further row per occupied slice, for
    what lies beyond a slice.
    """
    ttl = ttl_seconds * 1_000_000
    width = max(1, ttl // slices)
    times = requests.groupBy("key", F.unix_micros("ts").alias("t")).agg(F.count("*").alias("n"))
    # Each time stands once for itself and once, without requests, for its expiry.
    ends = F.array(F.struct(F.col("t").alias("x"), F.col("n").alias("m")), F.struct((F.col("t") + ttl).alias("x"), F.lit(0).cast("bigint").alias("m")))
    points = times.select("key", "t", F.inline(ends))
    points = points.withColumn("slice", F.floor(F.col("x") / width)).withColumn("asked", F.when(F.col("m") > 0, F.col("x")))
    # Descending, so that "from here on" is a running aggregate.
    onward = Window.partitionBy("key", "slice").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = points.select("key", "t", "slice", "m", F.min("asked").over(onward).alias("near"), F.sum("m").over(onward).alias("rest"))
    beyond = Window.partitionBy("key").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    per_slice = points.groupBy("key", "slice").agg(F.min("asked").alias("first"), F.sum("m").alias("total"))
    later = per_slice.select(
        F.col("key").alias("_key"), F.col("slice").alias("_slice"),
        F.min("first").over(beyond).alias("far"), F.coalesce(F.sum("total").over(beyond), F.lit(0)).alias("more"),
    )
    placed = within.join(later, F.col("key").eqNullSafe(F.col("_key")) & (F.col("slice") == F.col("_slice")))
    at_time, at_end = F.col("m") > 0, F.col("m") == 0
    left = F.col("rest") + F.col("more")
    return placed.groupBy("key", "t").agg(
        F.max(F.when(at_end, F.coalesce("near", "far"))).alias("to"),
        (F.max(F.when(at_time, left)) - F.max(F.when(at_end, left))).alias("n"),
    )


def chained(steps: DataFrame) -> DataFrame:
    """The rows of ``steps`` that each key's first time leads to, in about log2 of the longest chain rounds."""
    shared_dir(steps.sparkSession)
    steps = steps.checkpoint()
    jumps = steps.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "to").where("to is not null")
    reached = steps.groupBy("key").agg(F.min("t").alias("t"))
    while True:
        here = F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t"))
        further = reached.join(jumps, here).select("key", F.col("to").alias("t")).checkpoint()
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        ahead = jumps.select(F.col("_key").alias("key"), F.col("_t").alias("start"), F.col("to").alias("t"))
        jumps = ahead.join(jumps, here).select(F.col("key").alias("_key"), F.col("start").alias("_t"), "to").checkpoint()
    known = reached.select(F.col("key").alias("_key"), F.col("t").alias("_t"))
    return steps.join(known, F.col("key").eqNullSafe(F.col("_key")) & (F.col("t") == F.col("_t")), "left_semi")


def computations(requests: DataFrame, live: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, slices: int = SLICES) -> DataFrame:
    """What requests (key, ts) cause, given the expiries (key, expires_at) in force.

    Requests before their key's expiry are hits. Null is a key like others; a
    request without a time is none. (key, computed_at, expires_at, n_requests) as in
    :func:`newsloom.streaming.ttl.computed_once`.
    """
    known = live.select(F.col("key").alias("_key"), F.col("expires_at").alias("_expires"))
    timed = requests.where("ts is not null").join(known, F.col("key").eqNullSafe(F.col("_key")), "left")
    missed = timed.where(F.col("_expires").isNull() | (F.col("ts") >= F.col("_expires"))).select("key", "ts")
    made = chained(next_steps(missed, ttl_seconds, slices))
    return made.select(
        "key", F.timestamp_micros("t").alias("computed_at"),
        F.timestamp_micros(F.col("t") + ttl_seconds * 1_000_000).alias("expires_at"), F.col("n").alias("n_requests"),
    )


def computed_once_split(
    requests: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    ttl_seconds: int = CACHE_TTL_SECONDS,
    lateness: str = "1 day",
    slices: int = SLICES,
    **trigger,
) -> StreamingQuery:
    """:func:`newsloom.streaming.ttl.computed_once` for streams with hot keys, written to ``out``.

    Each micro-batch writes its computations to ``out/batch=N`` and the expiries still
    in force to ``state/batch=N``, one row per key; a replay overwrites both from
    the state before it. An expiry is forgotten once the latest request of earlier
    batches is ``lateness`` past it, and requests from before that moment are dropped.
    """

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema(STATE).parquet(f"{state}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        latest = before.agg(F.max("latest").alias("latest"), F.expr(f"max(latest) - interval {lateness}").alias("horizon")).first()
        on_time = rows if latest["horizon"] is None else rows.where(F.col("ts") >= F.lit(latest["horizon"]))
        live = before.where("expires_at is not null").select("key", "expires_at")
        target = f"{out}/batch={batch_id}"
        computations(on_time, live, ttl_seconds, slices).write.mode("overwrite").parquet(target)
        made = spark.read.schema(COMPUTED).parquet(target)
        seen = rows.agg(F.greatest(F.max("ts"), F.lit(latest["latest"]).cast("timestamp"))).first()[0]
        now = F.lit(seen).cast("timestamp")
        gone = F.col("expires_at") <= now - F.expr(f"interval {lateness}")
        ends = live.unionByName(made.select("key", "expires_at")).groupBy("key").agg(F.max("expires_at").alias("expires_at"))
        kept = ends.where(~F.coalesce(gone, F.lit(False))).withColumn("latest", now)
        # A row of its own keeps the latest time when no expiry is left.
        mark = spark.createDataFrame([(None, None, seen)], STATE)
        kept.unionByName(mark).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    timed = requests.select("key", F.col("ts").cast("timestamp").alias("ts"))
    writer = timed.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
