"""Admission of requests by tenant: a sliding minute and a cap on running requests.

Rejected requests leave no trace, so whether one is admitted depends on which
earlier ones were: a range frame over all requests gives other results. The
requests of a tenant are therefore taken one by one, in time order. What a
decision needs of the past is small: with a limit of n a minute, the n-th last
admission tells whether the minute is full, so only the last n are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamstone.schema import TENANT_DEFAULTS
from loamstone.streaming.sequences import in_order

WINDOW_SECONDS = 60.0
OUTPUT = "request_id long, tenant_id string, ts timestamp, kind string, admitted boolean"


def decide(
    seconds: list[float], kinds: list[str], per_minute: int | None, concurrent: int | None, recent: list[float], running: int
) -> tuple[list[bool | None], int]:
    """Whether each start is admitted (None for an end), and how many requests run afterwards.

    recent, ascending, holds the last admissions, at most per_minute; it is brought up to date. No limits: an unknown tenant, all rejected.
    """
    verdicts: list[bool | None] = []
    for now, kind in zip(seconds, kinds, strict=True):
        if kind != "start":
            running -= running > 0
            verdicts.append(None)
            continue
        full = not per_minute or (len(recent) >= per_minute and now - recent[-per_minute] < WINDOW_SECONDS)
        free = not full and running < concurrent
        if free:
            bisect.insort(recent, now)
            del recent[:-per_minute]
            running += 1
        verdicts.append(free)
    return verdicts, running


def admit(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """requests (request_id, tenant_id, ts, kind start or end) -> with admitted; unknown tenants are rejected, and a null limit of a
    known one is the default.

    Batch form: each tenant's requests are one sequence, which its task reads in batches and never holds as a whole.
    """
    own = (F.coalesce(c, F.lit(TENANT_DEFAULTS[c])).alias(c) for c in ("max_requests_per_min", "max_concurrent"))
    limits = tenants.select(F.col("tenant_id").alias("_tenant"), *own)
    joined = requests.select("request_id", "tenant_id", "ts", "kind").join(limits, F.col("tenant_id") == F.col("_tenant"), "left")
    rows = joined.select(
        F.col("request_id").cast("long"), F.col("tenant_id").cast("string"), F.col("ts").cast("timestamp"), "kind",
        F.col("max_requests_per_min").cast("int"), F.col("max_concurrent").cast("int"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, recent, running = object(), [], 0
        for batch in batches:
            names = batch.column(1).to_pylist()
            kinds, most, together, seconds = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
            verdicts: list[bool | None] = []
            while len(verdicts) < len(names):  # a run of one tenant's rows after another
                a = len(verdicts)
                b = next((k for k in range(a, len(names)) if names[k] != names[a]), len(names))
                if names[a] != tenant:
                    tenant, recent, running = names[a], [], 0
                made, running = decide(seconds[a:b], kinds[a:b], most[a], together[a], recent, running)
                verdicts += made
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.bool_())], [*batch.schema.names[:4], "admitted"])

    return in_order(rows, "tenant_id", "ts", "request_id").mapInArrow(run, OUTPUT)


def admit_stream(requests: DataFrame, per_minute: int = 60, concurrent: int = 50, idle_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """The same over a stream of requests; each micro-batch is taken in time order and the state goes from one to the next.

    By the time of the requests, a tenant that sends nothing for idle_seconds is forgotten, and with it requests of its that never
    ended; requests that come later than `late` behind the newest are dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "request_id"])[["request_id", "tenant_id", "ts", "kind"]]
        recent, running = state.get if state.exists else ([], 0)
        recent = [float(t) for t in recent]
        seconds = (rows["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6).tolist()
        verdicts, running = decide(seconds, rows["kind"].tolist(), per_minute, concurrent, recent, running)
        state.update((recent, running))
        state.setTimeoutTimestamp(int(max(seconds) + idle_seconds) * 1000)
        yield rows.assign(admitted=verdicts)

    return requests.withWatermark("ts", late).groupBy("tenant_id").applyInPandasWithState(
        run, OUTPUT, "recent array<double>, running int", "append", GroupStateTimeout.EventTimeTimeout
    )
