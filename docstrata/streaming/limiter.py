"""Sliding-window limiter, token bucket and expiring sessions, per key.

Whether a request is accepted depends on which earlier ones were, so this is state, not a
window function. Each rule is a small step over a key's state. After a pause that is long
enough the state is as at the start, so that a history is cut there into segments that know
nothing of each other: batches run a rule over sorted segments, spread over all tasks, and carry
the state from one Arrow batch to the next. Streams use ``applyInPandasWithState``.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Requests within so many seconds; the bucket's size and refill a second; a session's life and number.
LIMIT, WINDOW_S = 60, 60.0
CAPACITY, REFILL = 5.0, 1 / 60
TTL_S, MOST_SESSIONS = 3_600.0, 20
#: Seconds of a user's history that are ordered together while it is cut.
SPAN_S = 3_600


class SlidingWindow:
    """Accepts ``limit`` hits in any ``window`` seconds; rejected hits are not remembered."""

    def __init__(self, limit: int = LIMIT, window: float = WINDOW_S, hits: list[float] | None = None):
        self.limit, self.window, self.hits = limit, window, deque(hits or [])

    def hit(self, at: float) -> tuple[bool, int]:
        """(accepted, seconds to wait)."""
        while self.hits and self.hits[0] <= at - self.window:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return False, max(1, int(self.hits[0] + self.window - at) + 1)
        self.hits.append(at)
        return True, 0


class TokenBucket:
    """Refills with time up to its capacity; an attempt takes one token or is rejected."""

    def __init__(self, capacity: float = CAPACITY, refill: float = REFILL, tokens: float | None = None, at: float | None = None):
        self.capacity, self.refill, self.tokens, self.at = capacity, refill, capacity if tokens is None else tokens, at

    def take(self, at: float) -> bool:
        if self.at is not None:
            self.tokens = min(self.capacity, self.tokens + max(0.0, at - self.at) * self.refill)
        self.at = at
        if self.tokens < 1:
            return False
        self.tokens -= 1
        return True


class Sessions:
    """Sessions end ``ttl`` seconds after they began; of too many the oldest is evicted."""

    def __init__(self, ttl: float = TTL_S, most: int = MOST_SESSIONS):
        self.ttl, self.most, self.open = ttl, most, deque()

    def begin(self, at: float) -> tuple[int, int]:
        """(open sessions, sessions evicted)."""
        while self.open and self.open[0] <= at - self.ttl:
            self.open.popleft()
        evicted = 0
        while len(self.open) >= self.most:
            self.open.popleft()
            evicted += 1
        self.open.append(at)
        return len(self.open), evicted


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") / 1e6


def segmented(events: DataFrame, fresh: Callable[[Column], Column], span: int = SPAN_S) -> DataFrame:
    """``events`` (event_id, user_id, ts) with ``segment``: a user's number that grows at the first row and after a pause (seconds) that is ``fresh``.

    A user's rows are dealt to spans of time. Within a span the row before is at hand; for the
    first row of a span it is the last of the user's span before, of which there is one row each.
    """
    key = ["user_id", "__span"]
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timed = events.withColumn("__at", at).withColumn("__span", F.floor(F.col("__at") / span))
    here = Window.partitionBy(*key).orderBy("ts", "event_id")
    spans = Window.partitionBy("user_id").orderBy("__span")
    joined = lambda rows, table: rows.alias("r").join(table.alias("t"), F.col("r.user_id").eqNullSafe(F.col("t.user_id")) & (F.col("r.__span") == F.col("t.__span")))
    last = timed.groupBy(*key).agg(F.max("__at").alias("__last")).select(*key, F.lag("__last").over(spans).alias("__before"))
    told = joined(timed, last).select("r.*", "t.__before")
    before = F.coalesce(F.lag("__at").over(here), F.col("__before"))
    marked = told.withColumn("__start", (before.isNull() | F.coalesce(fresh(F.col("__at") - before), F.lit(False))).cast("long"))
    earlier = spans.rowsBetween(Window.unboundedPreceding, -1)
    ahead = marked.groupBy(*key).agg(F.sum("__start").alias("__s")).select(*key, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__ahead"))
    up_to = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined(marked, ahead).select(*(F.col(f"r.{c}").alias(c) for c in (*events.columns, "__span", "__start")), "t.__ahead").select(*events.columns, (F.col("__ahead") + F.sum("__start").over(up_to)).alias("segment"))


def _scanned(events: DataFrame, fresh: Callable[[Column], Column], rule: Callable[[], object], step: Callable[[object, float], tuple], schema: str) -> DataFrame:
    """(event_id, user_id, and what ``step`` gives) of every event with a time, by a new ``rule`` for each segment."""
    timed = events.select("event_id", "user_id", "ts").filter("ts is not null")
    cut = segmented(timed, fresh).repartition("user_id", "segment").sortWithinPartitions("user_id", "segment", "ts", "event_id")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, state = None, None
        for pdf in batches:
            out = []
            users = pdf["user_id"].astype(object).where(pdf["user_id"].notna(), None)
            for *own, at in zip(users, pdf["segment"], _seconds(pdf["ts"]), strict=True):
                if own != segment:
                    segment, state = own, rule()
                out.append(step(state, at))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], **dict(zip(names, columns, strict=True))})

    return cut.mapInPandas(run, f"event_id long, user_id long, {schema}")


def limited(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """(event_id, user_id, accepted, retry_after) of ``events`` (event_id, user_id, ts), by time and id.

    A null time can't be judged and is accepted: the limiter fails open. A null user is a user.
    """
    judged = _scanned(events, lambda pause: pause >= window, lambda: SlidingWindow(limit, window), lambda rule, at: rule.hit(at), "accepted boolean, retry_after int")
    unknown = events.filter("ts is null").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.lit(True).alias("accepted"), F.lit(0).alias("retry_after"))
    return judged.union(unknown)


def bucketed(events: DataFrame, capacity: float = CAPACITY, refill: float = REFILL) -> DataFrame:
    """(event_id, user_id, accepted, tokens): each event takes a token of its user's bucket."""

    def step(rule: TokenBucket, at: float) -> tuple[bool, float]:
        return rule.take(at), math.floor(rule.tokens * 1000) / 1000

    return _scanned(events, lambda pause: pause * refill >= capacity, lambda: TokenBucket(capacity, refill), step, "accepted boolean, tokens double")


def with_sessions(events: DataFrame, ttl: float = TTL_S, most: int = MOST_SESSIONS) -> DataFrame:
    """(event_id, user_id, open_sessions, evicted): each event begins a session of its user."""
    return _scanned(events, lambda pause: pause >= ttl, lambda: Sessions(ttl, most), lambda rule, at: rule.begin(at), "open_sessions int, evicted int")


def limited_stream(events: DataFrame, limit: int = LIMIT, window: float = WINDOW_S) -> DataFrame:
    """The limiter over a stream: a user's accepted times are its state.

    The state goes once the watermark, which trails the latest event by one window, has
    passed the user's last event by a window more. Later events of that time are dropped.
    """
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        rule = SlidingWindow(limit, window, list(state.get[0]) if state.exists else [])
        out = [rule.hit(at) for at in _seconds(pdf["ts"])]
        state.update((list(rule.hits),))
        last = pd.Timestamp(pdf["ts"].iloc[-1]).tz_localize(zone).timestamp()
        state.setTimeoutTimestamp(int(max((last + window) * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "user_id": pdf["user_id"].to_numpy(), "accepted": [a for a, _ in out], "retry_after": [r for _, r in out]})

    schema = "event_id long, user_id long, accepted boolean, retry_after int"
    timed = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", f"{window} seconds")
    return timed.groupBy("user_id").applyInPandasWithState(run, schema, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)
