"""Streams that keep state: asking-price moves per listing, the best deals of a day, alerts of saved searches.

State is bounded: a listing keeps its last ask and what has arrived but is not settled, a part of a day its ten best, and
what waits is emptied by event-time timers. Late rows within the delay are put in their place, later ones and repeated
deliveries change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dealwright.operators.history import watch_met

#: The state store that streams with timers and maps need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that a day's deals are dealt to before the best of each are put together.
PARTS = 64
#: Buckets that listings are dealt to, whose state is kept together.
BUCKETS = 1024


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that they need; the session's setting is put back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class PriceMoves(StatefulProcessor):
    """Sightings of the listings of a bucket in the order of time, each with the ask before it, once the watermark has passed
    them. A call to the state is a round trip, so what waits is one list: read and written as a whole, with one timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "listing_id long", "price double")
        self.waiting = handle.getListState("waiting", "listing_id long, ts long, event_id long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                at = pdf["ts"].astype("datetime64[us]").astype("int64")
                prices = [None if pd.isna(p) else float(p) for p in pdf["price"]]
                self.waiting.appendList(list(zip(pdf["listing_id"].tolist(), at.tolist(), pdf["event_id"].tolist(), prices)))
                first = min(int(at.min()), first if first is not None else int(at.min()))
        if first is not None:
            # a timer counts in milliseconds and fires when the watermark is beyond it
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        due: dict[int, dict[tuple, float | None]] = {}
        left, held = [], False
        for listing, at, event, price in self.waiting.get():
            held = True
            ready = at // 1000 + 1
            if ready <= fired or ready < watermark:
                due.setdefault(listing, {}).setdefault((at, event), price)  # the first of repeated deliveries
            else:
                left.append((listing, at, event, price))
        if not due:
            return
        out = []
        for listing, seen in due.items():
            had = self.last.getValue((listing,))[0] if self.last.containsKey((listing,)) else None
            before = had
            for at, event in sorted(seen):
                price = seen[at, event]
                out.append((listing, event, at, price, before))
                before = price
            if before is not None:
                self.last.updateValue((listing,), (before,))
            elif had is not None:
                self.last.removeKey((listing,))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(row[1] for row in left) // 1000 + 1)
        elif held:
            self.waiting.clear()
        told = pd.DataFrame(out, columns=["listing_id", "event_id", "ts", "price", "previous"])
        yield told.assign(ts=pd.to_datetime(told["ts"], unit="us"))

    def close(self) -> None:
        pass


def price_moves(arrivals: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each sighting (listing_id, event_id, ts, price) with the ``previous`` ask and the ``move`` from it.

    As the batch form gives them, in the order of (ts, event_id), as soon as the watermark has passed a sighting.
    """
    named = arrivals.where("listing_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL")
    rows = named.select("listing_id", "event_id", "ts", "price").withWatermark("ts", delay)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("listing_id"), F.lit(BUCKETS)))
    moved = dealt.groupBy("bucket").transformWithStateInPandas(
        PriceMoves(), "listing_id long, event_id long, ts timestamp, price double, previous double", "Append", "EventTime"
    )
    return moved.withColumn("move", F.col("price") - F.col("previous"))


class BestOfDay(StatefulProcessor):
    """The best few deals of a part of a day, told when the day is over."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "listing_id long", "discount_pct double, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = {k[0]: tuple(v) for k, v in self.best.iterator()}
        had = dict(best)
        for pdf in rows:
            for listing, discount, price in zip(pdf["listing_id"], pdf["discount_pct"], pdf["price"]):
                now = (float(discount), float(price))
                best[int(listing)] = max(best.get(int(listing), now), now)
            kept = sorted(best, key=lambda k: (-best[k][0], k))[: self.n]
            best = {k: best[k] for k in kept}
        for k in had.keys() - best.keys():
            self.best.removeKey((k,))
        for k, v in best.items():
            if had.get(k) != v:
                self.best.updateValue((k,), v)
        self.handle.registerTimer(int((pd.Timestamp(key[0]) + pd.Timedelta(days=1)).value // 1_000_000))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(key[0], k[0], v[0], v[1]) for k, v in self.best.iterator()]
        self.best.clear()
        if rows:
            yield pd.DataFrame(rows, columns=["day", "listing_id", "discount_pct", "price"])

    def close(self) -> None:
        pass


def best_of_days(deals: DataFrame, delay: str = "1 day", n: int = 10) -> DataFrame:
    """(day, listing_id, discount_pct, price): of every part of a closed day its ``n`` best listings.

    A listing counts once a day, with its largest discount. ``digest`` ranks what the parts have told.
    """
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    known = deals.where("discount_pct IS NOT NULL AND listing_id IS NOT NULL AND price IS NOT NULL")
    rows = known.withWatermark("ts", delay).select(
        day, F.pmod(F.xxhash64("listing_id"), F.lit(PARTS)).alias("part"), "ts", "listing_id", "discount_pct", "price"
    )
    return rows.groupBy("day", "part").transformWithStateInPandas(
        BestOfDay(n), "day string, listing_id long, discount_pct double, price double", "Append", "EventTime"
    )


def digest(told: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best of each day with their place, from the few rows that ``best_of_days`` has stored."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("discount_pct")).alias("o"), "listing_id", "discount_pct", "price")))
    each = told.groupBy("day").agg(F.slice(order, 1, n).alias("_best")).select("day", F.posexplode("_best").alias("_at", "_d"))
    return each.select("day", (F.col("_at") + 1).alias("place"), "_d.listing_id", "_d.discount_pct", "_d.price")


def alerts(deals: DataFrame, watchlist: DataFrame, delay: str = "1 day") -> DataFrame:
    """(watch_id, listing_id, ts, price, discount_pct): a deal that meets a saved search, once per search and listing
    within ``delay``; after that time the state forgets both."""
    met = watch_met(deals.withWatermark("ts", delay), watchlist)
    found = met.select("w.watch_id", "d.listing_id", "d.ts", "d.price", "d.discount_pct")
    return found.dropDuplicatesWithinWatermark(["watch_id", "listing_id"])
