"""Streaming upkeep of the live offer cache: keyed state with clocks of its own for price and stock."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators.live import KEYS

#: Transforming with state keeps it in this kind of store; set spark.sql.streaming.stateStore.providerClass to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PRICE = "price_ht double, price_ttc double, fetched_at long, expires_at long"
_STOCK = "stock int, is_salable boolean, is_offer_available boolean, fetched_at long, expires_at long"
EVENTS = "event string, price_ht double, price_ttc double, price_expires_at long, stock int, is_salable boolean, is_offer_available boolean, stock_expires_at long"


def _rank(value: tuple) -> tuple:
    """Newest first by its time, then by its values, so that a replay chooses alike; null counts least."""
    return tuple((x is not None, x) for x in (value[-2], *value[:-2], value[-1]))


class OfferCache(StatefulProcessor):
    """The newest price and the newest stock of a key, each until it expires.

    An update that is older than what is held changes nothing, so updates may come in any order, late or twice, and the
    state is the same. A timer is set for each clock; when the watermark has passed it, the expired side goes, and the key with
    its last side.
    """

    def __init__(self, keys: list[str]):
        self.shape = Row(*keys, *(f.split()[0] for f in EVENTS.split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.price = handle.getValueState("price", _PRICE)
        self.stock = handle.getValueState("stock", _STOCK)

    def _held(self, state) -> tuple | None:
        return tuple(state.get()) if state.exists() else None

    def _fold(self, state, values: list[tuple]) -> bool:
        best = max(values, key=_rank, default=None)
        held = self._held(state)
        if best is None or (held is not None and _rank(held) >= _rank(best)):
            return False
        state.update(best)
        if best[-1] is not None:
            self.handle.registerTimer(-(-best[-1] // 1000))
        return True

    def _row(self, key: Any, event: str) -> Row:
        p, s = self._held(self.price) or (None,) * 4, self._held(self.stock) or (None,) * 5
        return self.shape(*key, event, p[0], p[1], p[3], s[0], s[1], s[2], s[4])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        prices, stocks = [], []
        for r in rows:
            # A price update without a price is refused, and so is a stock update without a stock.
            if (r.price_ht is not None or r.price_ttc is not None) and r.price_fetched_at is not None:
                prices.append((r.price_ht, r.price_ttc, r.price_fetched_at, r.price_expires_at))
            if r.stock is not None and r.stock_fetched_at is not None:
                stocks.append((r.stock, r.is_salable, r.is_offer_available, r.stock_fetched_at, r.stock_expires_at))
        changed = [self._fold(self.price, prices), self._fold(self.stock, stocks)]
        if any(changed):
            yield self._row(key, "updated")

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, gone = expiredTimerInfo.getExpiryTimeInMs(), False
        for state in (self.price, self.stock):
            held = self._held(state)
            if held is not None and held[-1] is not None and held[-1] <= now * 1000:
                state.clear()
                gone = True
        if gone:
            yield self._row(key, "expired" if not (self.price.exists() or self.stock.exists()) else "partly_expired")

    def close(self) -> None:
        pass


def offer_events(updates: DataFrame, at: str = "price_fetched_at", late: str = "10 minutes", keys: list[str] = KEYS) -> DataFrame:
    """A row for each change of a key's cached offer: updated, partly_expired or expired, with what is held then.

    ``updates`` is a stream with the columns of live.latest_offers and a time ``at``, by which updates more than ``late``
    behind are dropped. The last event of a key is its cache entry; operators.live.latest_offers gives the same for a batch.
    The state is bounded by the keys that have not expired.
    """
    rows = updates.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    for c in ("price_fetched_at", "price_expires_at", "stock_fetched_at", "stock_expires_at"):
        rows = rows.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")))  # in the state, times are microseconds
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.groupBy(*keys).transformWithState(OfferCache(keys), f"{kinds}, {EVENTS}", "update", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("price_expires_at", "stock_expires_at")})


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: windowed counts and sums of an event stream, with late events dropped after the watermark."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
