"""Keyed state of live offers: late and repeated updates, expiry, restart; against the batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import live
from tallyforge.streaming import offers

SCHEMA = "connector string, store string, supplier_reference string, price_ht double, price_ttc double, price_fetched_at timestamp, price_expires_at timestamp, stock int, stock_fetched_at timestamp, stock_expires_at timestamp, is_salable boolean, is_offer_available boolean"
T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def update(key, hour, price=None, stock=None, price_ttl=10, stock_ttl=2):
    return ("c", "s", key, price, None, at(hour), at(hour + price_ttl), stock, at(hour), at(hour + stock_ttl), True, True)


BATCHES = [
    [update("a", 0, 5.0, 3), update("b", 0, None, 7), update("a", 0, 4.0, None), update("z", 0)],
    [update("a", -0.1, 9.0, 9), update("a", 1, 6.0, None), update("a", 0, 5.0, 3), update("c", 1, 1.0, 1)],
    [update("c", 6, None, 8)],
    [update("d", 30, 2.0, 2)],
    [update("d", 30, 2.0, 2)],
]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", offers.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, source, log, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = offers.offer_events(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(log)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_state_over_restarts(rocks, tmp_path):
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k, batch in enumerate(BATCHES):
        rocks.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 2, 4):  # each run goes on from the state of the one before
            run(rocks, source, log, checkpoint)
    events = [(r.supplier_reference, r.event, r.price_ht, r.stock) for r in rocks.read.parquet(log).orderBy("batch", "supplier_reference").collect()]
    # The updated price of a stays with the stock of hour 0, older and repeated updates and the one without values change nothing.
    assert [e for e in events if e[0] == "a"] == [("a", "updated", 5.0, 3), ("a", "updated", 6.0, 3), ("a", "partly_expired", 6.0, None), ("a", "expired", None, None)]
    assert [e for e in events if e[0] == "b"] == [("b", "updated", None, 7), ("b", "expired", None, None)]
    assert [e for e in events if e[0] == "c"][:2] == [("c", "updated", 1.0, 1), ("c", "updated", 1.0, 8)] and [e for e in events if e[0] == "c"][-1] == ("c", "expired", None, None)
    assert [e for e in events if e[0] == "d"] == [("d", "updated", 2.0, 2)] and not [e for e in events if e[0] == "z"]


def test_events_end_where_the_batch_form_does(rocks, tmp_path):
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    rows = rocks.createDataFrame([r for b in BATCHES[:2] for r in b], SCHEMA)
    rows.coalesce(1).write.parquet(source)
    run(rocks, source, log, checkpoint)
    got = {(r.supplier_reference, r.price_ht, r.stock) for r in rocks.read.parquet(log).collect()}
    want = {(r.supplier_reference, r.price_ht, r.stock) for r in live.latest_offers(rows).where("price_ht IS NOT NULL OR stock IS NOT NULL").collect()}
    assert got == want


def test_store_cache(spark):
    schema = "connector string, lookup string, payload string, fetched_at timestamp"
    cache = spark.createDataFrame([], schema + ", expires_at timestamp")
    cache = live.put_stores(cache, spark.createDataFrame([("c", "a", "[1]", at(0)), ("c", "a", "[2]", at(0)), ("c", "b", None, at(0)), ("c", "d", '{"cookie": 1}', at(0)), ("c", "e", "[]", None)], schema), "1 hour")
    cache = live.put_stores(cache, spark.createDataFrame([("c", "a", "[0]", at(-1)), ("c", "f", "[3]", at(2))], schema), "1 hour")
    assert sorted((r.lookup, r.payload) for r in cache.collect()) == [("a", "[2]"), ("f", "[3]")]
    wanted = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "f"), ("c", "x")], "connector string, lookup string")
    now = F.lit(at(2.5))
    assert [r.lookup for r in live.get_stores(cache, wanted, now).collect()] == ["f"]
    assert sorted((r.lookup, r.is_fresh) for r in live.get_stores(cache, wanted, now, True).collect()) == [("a", False), ("f", True)]
