"""Cached live offers: price and stock expire on their own clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.feeds_text import has_sensitive_key

KEYS = ["connector", "store", "supplier_reference"]


def freshness(now: Column) -> Column:
    """missing, fresh, price_fresh_stock_stale, stock_fresh_price_stale, stock_only or stale.

    A remembered "not available" without a price is a whole answer while its stock clock runs; any other stock without a
    price is stock_only.
    """
    price = F.col("price_ht").isNotNull() | F.col("price_ttc").isNotNull()
    negative = ~price & F.coalesce((F.col("stock") == 0) | ~F.col("is_salable") | ~F.col("is_offer_available"), F.lit(False))
    fresh_price = price & F.coalesce(F.col("price_expires_at") > now, F.lit(False))
    fresh_stock = F.col("stock").isNotNull() & F.coalesce(F.col("stock_expires_at") > now, F.lit(False))
    data = price | F.col("stock").isNotNull() | F.col("is_salable").isNotNull() | F.col("is_offer_available").isNotNull()
    return (
        F.when(~data, "missing").when(negative & fresh_stock, "fresh").when(fresh_price & fresh_stock, "fresh")
        .when(fresh_price, "price_fresh_stock_stale").when(fresh_stock & ~price, "stock_only").when(fresh_stock, "stock_fresh_price_stale").otherwise("stale")
    )


def latest_offers(updates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The newest price and the newest stock of each key, each with its own expiry; a price update without a price is refused.

    Of updates of the same moment the one with the greatest values stays, so that reruns agree.
    """
    price = F.when(F.col("price_ht").isNotNull() | F.col("price_ttc").isNotNull(), F.col("price_fetched_at"))
    newest = lambda c, t: F.max(F.when(t.isNotNull(), F.struct(t.alias("at"), *c)))
    stock = F.when(F.col("stock").isNotNull(), F.col("stock_fetched_at"))
    out = updates.groupBy(*keys).agg(
        newest(["price_ht", "price_ttc", "price_expires_at"], price).alias("p"), newest(["stock", "is_salable", "is_offer_available", "stock_expires_at"], stock).alias("s")
    )
    return out.select(*keys, "p.*", "s.*").drop("at")


def refresh_plan(wanted: DataFrame, cache: DataFrame, now: Column, keys: list[str] = KEYS) -> DataFrame:
    """Each wanted key once, its freshness, and whether it needs a refresh."""
    rows = wanted.select(*keys).distinct().join(cache, keys, "left").withColumn("freshness", freshness(now))
    return rows.select(*keys, "freshness", (F.col("freshness") != "fresh").alias("needs_refresh"))


def provenance(refreshed: Column, fresh: Column) -> Column:
    """live if just fetched, cache if still valid, stale if served after a failure."""
    return F.when(refreshed, "live").when(fresh, "cache").otherwise("stale")


def put_stores(cache: DataFrame, answers: DataFrame, ttl: str) -> DataFrame:
    """The store cache (connector, lookup, payload, fetched_at, expires_at) with new answers (connector, lookup, payload, fetched_at).

    The newest answer of a look-up stays, of two at one moment the greater payload; it is valid for ``ttl``. Answers without
    a payload or a time, or with a key that marks a secret, are refused.
    """
    fine = answers.where(F.col("payload").isNotNull() & F.col("fetched_at").isNotNull() & ~has_sensitive_key(F.col("payload")))
    rows = cache.unionByName(fine.withColumn("expires_at", F.col("fetched_at") + F.expr(f"interval {ttl}")).select(*cache.columns))
    return rows.groupBy("connector", "lookup").agg(F.max(F.struct("fetched_at", "payload", "expires_at")).alias("x")).select("connector", "lookup", "x.payload", "x.fetched_at", "x.expires_at")


def get_stores(cache: DataFrame, wanted: DataFrame, now: Column, allow_stale: bool = False) -> DataFrame:
    """The cached answer of each wanted look-up (connector, lookup) once, with is_fresh; stale ones only if asked for."""
    found = wanted.select("connector", "lookup").distinct().join(cache, ["connector", "lookup"]).withColumn("is_fresh", F.col("expires_at") > now)
    return found if allow_stale else found.where("is_fresh")
