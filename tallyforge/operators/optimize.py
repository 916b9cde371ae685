"""Procurement plans: exact search over agencies and preparation times, exact tours, for all carts at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.geo import grid_km, grid_minutes
from tallyforge.operators.compare import best_lines, ranked_offers
from tallyforge.operators.offers import available_quantity, geolocated
from tallyforge.session import written


#: Tours that are sent to all tasks at most; carts with more of them meet them by site.
MANY_TOURS = 1 << 16


@dataclass(frozen=True)
class CostParameters:
    per_km: str = "0.50"
    per_hour: str = "30"
    extra_stop: str = "5"


def plan_cost(materials, km, travel, preparation, stops, p: CostParameters = CostParameters()) -> Column:
    """Materials plus distance, time and extra stops; each part rounded to cents by itself."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    dec = lambda x: F.lit(x).cast("decimal(10,4)")
    distance = F.round(col(km).cast("decimal(12,2)") * dec(p.per_km), 2)
    time = F.round((col(travel).cast("decimal(12,2)") + col(preparation).cast("decimal(10,0)")) * dec(p.per_hour) / 60, 2)
    extra = F.round(F.greatest(col(stops) - 1, F.lit(0)).cast("decimal(6,0)") * dec(p.extra_stop), 2)
    return (col(materials) + distance + time + extra).cast("decimal(14,2)")


def legs(points: DataFrame, by: str = "cart_id") -> DataFrame:
    """Directed legs between all points of a cart, in hundredths of minutes and km. ``points``: by, idx (0 is the origin), latitude, longitude.

    Points are bounded by the agency limit, so the pairs of a cart are too.
    """
    a, b = points.alias("a"), points.alias("b")
    km = grid_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    rows = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.idx") != F.col("b.idx"))).select(
        F.col(f"a.{by}").alias(by), F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), km.alias("km")
    )
    return rows.select(by, "i", "j", F.round(grid_minutes("km") * 100).cast("int").alias("time"), F.round(F.col("km") * 100).cast("int").alias("dist"))


def best_tours(legs: DataFrame, max_stops: int, by: str = "cart_id") -> DataFrame:
    """(by, mask, time, dist, order): the best closed tour of every set of stops, by dynamic programming over sets.

    A state is a set of visited stops and the last of them; a round adds one stop by a join with
    the legs and keeps the least (time, distance, order) of each state. Stops are numbered in the
    order of their keys, so that the order breaks ties by key. Exact for sets of any size up to
    ``max_stops``.
    """
    bit = F.expr("shiftleft(1, j - 1)")
    state = legs.where("i = 0").select(by, bit.alias("mask"), F.col("j").alias("last"), "time", "dist", F.array("j").alias("ord"))
    every = [state]
    hops = legs.where("i > 0 and j > 0").withColumn("bit", bit)
    for _ in range(max_stops - 1):
        grown = state.join(hops.withColumnsRenamed({"time": "t", "dist": "d"}), [by]).where("i = last and mask & bit = 0")
        new = grown.select(by, (F.col("mask").bitwiseOR(F.col("bit"))).alias("mask"), F.col("j").alias("last"), (F.col("time") + F.col("t")).alias("time"), (F.col("dist") + F.col("d")).alias("dist"), F.concat("ord", F.array("j")).alias("ord"))
        state = new.groupBy(by, "mask", "last").agg(F.min(F.struct("time", "dist", "ord")).alias("x")).select(by, "mask", "last", "x.*")
        state = written(state, "tours")
        every.append(state)
    home = legs.where("j = 0").select(by, F.col("i").alias("last"), F.col("time").alias("t"), F.col("dist").alias("d"))
    closed = reduce(DataFrame.unionByName, every).join(home, [by, "last"]).select(by, "mask", F.struct((F.col("time") + F.col("t")).alias("time"), (F.col("dist") + F.col("d")).alias("dist"), "ord").alias("x"))
    return closed.groupBy(by, "mask").agg(F.min("x").alias("x")).select(by, "mask", "x.time", "x.dist", F.col("x.ord").alias("ord"))


def _carts(lines: DataFrame, offers: DataFrame, target: str, max_agencies: int) -> DataFrame:
    """(cart_id, keys, limits, products, site): each cart's eligible agencies and preparation limits, and the full offers of each product, best first.

    ``site`` names the origin and the places of the agencies; carts with one site have the same tours. Carts
    without a full offer of every line are left out, as nothing covers them.
    """
    eligible = ranked_offers(lines, offers, target).where(geolocated() & (available_quantity() >= F.col("quantity")))
    offer = F.struct("line_total", "distance", F.col("preparation_minutes").alias("preparation"), "supplier", "agency_key", "supplier_reference", "latitude", "longitude")
    by_line = eligible.groupBy("cart_id", "product_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("pool") == 0, offer))).alias("held"), F.collect_set("agency_key").alias("keys"), F.collect_set("preparation_minutes").alias("limits")
    )
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    carts = by_line.groupBy("cart_id").agg(F.sort_array(F.collect_list(F.when(F.size("held") > 0, F.struct("product_id", "held")))).alias("products"), every("keys"), every("limits"))
    too_many = F.concat(F.lit("cart "), F.col("cart_id"), F.lit(f" has more than {max_agencies} eligible agencies"))
    carts = carts.withColumn("keys", F.when(F.size("keys") > max_agencies, F.raise_error(too_many).cast("array<string>")).otherwise(F.col("keys")))
    asked = lines.groupBy("cart_id").agg(F.count("*").alias("n_lines"), F.first(F.struct("origin_lat", "origin_lon")).alias("origin"))
    carts = carts.hint("merge").join(asked, "cart_id").where(F.size("products") == F.col("n_lines"))
    at = lambda o: F.array_position("keys", o["agency_key"]).cast("int")
    numbered = F.transform("products", lambda p: F.struct(p["product_id"].alias("product_id"), F.transform(p["held"], lambda o, i: o.withField("i", i).withField("bit", F.call_function("shiftleft", F.lit(1), at(o) - 1))).alias("held")))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("products", lambda p: F.transform(p["held"], lambda o: F.struct(at(o).alias("idx"), o["latitude"].alias("latitude"), o["longitude"].alias("longitude")))))))
    origin = F.struct(F.lit(0).alias("idx"), F.col("origin.origin_lat").cast("double").alias("latitude"), F.col("origin.origin_lon").cast("double").alias("longitude"))
    return carts.select("cart_id", "keys", "limits", numbered.alias("products"), F.to_json(F.concat(F.array(origin), places)).alias("site"))


def _plans(lines: DataFrame, offers: DataFrame, target: str, max_agencies: int, params: CostParameters) -> DataFrame:
    """(cart_id, plans): of each cart the different allocations that some agencies and some preparation limit give, with tour and cost.

    A cart's sets and limits are tried within its row, which the agency limit bounds. Tours are found once a site.
    """
    carts = written(_carts(lines, offers, target, max_agencies), "carts")
    point = "array<struct<idx: int, latitude: double, longitude: double>>"
    sites = written(carts.select("site").distinct(), "sites")
    points = written(sites.select("site", F.inline(F.from_json("site", point))), "points")
    tours = best_tours(legs(points, "site"), max_agencies, "site").groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("time", "dist", "ord")))).alias("tours"))

    def pick(p, subset, limit):
        return F.get(F.filter(p["held"], lambda o: (o["bit"].bitwiseAND(subset) != 0) & (o["preparation"] <= limit)), 0)["i"]

    def tried(subset):
        # As texts, which array_distinct tells apart by hashes.
        return F.transform("limits", lambda limit: F.array_join(F.transform("products", lambda p: pick(p, subset, limit).cast("string")), ",", "-"))

    subsets = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("keys")) - 1)
    picks = F.filter(F.array_distinct(F.flatten(F.transform(subsets, tried))), lambda x: ~F.contains(x, F.lit("-")))
    rows = carts.select("cart_id", "keys", "products", "site", picks.alias("picks"))
    # Carts are never the broadcast side; tours are where they are few.
    rows = rows.join(F.broadcast(tours), "site") if sites.count() * 2**max_agencies <= MANY_TOURS else rows.hint("merge").join(tours, "site")

    def chosen(text):
        return F.transform(F.split(text, ","), lambda x, k: F.get("products", k)["held"][x.cast("int")].withField("product_id", F.get("products", k)["product_id"]))

    def told(held):
        each = lambda f: F.transform(held, lambda o: o[f])
        return F.struct(
            F.aggregate(each("line_total"), F.lit(0).cast("decimal(22,2)"), lambda a, x: (a + x).cast("decimal(22,2)")).alias("materials"), F.array_max(each("preparation")).alias("preparation"),
            F.element_at("tours", F.aggregate(each("bit"), F.lit(0), lambda a, x: a.bitwiseOR(x))).alias("tour"), F.size(F.array_distinct(each("supplier"))).cast("long").alias("suppliers"),
            F.array_sort(F.transform(held, lambda o: F.struct(o["product_id"].alias("product_id"), o["agency_key"].alias("agency_key"), o["supplier_reference"].alias("supplier_reference")))).alias("allocation"),
        )

    def shown(x):
        km, travel = ((x["tour"][c] / 100).cast("decimal(12,2)") for c in ("dist", "time"))
        stops = F.size(x["tour"]["ord"])
        return F.struct(
            plan_cost(x["materials"], km, travel, x["preparation"], stops, params).alias("cost"), x["materials"].alias("materials"), stops.alias("stops"), travel.alias("travel"),
            F.transform(x["tour"]["ord"], lambda i: F.element_at("keys", i)).alias("stop_keys"), km.alias("km"), x["preparation"].alias("preparation"), x["allocation"].alias("allocation"), x["suppliers"].alias("suppliers"),
        )

    rows = rows.select("cart_id", "keys", F.transform(F.transform("picks", chosen), told).alias("told"))
    return rows.select("cart_id", F.transform("told", shown).alias("plans"))


def candidates(lines: DataFrame, offers: DataFrame, target: str, max_agencies: int, params: CostParameters) -> DataFrame:
    """Every different allocation that some set of agencies and some preparation limit gives, with tour and cost.

    ``lines``: cart_id, product_id, quantity, origin_lat, origin_lon. A cart with more eligible agencies
    than ``max_agencies`` is an error; none is dropped.
    """
    return _plans(lines, offers, target, max_agencies, params).select("cart_id", F.inline("plans"))


PLAN = ("cart_id", "strategy", "valid", "materials", "cost", "stops", "km", "travel", "preparation", "total_minutes", "stop_keys", "allocation")


def strategies(lines: DataFrame, offers: DataFrame, target: str = "HT", max_agencies: int = 8, params: CostParameters = CostParameters()) -> DataFrame:
    """Three plans for every cart: one stop at the least cost, the least materials, and the least cost of all.

    The least materials may come from a national catalogue, without a tour; a plan with stores takes
    its place unless it costs more. A plan that doesn't exist is a row with valid false. A plan's fields are in
    the order of its rank, and allocations settle what that leaves. Carts meet their plans by merging, as files
    that pack well look small enough to be broadcast and aren't.
    """
    # Fields lead with the rank: cost, materials, stops, travel, stop_keys.
    first = F.array_min("plans")
    found = _plans(lines, offers, target, max_agencies, params).select(
        "cart_id", F.array_min(F.filter("plans", lambda x: x["stops"] == 1)).alias("single"),
        F.array_min(F.transform("plans", lambda x: F.struct(x["materials"].alias("least"), x.alias("x"))))["x"].alias("least"), first.alias("compromise"),
    )
    best = best_lines(lines, offers, target).where("availability = 'available' and available_quantity >= quantity")
    asked = lines.groupBy("cart_id").agg(F.count("*").alias("n_lines"))
    national = best.groupBy("cart_id").agg(
        F.count("*").alias("n"), F.sum("line_total").alias("m"), F.max("preparation_minutes").alias("p"),
        F.array_sort(F.collect_list(F.struct("product_id", "agency_key", "supplier_reference"))).alias("alloc"), F.array_sort(F.collect_set("agency_key")).alias("k"),
    )
    every = asked.hint("merge").join(national.hint("merge"), "cart_id", "left").join(found.hint("merge"), "cart_id", "left")
    whole = F.coalesce(F.col("n") == F.col("n_lines"), F.lit(False))

    def shape(name, x):
        return F.struct(
            F.lit(name).alias("strategy"), x.isNotNull().alias("valid"), x["materials"].alias("materials"), x["cost"].alias("cost"), x["stops"].alias("stops"), x["km"].alias("km"), x["travel"].alias("travel"),
            x["preparation"].alias("preparation"), (x["travel"] + x["preparation"]).cast("decimal(13,2)").alias("total_minutes"), x["stop_keys"].alias("stop_keys"), x["allocation"].alias("allocation"),
        )

    x, none = F.col("least"), lambda t: F.lit(None).cast(t)
    catalogue = F.struct(
        F.lit("minimum_materials").alias("strategy"), F.lit(True).alias("valid"), F.col("m").cast("decimal(22,2)").alias("materials"), F.col("m").cast("decimal(14,2)").alias("cost"), F.size("k").alias("stops"), none("decimal(12,2)").alias("km"),
        none("decimal(12,2)").alias("travel"), F.col("p").alias("preparation"), none("decimal(13,2)").alias("total_minutes"), F.col("k").alias("stop_keys"), F.col("alloc").alias("allocation"),
    )
    minimum = F.when(whole & (x.isNull() | (F.col("m") < x["materials"])), catalogue).otherwise(shape("minimum_materials", x))
    return every.select("cart_id", F.inline(F.array(shape("single_stop", F.col("single")), minimum, shape("best_compromise", F.col("compromise"))))).select(*PLAN)


def minimum_against_single(plans: DataFrame) -> DataFrame:
    """What the least-materials plan saves against one stop; null unless both are valid, zero where one has no tour."""
    side = lambda name, p: plans.where((F.col("strategy") == name) & F.col("valid")).select("cart_id", *(F.col(c).alias(f"{p}_{c}") for c in ("materials", "km", "travel", "total_minutes")))
    both = side("single_stop", "s").join(side("minimum_materials", "m"), "cart_id")
    more = lambda c: F.coalesce(F.col(f"m_{c}") - F.col(f"s_{c}"), F.lit(0)).alias(f"extra_{c}")
    return both.select("cart_id", (F.col("s_materials") - F.col("m_materials")).alias("material_savings"), more("km"), more("travel"), more("total_minutes"))
