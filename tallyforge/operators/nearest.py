"""The k nearest places of each point: a join by grid cells in widening rings, exact by the rings' bound."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.geo import EARTH_KM, haversine_km
from tallyforge.session import ensure_checkpoint_dir

#: Kilometres of a degree on the sphere that distances are taken on.
DEGREE_KM = math.pi * EARTH_KM / 180
#: Cells are 360 / 2**level degrees wide. The search starts on the coarsest level on which no cell has more than CROWD
#: places, or on the finest, and goes on to coarser ones.
COARSEST, FINEST, CROWD = 2, 18, 64


def _first_level(places: DataFrame) -> int:
    """One number for each level leaves the executors."""
    cell = lambda c, off: F.floor((F.col(c) + off) * F.pow(F.lit(2.0), F.col("level")) / 360).cast("long")
    levels = places.select("latitude", "longitude", F.explode(F.sequence(F.lit(COARSEST), F.lit(FINEST))).alias("level"))
    most = levels.groupBy("level", cell("latitude", 90), cell("longitude", 180)).agg(F.count("*").alias("n")).groupBy("level").agg(F.max("n").alias("n"))
    return most.where(F.col("n") <= CROWD).agg(F.min("level")).first()[0] or FINEST


def nearest_places(points: DataFrame, places: DataFrame, k: int, place_id: str = "agency_id", level: int | None = None) -> DataFrame:
    """(point_id, place, rank, distance_km): the ``k`` nearest places of every point by great-circle distance, ties by id.

    ``points``: point_id, p_lat, p_lon; ``places``: an id, latitude, longitude, in degrees. Points and places without
    coordinates take no part; with fewer than k places, all are returned. Points of one place are searched once.

    In each round a point meets the places of its own cell and the eight around it. A place outside them is farther off
    than a cell, in latitude or along the shortest way to the meridian a cell away, so a point whose k-th candidate is
    nearer than both is done. The others go on with cells of twice the size, in at most FINEST - COARSEST + 1 rounds, each
    an equi-join of cells; a task keeps the k nearest it has seen of a point. Longitudes wrap around. Points with fewer
    than k places within a quarter of the globe meet all places in the end, dealt over all tasks. What is left after a round is
    checkpointed, so that a lost executor repeats a round.
    """
    spark = points.sparkSession
    ensure_checkpoint_dir(spark)
    placed = places.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.col(place_id).alias("place"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    # Of the places at one spot only the k with the smallest ids can be among the nearest.
    spot = Window.partitionBy("latitude", "longitude").orderBy("place")
    placed = placed.withColumn("r", F.row_number().over(spot)).where(F.col("r") <= k).drop("r").checkpoint()
    enough = min(k, placed.count())
    asked = points.where("p_lat IS NOT NULL AND p_lon IS NOT NULL").select("point_id", F.col("p_lat").cast("double").alias("p_lat"), F.col("p_lon").cast("double").alias("p_lon"))
    left = asked.select("p_lat", "p_lon").distinct().checkpoint()
    order = Window.partitionBy("p_lat", "p_lon").orderBy("distance_km", "place")

    def ranked(pairs: DataFrame) -> DataFrame:
        near = pairs.select("p_lat", "p_lon", "place", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("latitude"), F.col("longitude")).alias("distance_km"))
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return near.groupBy("p_lat", "p_lon").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "distance_km"))).alias("near"))

    done = None
    for at in range(_first_level(placed) if level is None else level, COARSEST - 1, -1):
        size, columns = 360 / 2**at, 2**at
        y, x = (lambda c, off: F.floor((F.col(c) + off) / size).cast("long")), F.array(*(F.lit(d) for d in (-1, 0, 1)))
        cells = left.select("p_lat", "p_lon", F.explode(F.transform(x, lambda d: y("p_lat", 90) + d)).alias("y"), y("p_lon", 180).alias("cx"))
        cells = cells.select("p_lat", "p_lon", "y", F.explode(F.array_distinct(F.transform(x, lambda d: F.pmod(F.col("cx") + d, F.lit(columns))))).alias("x"))
        best = ranked(cells.join(placed.withColumn("y", y("latitude", 90)).withColumn("x", F.pmod(y("longitude", 180), F.lit(columns))), ["y", "x"]))
        across = F.degrees(F.asin(F.cos(F.radians("p_lat")) * math.sin(math.radians(min(size, 90)))))
        reach = F.least(F.lit(float(size)), across) * (DEGREE_KM * (1 - 1e-9))
        found = best.where((F.size("near") >= enough) & (F.element_at("near", -1)["distance_km"] < reach)).checkpoint()
        done = found if done is None else done.unionByName(found)
        left = left.join(found.select("p_lat", "p_lon"), ["p_lat", "p_lon"], "left_anti").checkpoint()
        if left.isEmpty():
            break
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        every = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        last = ranked(left.withColumn("part", F.pmod(F.hash("p_lat", "p_lon"), F.lit(parts))).join(every, "part"))
        done = last if done is None else done.unionByName(last)
    rows = asked.join(done, ["p_lat", "p_lon"]).select("point_id", F.explode("near").alias("n"))
    return rows.select("point_id", F.col("n.place").alias(place_id), F.col("n.rank").alias("rank"), F.col("n.distance_km").alias("distance_km"))
