"""Nearest places by widening rings against all distances."""

import math
import random

import pytest

from tallyforge.operators.nearest import nearest_places

POINTS, PLACES = "point_id long, p_lat double, p_lon double", "agency_id long, latitude double, longitude double"


def km(a, b):
    (p, q), (r, s) = a, b
    h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def brute(points, places, k):
    out = []
    for i, *p in points:
        if None not in p:
            near = sorted((km(p, q), j) for j, *q in places if None not in q)[:k]
            out += [(i, j, n + 1, round(d, 6)) for n, (d, j) in enumerate(near)]
    return sorted(out)


def spread(seed):
    rng = random.Random(seed)
    town = [(rng.gauss(48.85, 0.02), rng.gauss(2.35, 0.02)) for _ in range(120)]
    globe = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(60)]
    edges = [(10.0, 179.99), (10.0, -179.99), (10.1, 180.0), (89.9, 5.0), (89.9, -175.0), (-90.0, 0.0), (90.0, 0.0), (0.0, 0.0), (22.5, 45.0), (22.5, 45.0), (22.5, 44.9999)]
    return town + globe + edges + [(48.0, None), (None, 2.0)]


@pytest.mark.parametrize("seed, k, level", [(1, 3, None), (3, 5, 4)])
def test_rings_find_the_nearest(spark, seed, k, level):
    places = [(100 + i, *p) for i, p in enumerate(spread(seed))]
    points = [(i, *p) for i, p in enumerate(spread(seed + 50) + spread(seed)[-13:])]
    got = nearest_places(spark.createDataFrame(points + points[:2], POINTS), spark.createDataFrame(places, PLACES), k, level=level)
    assert sorted((r.point_id, r.agency_id, r["rank"], round(r.distance_km, 6)) for r in got.collect()) == brute(points + points[:2], places, k)


def test_few_and_equal_places(spark):
    points = [(1, 0.0, 0.0), (2, -45.0, 170.0), (3, None, 1.0)]
    places = [(9, 5.0, 5.0), (7, 5.0, 5.0), (8, 5.0, 5.0), (6, -60.0, -170.0)]
    frames = spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES)
    for k in (2, 6):
        got = nearest_places(*frames, k)
        assert sorted((r.point_id, r.agency_id, r["rank"], round(r.distance_km, 6)) for r in got.collect()) == brute(points, places, k)
    assert nearest_places(frames[0].limit(0), frames[1], 2).count() == 0 and nearest_places(frames[0], frames[1].limit(0), 2).count() == 0
