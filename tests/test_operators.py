"""Operators on small inputs: published figures, brute force, nulls, ties, repeated rows and empty tables."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge import session
from tallyforge.functions import feeds_text
from tallyforge.operators import administration as admin
from tallyforge.operators import optimize
from tallyforge.operators.components import connected_components
from tallyforge.sources import demo


def test_plans_of_the_published_cart(spark):
    lines = [(1, p, Decimal(q), *demo.ORIGIN) for p, q in ((1, 30), (2, 10), (3, 20))]
    cart = spark.createDataFrame(lines, "cart_id long, product_id int, quantity decimal(10,3), origin_lat double, origin_lon double")
    got = {r.strategy: (float(r.materials), float(r.cost), r.stops, float(r.km), float(r.travel)) for r in optimize.strategies(cart, demo.offers(spark)).collect()}
    assert got == {
        "single_stop": (380.20, 484.80, 1, 13.80, 45.40), "minimum_materials": (375.40, 489.07, 2, 15.33, 51.99), "best_compromise": (377.40, 479.36, 3, 21.48, 72.44),
    }


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges + edges[:50], "a long, b long")
    assert {r.vertex: r.component for r in connected_components(df).collect()} == {v: find(v) for v in list(parent)}
    assert connected_components(df.limit(0)).count() == 0


def test_mapping_requests_and_flags(spark):
    sp = spark.createDataFrame([(1, None, True), (2, 10, True), (3, 10, None), (4, 11, False)], "sp_id long, product_id long, active boolean")
    products = spark.createDataFrame([(10,), (11,), (11,)], "product_id long")
    asked = spark.createDataFrame([(1, 10, None), (2, 11, False), (3, None, True), (4, 11, True), (9, 10, True), (None, 10, True)], "sp_id long, wanted long, confirmed boolean")
    got = {r.sp_id: (r.product_id, r.outcome) for r in admin.map_references(sp, products, asked).collect()}
    assert got == {1: (10, "mapped"), 2: (10, "needs_confirmation"), 3: (None, "unmapped"), 4: (11, "same"), 9: (None, "unknown_reference"), None: (None, "unknown_reference")}
    assert admin.map_references(sp, products, asked.limit(0)).count() == 0
    off = admin.set_flag(sp, spark.createDataFrame([(2,), (2,), (None,)], "sp_id long"), "sp_id", "active", False)
    assert [tuple(r) for r in off.orderBy("sp_id").collect()] == [(1, None, True), (2, 10, False), (3, 10, None), (4, 11, False)]


def test_new_products_and_units(spark):
    known = spark.createDataFrame([(1, "A", "kg"), (2, "B", None)], "product_id long, code string, reference_unit string")
    asked = spark.createDataFrame([(1, "A", "x", "kg"), (2, "C", "x", None), (3, "C", "x", "kg"), (4, " ", "x", "kg"), (5, None, "x", "kg"), (6, "D", None, "Kilo")], "request_no int, code string, name string, unit string")
    got = {r.request_no: r.outcome for r in admin.create_products(asked, known, ("kg",)).collect()}
    assert got == {1: "duplicate_code", 2: "bad_unit", 3: "duplicate_code", 4: "no_code", 5: "no_code", 6: "created"}
    used = spark.createDataFrame([(7, 1), (7, 1), (8, 1)], "project_id long, product_id long")
    assert {tuple(r) for r in admin.product_usage(known, used).collect()} == {(1, 2, False), (2, 0, True)}
    units = spark.createDataFrame([(1, "m"), (2, "ml"), (9, "m")], "product_id long, unit string")
    assert {tuple(r) for r in admin.change_units(known, units, used).collect()} == {(1, "kg", "in_use"), (2, "m", "changed"), (9, None, "unknown")}


def test_specific_products_and_audit(spark):
    sp = spark.createDataFrame([(1, None, "Béton  gris", "r1"), (2, None, "BETON GRIS", "r2"), (3, None, None, "r3"), (4, None, " ", None), (5, 9, "Béton gris", "r5")], "sp_id long, product_id long, designation string, supplier_reference string")
    got = {r.designation_key: (r.name, r.references) for r in admin.specific_products(sp, "S").collect()}
    assert got == {"beton gris": ("Béton  gris", 2), "sku:r3": (None, 1), "sku:4": (" ", 1)}
    assert admin.specific_products(sp.limit(0), "S").count() == 0
    kind = "id int, reason string, identity map<string,string>, target map<string,string>"
    claims = spark.createDataFrame([(1, "EXACT", {"d": "5", "t": "Béton"}, {"d": "5.0", "t": "beton"}), (2, "EXACT", {"d": "5"}, {"d": "6"}), (3, "EXACT", {"d": None}, {"d": None}), (4, "HIGH", {"d": "1"}, {"d": "2"}), (5, "EXACT", None, {"d": "2"})], kind)
    assert [(r.id, r.key) for r in admin.audit_exact(claims, ["d"]).orderBy("id").collect()] == [(2, "d"), (3, "d"), (5, "d")]


def test_ties_of_hits_families_and_legs(spark):
    hits = spark.createDataFrame([("a", None, "longest name"), ("a", "1", "b"), ("a", "2", "a"), ("b", None, None)], "k string, ean string, name string")
    assert {(r.k, r.ean, r.name) for r in admin.preferred_hits(hits, "k").collect()} == {("a", "2", "a"), ("b", None, None)}
    fams = spark.createDataFrame([(2, "f", 5), (1, "f", 5), (3, None, 1)], "id int, family string, size int")
    assert {r.id for r in admin.largest_families(fams, ["family"]).collect()} == {1, 3}
    legs = spark.createDataFrame([(1, [("", 3, 5.0), ("db:3", None, 7.0), (None, None, 1.0), ("x", None, None)]), (2, None), (3, [])], "project_id int, legs array<struct<end_key:string,end_id:int,minutes:double>>")
    assert [tuple(r) for r in admin.leg_minutes(legs).collect()] == [(1, "db:3", 7.0)]
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    s = spark.createDataFrame([("x", False), ("y", False), ("y", True)], "supplier string, active boolean")
    assert {tuple(r) for r in admin.participates(s, names).collect()} == {("x", False), ("y", True), ("z", True)}


def test_payload_functions(spark):
    said = [("Disponible", None, "AVAILABLE"), ("Sous 5 jours", None, "DELAYED"), ("Sur commande", None, "ORDER_ONLY"), ("", None, "UNAVAILABLE"), (None, None, "UNAVAILABLE"), ("disponible", False, "UNAVAILABLE")]
    df = spark.createDataFrame(said, "label string, ok boolean, want string")
    assert df.where(feeds_text.availability_state(F.lit(None).cast("boolean"), F.col("ok"), F.col("label")) != F.col("want")).count() == 0
    keys = [('{"a": {"My_Password": 1}}', True), ('{"a": "password"}', False), ("", False)]
    assert [r.x for r in spark.createDataFrame(keys, "p string, want boolean").select((feeds_text.has_sensitive_key(F.col("p")) == F.col("want")).alias("x")).collect()] == [True] * 3
    tokens = [("1:2:db:7", (1, 2, "db:7")), ("1:2", None), (None, None), ("x:1:y", None)]
    got = spark.createDataFrame([(t,) for t, _ in tokens], "t string").select(feeds_text.token_parts(F.col("t")).alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in got] == [w for _, w in tokens]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(type("S", (), {"sparkContext": Context()})())


def test_scratch_tables_go(spark):
    import os

    with session.scratch(spark) as top:
        held = session.written(spark.range(5), "x")
        assert held.count() == 5
    assert not os.path.exists(top.removeprefix("file:"))


def test_shuffle_files_of_a_query_go_with_it_inside_scratch(spark):
    """pipeline, check_h: the near-duplicate stage held the shuffle files of all its queries until it ended."""
    import os

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirs() for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}
    counted = lambda k: spark.range(1000).groupBy((F.col("id") % k).alias("k")).count()
    before, had = spark.conf.get(setting), files()
    with session.scratch(spark):
        assert session.written(counted(7), "x").count() == 7
        assert counted(11).agg(F.sum("count")).first()[0] == 1000
        held = counted(13).checkpoint()
        assert connected_components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")).count() == 5
        assert files() <= had
    assert held.count() == 13 and spark.conf.get(setting) == before
