"""Synonyms, typed properties, guards and equivalence on small catalogues; matching and arbitration with every outcome."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import equivalence as eq
from tallyforge.operators import resolve


def read(spark, cases, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(cases)), f"i int, s {kind}")
    return [r.v for r in df.select("i", f("s").alias("v")).orderBy("i").collect()]


def test_synonyms_are_added_in_context(spark):
    cases = {
        "Vis TF TX 5x60": "Vis TF TX 5x60 tete fraisee torx", "CP seul": "CP seul", "panneau CP 18 mm": "panneau CP 18 mm contreplaque", "Inox galva": "Inox galva galvanise acier inoxydable",
        "TF": "TF", "": "", None: "",
    }
    assert dict(zip(cases, read(spark, cases, eq.expand_synonyms))) == cases


def test_measures_in_any_unit(spark):
    cases = {"60 mm": 60, "6 cm": 60, "0,06 m": 60, "0.06 m": 60, "sans": None, None: None, "5": 5}
    assert dict(zip(cases, read(spark, cases, eq.measure_mm))) == cases
    assert read(spark, ["2,5", "25"], lambda s: eq.measure_mm(s, True)) == [2500, 25]


def test_typed_properties(spark):
    cases = [
        ({"Longueur de la vis": "6 cm", "Longueur": "9 cm", "Diamètre": "5 mm", "Empreinte": "TX 25", "Matière": "Acier inox A2"}, {"length_mm": "60", "diameter_mm": "5", "drive": "torx", "material": "inox"}),
        ({"Epaisseur en mm": "18", "Largeur": "1,2", "Couleur": "Blanc Cassé"}, {"thickness_mm": "18", "width_mm": "1200", "color": "blanc casse"}),
        ({"Epaisseur": "0,5", "Matière": "Chêne", "Longueur": " "}, {"thickness_mm": "500", "material": "chene"}), ({}, {}), (None, {}),
    ]
    assert read(spark, [c for c, _ in cases], eq.typed_properties, "map<string,string>") == [w for _, w in cases]


def test_overlay_fills_and_tells_contradictions(spark):
    df = spark.createDataFrame([(0, {"length_mm": None, "diameter_mm": "5.0"}, {"length_mm": "60", "diameter_mm": "5", "colour": "x"}), (1, {"length_mm": "50"}, {"length_mm": "60"}), (2, {}, {})], "i int, a map<string,string>, b map<string,string>")
    got = df.select("i", eq.overlay("a", "b", F.array(F.lit("length_mm"), F.lit("diameter_mm"))).alias("o")).orderBy("i").collect()
    assert [(r.o["values"], r.o.sources, r.o.conflict) for r in got] == [
        ({"diameter_mm": "5.0", "length_mm": "60"}, {"diameter_mm": "text", "length_mm": "property"}, False), ({"length_mm": "50"}, {"length_mm": "text"}, True), ({}, {}, False),
    ]


@pytest.mark.parametrize("a, b, keys, want", [
    ({"diameter_mm": "5", "length_mm": "60"}, {"diameter_mm": "5", "length_mm": "70"}, ["diameter_mm", "length_mm"], True), ({"type": "standard"}, {"type": "hydrofuge"}, ["type"], True),
    ({"drive": "torx"}, {"drive": "pozidriv"}, ["drive"], True), ({"length_mm": "60", "drive": "torx"}, {"length_mm": "60"}, ["drive", "head", "finish"], False), ({"packaging_qty": "100"}, {"packaging_qty": "200"}, ["drive", "head"], False),
])
def test_contradictions(spark, a, b, keys, want):
    df = spark.createDataFrame([(a, b)], "a map<string,string>, b map<string,string>")
    assert df.select(eq.attributes_conflict(F.col("a"), F.col("b"), F.array(*map(F.lit, keys))).alias("v")).first().v is want


def test_guards(spark):
    pairs = {
        ("Fenêtre isolation totale 100 mm", "Fenêtre pvc 950x600"): True, ("Raccord femelle 16", "Raccord multicouche 16"): True, ("Disque diamant carrelage 125", "Disque diamant 125"): True,
        ("Vis trompette 3,5 x 25", "Vis plaque de plâtre 3,5 × 25 mm"): False, ("Raccord mâle", "raccord male"): False, (None, None): False,
    }
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    assert [r.v for r in df.select("i", eq.unsupported_variant("a", "b").alias("v")).orderBy("i").collect()] == list(pairs.values())
    df = spark.createDataFrame([(["pvc", "1200x950"], "fenetre 1200x950", "fenetre 1200 x 950", True), (["beige", "1180x1140"], "store beige SK06", "store 1180x1140 beige", False), (["agglo", "5"], "", None, True)], "v array<string>, a string, b string, w boolean")
    assert all(r.v == r.w for r in df.select(eq.identity_grounded(F.col("v"), "a", "b").alias("v"), "w").collect())


TARGETS = [
    (1, "Vis agglo 4 x 40 mm", "Vis agglo 4 x 40 mm", None), (2, "Vis agglo torx 5 x 50 mm", "Vis agglo torx 5 x 50 mm", None), (3, "Vis agglo pozidriv 5 x 50 mm", "Vis agglo pozidriv 5 x 50 mm", None),
    (4, "Panneau OSB 2500 x 1250 x 18 mm", "Panneau OSB 2500 x 1250 x 18 mm", {"thickness_mm": "18.0"}), (5, "Vis agglo 6 x 60 mm", "Vis agglo 6 x 60 mm", None), (6, "Vis agglo 6 x 60 mm bis", "Vis agglo 6 x 60 mm bis", None),
    (7, "Vis agglo 3 x 30 mm", "Vis agglo 3 x 30 mm", None), (1, "Vis agglo 4 x 40 mm", "Vis agglo 4 x 40 mm zinguée", None), (8, "Boulon 8 x 80 mm", "Boulon 8 x 80 mm", None), (9, "Goujon 8 x 80 mm", "Goujon 8 x 80 mm", None),
]
ROWS = [
    (10, "Vis agglo TF 4x40", None, 99, ("linked", "complete", "VIS_AGGLO", 1)), (11, "Vis agglo TX 5x50", {}, 99, ("linked", "strong", "VIS_AGGLO", 2)), (12, "Vis agglo 5x50", None, 99, ("ambiguous", None, None, None)),
    (13, "Vis agglo 5x50", {"Empreinte": "PZ"}, 99, ("linked", "strong", "VIS_AGGLO", 3)), (14, "Vis agglo 4x40", {"Longueur de la vis": "50 mm"}, 99, ("ambiguous", None, None, None)),
    (15, "Vis agglo 6x60", None, 99, ("ambiguous", None, None, None)), (16, "Vis agglo 4x40", {"Longueur": "4 cm"}, 1, ("same", "complete", "VIS_AGGLO", 1)), (17, "Vis agglo 9x90", None, 99, ("none", None, None, None)),
    (18, "Vis agglo 3x30 femelle", None, 99, ("none", None, None, None)), (19, "Dalle OSB L.2500 x l.1250", {"Epaisseur en mm": "18"}, None, ("linked", "complete", "PANNEAU_OSB", 4)),
    (20, None, None, None, ("none", None, None, None)), (21, "Boulon goujon 8 x 80 mm", None, 99, ("ambiguous", None, None, None)), (None, "Vis agglo 4x40", None, 99, ("none", None, None, None)),
]


def test_equivalents(spark):
    index = eq.identity_index(spark.createDataFrame(TARGETS, "product_id long, name string, designation string, attributes map<string,string>"))
    rows = spark.createDataFrame([r[:4] for r in ROWS] + [ROWS[0][:4]], "id long, designation string, properties map<string,string>, product_id long")
    got = [(r.id, (r.outcome, r.level, r.rule, r.product_id)) for r in eq.equivalents(rows, index).collect()]
    assert sorted(got, key=str) == sorted([(r[0], r[4]) for r in ROWS] + [(10, ROWS[0][4])], key=str)
    assert eq.equivalents(rows.limit(0), index).count() == 0 and {r.outcome for r in eq.equivalents(rows, index.limit(0)).collect()} == {"none", "ambiguous"}


def test_matches_and_arbitration_have_every_outcome(spark):
    fast, board, bag = (lambda t, d, n: {"type": t, "diameter_mm": d, "length_mm": n}), (lambda t, x: {"type": t, "length_mm": "2500", "width_mm": "1250", "thickness_mm": x}), (lambda t, w: {"type": t, "weight_kg": w})
    products = [
        (1, "VIS_AGGLO", fast("agglo", "4.00", "40"), {}), (2, "VIS_AGGLO", fast("agglo", "5.00", None), {}), (3, "VIS_AGGLO", fast("agglo", "6.00", "60"), {}), (4, "VIS_AGGLO", fast("agglo", "6.00", "60"), {}),
        (5, "PANNEAU_OSB", board("osb", "18"), {"hydrofuge": "true"}), (6, "PANNEAU_OSB", board(None, "12"), {}), (7, "PANNEAU_OSB", board("autre", "9"), {}), (8, "BOULON", fast("boulon", "4.00", "40"), {}),
        (9, "CIMENT", bag("ciment", None), {}), (9, "CIMENT", bag("ciment", None), {}), (10, "PANNEAU_OSB", board("osb", None), {}), (11, "VIS_AGGLO", fast("agglo", "7.00", "70"), {"hydrofuge": "false"}),
    ]
    rows = [
        (1, "VIS_AGGLO", fast("agglo", "4.00", "40"), {}), (2, "VIS_AGGLO", fast("agglo", "5.00", "50"), {}), (3, "VIS_AGGLO", fast("agglo", "6.00", "60"), {}), (4, "VIS_AGGLO", fast("agglo", "6.00", None), {}),
        (5, "VIS_AGGLO", fast("agglo", "8.00", "80"), {}), (6, "PANNEAU_OSB", board("osb", "18"), {}), (7, "PANNEAU_OSB", board("osb", "18"), {"hydrofuge": "false"}), (8, "PANNEAU_OSB", board("osb", "12"), {}),
        (9, "PANNEAU_OSB", board("osb", "9"), {}), (10, "PANNEAU_OSB", board(None, "18"), {}), (11, "PANNEAU_OSB", board("osb", None), {}), (12, "CIMENT", bag("ciment", "25.000"), {}),
        (13, "VIS_AGGLO", fast("agglo", "4.00", "40"), {}), (13, "BOULON", fast("boulon", "4.00", "40"), {}), (14, "VIS_AGGLO", fast("agglo", "4.00", "40"), {}), (14, "BOULON", fast("boulon", "9.00", "90"), {}),
        (15, "VIS_AGGLO", fast("agglo", "4.00", "99"), {}), (16, "VIS_AGGLO", fast("agglo", "7.00", "70"), {"hydrofuge": "true"}), (None, "VIS_AGGLO", fast("agglo", "4.00", "40"), {}),
    ]
    schema = "rule string, identity map<string,string>, attributes map<string,string>"
    found = resolve.match(spark.createDataFrame(rows, f"id long, {schema}"), spark.createDataFrame(products, f"product_id long, {schema}"))
    assert {(r.id, r.rule): (r.status, r.product_id, r.score, r.reason) for r in found.collect()} == {
        (1, "VIS_AGGLO"): ("EXACT", 1, 1.0, "EXACT"), (2, "VIS_AGGLO"): ("REVIEW", 2, 0.3, "REVIEW"), (3, "VIS_AGGLO"): ("REVIEW", 3, 0.7, "AMBIGUOUS"), (4, "VIS_AGGLO"): ("UNMAPPED", None, 0.0, "INSUFFICIENT_DATA"),
        (5, "VIS_AGGLO"): ("UNMAPPED", None, 0.0, "NO_PRODUCT"), (6, "PANNEAU_OSB"): ("EXACT", 5, 1.0, "EXACT"), (7, "PANNEAU_OSB"): ("REVIEW", 5, 0.2, "REVIEW"), (8, "PANNEAU_OSB"): ("REVIEW", 6, 0.55, "REVIEW"),
        (9, "PANNEAU_OSB"): ("UNMAPPED", None, 0.0, "NO_PRODUCT"), (10, "PANNEAU_OSB"): ("REVIEW", 5, 0.55, "REVIEW"), (11, "PANNEAU_OSB"): ("UNMAPPED", None, 0.0, "INSUFFICIENT_DATA"), (12, "CIMENT"): ("REVIEW", 9, 0.3, "REVIEW"),
        (13, "VIS_AGGLO"): ("EXACT", 1, 1.0, "EXACT"), (13, "BOULON"): ("EXACT", 8, 1.0, "EXACT"), (14, "VIS_AGGLO"): ("EXACT", 1, 1.0, "EXACT"), (14, "BOULON"): ("UNMAPPED", None, 0.0, "NO_PRODUCT"),
        (15, "VIS_AGGLO"): ("UNMAPPED", None, 0.0, "NO_PRODUCT"), (16, "VIS_AGGLO"): ("EXACT", 11, 1.0, "EXACT"), (None, "VIS_AGGLO"): ("EXACT", 1, 1.0, "EXACT"),
    }
    done = {r.id: (r.outcome, r.product_id) for r in resolve.arbitrate(found).collect()}
    assert done[13] == ("RULES_DISAGREE", None) and done[14] == ("EXACT", 1) and done[3] == ("AMBIGUOUS", 3) and done[5] == ("NO_PRODUCT", None) and done[2] == ("REVIEW", 2) and done[11] == ("INSUFFICIENT_DATA", None)
    references = spark.createDataFrame([(1, 77, "3401234567890", "a", "r1"), (2, None, "34 01234 567890", "a", "r2"), (13, None, None, "Vis  DOUBLE", "r3"), (14, None, "12345678", "b", "r4"), (99, None, "1", "vis double", "r5"), (98, None, None, None, "r6")], "sp_id long, product_id long, ean string, designation string, supplier_reference string")
    owners = spark.createDataFrame([("3401234567890", 50), ("3401234567890", 50), ("12345678", 60), ("12345678", 61)], "ean string, product_id long")
    mapped = {r.sp_id: (r.product_id, r.source, r.code) for r in resolve.map_in_order(references, owners, resolve.arbitrate(found)).collect()}
    assert {k: v[:2] for k, v in mapped.items()} == {1: (77, "kept"), 2: (50, "ean"), 13: (None, "specific"), 14: (1, "exact_rule"), 99: (None, "specific"), 98: (None, "specific")}
    assert mapped[13][2] == mapped[99][2] != mapped[98][2] and mapped[14][2] is None
