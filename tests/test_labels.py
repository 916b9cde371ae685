"""Labels as suppliers write them: folding, counts, profiles, sizes and categories."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import live, resolve

ODD = ["й", "㎡ ㎜", "ĳ ﬃ", "① ½ ™ …", "ｶﾞ Ａ", "한국 값", "Éœ Øß", "İ", "é", "ǆ", "𝐀𝟙", "क़ ด้ำ", "بِسم ﷺ", "", None]


def test_fold_is_nfkd_without_marks(spark):
    def plain(s):
        return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()

    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")
    assert {r.i: r.f for r in df.select("i", text.fold("s").alias("f")).collect()} == {i: plain(s) for i, s in enumerate(ODD)}


def read(spark, labels, f):
    df = spark.createDataFrame(list(enumerate(labels)), "i int, s string")
    return [r.v for r in df.select("i", f("s").alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("f, cases", [
    (text.piece_count, {"Vis 1 000 pieces": 1000, "Pack 50 vis": 50, "Botte 10 tasseaux": 10, "Boite 200 vis": 200, "Vis bois x 50": None, "Sac 5 kg": None, "Boîte de 2 kg de vis": None,
                        "Seau de 1000 vis - 1 000 pièces": 1000, "Lot de 2000 pcs": 2000, "": None, None: None}),
    (text.lot_quantity, {"Lot de 10": 10, "Lot de 1001": None, "Sachet 25 vis": 25, "12 pièces": None, None: None}),
    (text.profile_code, {"Rail R48 3 m": "R48", "Montant M4835": "M48", "Rail de 48": "R48", "Montant 70": "M70", "Fourrure galvanisée 45": "F45", "Boulon M12": None, "Rail de 60": None, None: None}),
    (text.bar_profile, {"Fer à béton Ø 10 mm": "D10", "Rond acier 6,5 mm 2 m": "D6,5", "Rond Ø 50 mm": None, None: None}),
    (text.tube_profile, {"Tube rond acier 20 x 1,5 mm": "20X1,5", "Tube 20 x 30 mm": None, None: None}),
    (text.angle_profile, {"Cornière PVC gris alu 30 x 20 mm": "20X30_gris_alu", "Cornière PVC adhésive l. 30 mm x H. 30 mm noire": "30X30_noir_ADH", "Cornière PVC 20 x 20 mm": None, None: None}),
    (text.http_url, {" https://a.fr/b c ": "https://a.fr/b c", "HTTP://x": "HTTP://x", "http:///x": None, "javascript:alert(1)": None, "https://a/" + "b" * 500: None, None: None}),
])
def test_readings(spark, f, cases):
    assert dict(zip(cases, read(spark, list(cases), f))) == cases


def test_sizes_of_screws(spark):
    cases = {"Vis 3,5X25 mm": (3.5, 25), "Vis Ø 3,5 x 45 mm": (3.5, 45), "Vis 4.8 × 140 mm": (4.8, 140), "Cheville nylon 12 x 60 mm": None, "Vis 3,5 x 250 mm": None, "Vis 3,5 x 8 mm": None,
             "Vis TTPC 45 8 x 45 mm": (8.0, 45), "VIS PLAQ PLATRE TTPC 25 BTE1500x": None, "Vis 12 x 60, 4 x 30": (4.0, 30), "Vis 3,5 mm x 9,5 mm": (3.5, 10)}
    got = read(spark, list(cases), text.diameter_length)
    assert {k: v and (float(v.diameter_mm), v.length_mm) for k, v in zip(cases, got)} == cases


def test_categories(spark):
    cases = {
        "Visseuse à placo 600 W": None, "Lot de 25 chevilles nylon autoforeuses avec vis L. 30 mm": None, "6 VIS BÉTON 7.5X152": "VIS_BETON", "Vis terrasse bois inox 5 x 60 mm": "VIS_BOIS",
        "Vis agglo tête fraisée 4 x 40 mm": "VIS_AGGLO", "Boulon TRCC 8 x 60 mm": "BOULON", "Vis multi-usage 4 x 30 mm": "VIS_MULTI", "Rail R48 galvanisé 3 m": "OSSATURE_RAIL", "Vis plaque de pâtre noir - 4,2 X 90 mm": "VIS_PLACO",
        "Vis métaux bardage 5 x 40": None, "Vis cadre mécanique 5x50": None, "Cheville DuoPower 8 x 40": "CHEVILLE_NYLON", "Boulons poêliers 6 x 40": "BOULON", "Boîte d'assortiment de cheville à expansion et vis DuoPower": None,
        "Fer à béton torsadé Ø 8 mm": "FER_BETON", "Chant MDF": None, "Panneau MDF 1220 x 610 x 10 mm": "PANNEAU_MDF", "Medium brut": None, "Panneau CP okoumé": "PANNEAU_CP", "Contreplaqué okoumé": None, "Panneau de particules": "PANNEAU_AGGLO", "Porte OSB": None, "Dalle OSB 3": "PANNEAU_OSB", "Tube rond acier blanc": None, "": None, None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, designation string")
    got = [r.rule for r in resolve.extract(df).orderBy("i").collect()]
    assert dict(zip(cases, got)) == cases
    assert resolve.extract(df.limit(0)).count() == 0


def test_updates_of_one_moment_are_told_apart(spark):
    rows = [("c", "s", "r", 2.0, None, 1, 5, 1), ("c", "s", "r", 3.0, None, 1, 4, 1), ("c", "s", "q", None, None, 2, None, 2)]
    df = spark.createDataFrame(rows, "connector string, store string, supplier_reference string, price_ht double, price_ttc double, price_fetched_at int, stock int, stock_fetched_at int")
    more = {"price_expires_at": F.lit(9), "stock_expires_at": F.lit(9), "is_salable": F.lit(True), "is_offer_available": F.lit(True)}
    got = {r.supplier_reference: (r.price_ht, r.stock) for r in live.latest_offers(df.withColumns(more)).collect()}
    assert got == {"r": (3.0, 5), "q": (None, None)}
