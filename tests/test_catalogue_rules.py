"""Catalogue categories on labels as suppliers write them."""

import pytest

from tallyforge.operators import catalogue_rules as rules
from tallyforge.operators import resolve

# Label, category and identity; labels of several categories stand once for each.
CASES = [
    ("Carrelage sol intérieur grès cérame émaillé beige aspect pierre ROMA 31 x 62 cm", "CAT_CARRELAGE", dict(usage="sol", material="gres", decor="roma", color="pierre", finish="std", format="620x310")),
    ("Carrelage sol extérieur anthracite effet bois 60 x 60 cm", "CAT_CARRELAGE", dict(usage="sol_ext", material="carrelage", decor="bois", color="anthracite", finish="std", format="600x600")),
    ('Sol stratifié aspect chêne "Feticeira" L. 128,5 x l. 28 cm x Ép. 8 mm', "CAT_STRATIFIE", dict(decor="feticeira", format="1285x280x8", usage="sol")),
    ('Peinture mat mur et plafond blanc pur "Valspar pro" - pot 10 L', "CAT_LIQUIDE", dict(kind="peinture", usage="mur_plafond", finish="mat", color="blanc_pur", volume="10l", gamme="valspar pro")),
    ("Lasure chêne clair satinée 2,50 L", "CAT_LIQUIDE", dict(kind="lasure", usage="bois", finish="satin", color="chene_clair", volume="2.5l", gamme="std")),
    ("Peinture en spray RAL 400 ml", "CAT_LIQUIDE", dict(kind="peinture", usage=None, finish="aerosol", color=None, volume="400ml", gamme="ral")),
    ("Coude égal bicône à bague laiton pour tube cuivre Ø14", "CAT_RACCORD", dict(kind="coude", material="cuivre", diameter_mm="14", thread="nr", system="bicone")),
    ("Coude à souder pour tube cuivre Ø14", "CAT_RACCORD", dict(kind="coude", material="cuivre", diameter_mm="14", thread="nr", system="souder")),
    ("Raccord à sertir 20/27", "CAT_RACCORD", dict(kind="raccord", material="multicouche", diameter_mm="20_27", thread="20_27", system="sertir")),
    ("Câble R2V 3G1,5 mm² noir - 100 m", "CABLE_ELEC", dict(kind="r2v", section_mm2="1.5", conductors="3", length_m="100", color="noir")),
    ("Fil électrique H07VU 1,5 mm² bleu - 100 m", "CABLE_ELEC", dict(kind="h07vu", section_mm2="1.5", conductors="1", length_m="100", color="bleu")),
    ("Fil H07VU 1,5 mm² vert/jaune 100 m", "CABLE_ELEC", dict(kind="h07vu", section_mm2="1.5", conductors="1", length_m="100", color="vert_jaune")),
    ("Câble H05 VVF 3 x 2,5 mm² blanc - 10 m", "CABLE_ELEC", dict(kind="h05vvf", section_mm2="2.5", conductors="3", length_m="10", color="blanc")),
    ("Fil H07VU 1,5 mm² vert/jaune/rouge/bleu 100 m", "CABLE_ELEC", dict.fromkeys(("kind", "section_mm2", "conductors", "length_m", "color"))),
    ("Câble R2V 3G1,5 mm² 100 m", "CABLE_ELEC", dict.fromkeys(("kind", "section_mm2", "conductors", "length_m", "color"))),
    ("Bloc béton cellulaire L. 62,5 x l. 25 x Ép. 20 cm", "BETON_CELLULAIRE", dict(length_mm=None, width_mm=None, thickness_mm=None, type="bloc")),
    ("Carreau béton cellulaire 62,5 x 25 x 7 cm", "BETON_CELLULAIRE", dict(length_mm="625", width_mm="250", thickness_mm="70", type="carreau")),
    ("Parpaing creux 20 cm 20 cm 50 cm", "PARPAING", dict(length_mm="500", width_mm="200", thickness_mm="200", type="creux")),
    ("Parpaing d'angle 5 x 5 x 5 cm", "PARPAING", dict(length_mm=None, width_mm=None, thickness_mm=None, type="angle")),
    ("Panneau polystyrène extrudé 125 cm 60 cm 3 cm", "POLYSTYRENE_XPS", dict(length_mm="1250", width_mm="600", thickness_mm="30", type="xps")),
    ("Granulés de bois sac 15 kg", "GRANULE_BOIS", dict(type="granule_bois", weight_kg="15")), ("Granulés de bois 15 kg x 72, 1080 kg", "GRANULE_BOIS", dict(type="granule_bois", weight_kg=None)),
    ("Ciment CEM II 32,5 R 35 kg", "CIMENT_CEM2", dict(type="ciment_cem2_325", weight_kg="35")),
    ("Plinthe chêne clair L. 240 x l. 8 cm", "CAT_PLINTHE", dict(decor="chene_clair", material="bois", format="2400x80")),
    ("Lot de 6 lames terrasse composite gris 15 x 240 cm", "CAT_LAME", dict(kind="terrasse", material="composite", color="gris", format="2400x150")),
    ("Plan de travail stratifié noir 65 x 300 cm", "CAT_PLAN", dict(material="stratifie", decor="noir", format="3000x650")),
    ("Rouleau laine de verre R : 5,0 ép. 200 mm 120 x 450 cm", "CAT_LAINE", dict(material="verre", thickness_mm="200", form="rouleau", r_value="5", format="4500x1200")),
    ("Panneau 3 plis 50 x 200 cm", "CAT_PANNEAU", dict(kind="bois", format="2000x500")), ("Panneau sandwich toiture 100 x 300 cm", "CAT_PANNEAU", dict(kind="sandwich", format="3000x1000")),
    ("Tasseau sapin autoclave 38 x 63 mm - 2,40 m", "CAT_BOIS", dict(kind="tasseau", essence="pin_autoclave", section="63x38", length="2.4m")),
    ("Enduit de rebouchage poudre 5 kg", "CAT_ENDUIT", dict(fonction="rebouchage", form="poudre", poids="5kg")), ("Mortier réfractaire 1,500 kg", "CAT_MORTIER", dict(kind="refractaire", poids="1.5kg")),
    ("Colle néoprène 750 g", "CAT_COLLE", dict(kind="neoprene", quantite="750g")), ("Joint silicone blanc 310 ml", "CAT_JOINT", dict(kind="silicone", color="blanc", quantite="310ml")),
    ("Bloc-porte isoplane 83 cm poussant gauche", "CAT_BLOC_PORTE", dict(kind="isoplane", width_cm="83", sens="gauche", color="nr")), ("Fenêtre PVC oscillo-battante blanche 115 x 100 cm", "CAT_FENETRE", dict(material="pvc", opening="oscillo_battant", format="1150x1000", color="blanc")),
    ("Store occultant beige 78 x 98 cm", "CAT_STORE", dict(kind="store", format="980x780", color="beige")), ("Poignée de porte inox BERLIN entraxe 195", "CAT_POIGNEE", dict(kind="porte", finish="inox", entraxe="195", modele="berlin")),
    ("Serrure 3 points à larder 50 x 70 droite", "CAT_SERRURE", dict(kind="3_points", axe="50x70", sens="droit")), ("Cadenas laiton 40 mm", "CAT_SERRURE", dict(kind="cadenas", axe="40", sens="nr")),
    ("Mitigeur lavabo chromé TENERIFE", "CAT_MITIGEUR", dict(usage="lavabo", finish="chrome", modele="tenerife")), ("Receveur blanc 90 x 90 cm", "CAT_SANITAIRE", dict(kind="receveur", modele="std", color="blanc", format="900x900")),
    ("Pack WC SIRENA", "CAT_SANITAIRE", dict(kind="wc", modele="sirena", color="nr", format="nr")), ("Radiateur inertie blanc 1500 W ALTEA", "CAT_RADIATEUR", dict(kind="inertie", power_w="1500", color="blanc", modele="altea", format="nr")),
    ("Tube PER diam. 16 mm 25 m", "CAT_TUBE", dict(material="per", diameter_mm="16", length="25m")), ("Prise Odace encastrée blanc", "CAT_APPAREILLAGE", dict(gamme="odace", kind="prise", pose="encastre", color="blanc")),
    ("Foret béton 6 x 110 mm", "CAT_FORET", dict(material="beton", format="110x6")), ("Spot LED blanc 50 W", "CAT_LUMINAIRE", dict(kind="spot", power_w="50", color="blanc", format="nr", modele="std")),
    ("Meuble bas CARAT blanc brillant l. 60 x h. 70 x p. 56 cm", "CAT_MEUBLE", dict(kind="bas", collection="carat", color="blanc", finish="brillant", format="L600xH700xP560")), ("Façade CARAT gris 60 x 70 cm", "CAT_FACADE", dict(kind="facade", collection="carat", color="gris", finish="nr", format="700x600")),
    ("Kit douche MALTE", "CAT_KIT", dict(kind="douche", modele="malte", format="nr", color="nr")), ("Porte coulissante miel LOFT 250 x 92 cm", "CAT_PORTE_RANG", dict(kind="coulissante", collection="loft", color="miel", format="2500x920")),
    ("Équerre de charge 15 x 20 cm", "CAT_EQUERRE", dict(kind="charge", format="200x150")), ("Disque diamant Ø 125 mm", "CAT_DISQUE", dict(material="diamant", diameter_mm="125")),
    ("Câble HIFI 2x1,5 mm² 10 m", None, None), ("Carrelage : croisillon 3 mm", None, None), ("Pistolet à colle", None, None), (None, None, None), ("", None, None),
]


@pytest.fixture(scope="module")
def claimed(spark):
    df = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)], "id long, designation string, code string").repartition(4)
    return {(r.id, r.rule): r.identity for r in rules.catalogue_claims(df).collect()}


def test_categories_and_identities(claimed):
    wrong = [(label, code, claimed.get((i, code)), want) for i, (label, code, want) in enumerate(CASES) if code and claimed.get((i, code)) != want]
    assert wrong == []
    none = {i for i, c in enumerate(CASES) if not c[1]}
    assert not [k for k in claimed if k[0] in none]
    assert {c[1] for c in CASES if c[1]} == {c.code for c in rules.CATEGORIES}


def test_formats(spark):
    cases = [("l. 30,8 x L. 61,5 cm", "615x308", False), ("L.138,3 x l.19,3 cm x Ép. 7mm", "1383x193x7", True), ("65 x 117 x 52 mm", "117x65x52", False), ("12 x 3, puis 2 m x 50 cm", "2000x500", False), ("9000 x 10 mm", None, False), ("", None, False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    from tallyforge.functions.text import fold

    got = df.select("i", rules.format_pair(fold("s")).alias("a"), rules.format_pair(fold("s"), "cm", True).alias("b")).orderBy("i").collect()
    assert [r.b if c[2] else r.a for r, c in zip(got, cases)] == [c[1] for c in cases]


def test_claims_are_matched_like_those_of_other_rules(spark, claimed):
    rows = spark.createDataFrame([(i, rule, v) for (i, rule), v in claimed.items()], "id long, rule string, identity map<string,string>")
    products = rows.selectExpr("id + 1000 AS product_id", "rule", "identity")
    found = resolve.match(rows, products, rules.CATEGORIES).collect()
    whole = {(i, rule) for (i, rule), v in claimed.items() if all(x is not None for x in v.values())}
    assert all(r.reason in ("EXACT", "AMBIGUOUS") for r in found if (r.id, r.rule) in whole) and len(found) == len(claimed) and len(whole) > 40
    assert rules.catalogue_claims(spark.createDataFrame([], "id long, designation string")).count() == 0
