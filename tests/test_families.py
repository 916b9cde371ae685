"""Signatures, consolidation and discovery reports on small catalogues."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators import consolidate, discover, signatures


def frame(spark, labels, start=1):
    return spark.createDataFrame([(i + start, s) for i, s in enumerate(labels)], "id long, designation string")


def signed(spark, families):
    """families: name -> labels."""
    rows, members = [], []
    for name, labels in families.items():
        for s in labels:
            members.append((name, len(rows) + 1))
            rows.append((len(rows) + 1, s))
    labels = signatures.read_labels(spark.createDataFrame(rows, "id long, designation string"), mapped=F.col("id") % 4 == 0)
    return signatures.signatures(spark.createDataFrame(members + members[:5], "family string, id long"), labels)


PAINTS = ["Peinture acrylique blanche mate 10 L", "Peinture glycéro satinée 2,5 L teinte", "Peinture murale beige 5 L", "Peinture sous-couche universelle 10 L base A"] * 4
FAMILIES = {
    "VIS AGGLO": [f"Vis agglo turbo 3,5 x {25 + i} mm 200 pièces" for i in range(20)],
    "PANNEAU OSB": [f"Panneau OSB L.2500 x l.1250 x Ep.{10 + i % 5} mm" for i in range(18)],
    "RAIL": [f"Rail R48 galvanisé longueur {2 + i % 3} m" for i in range(9)],
    "TUYAU PVC": [f"Tuyau PVC évacuation DN {40 + (i % 5) * 10} mm longueur 2 m" for i in range(20)],
    "PEINTURE": PAINTS,
    "CIMENT": [f"Ciment gris sac {20 + i} kg" for i in range(8)],
    "CARREAU": [f"Carreau mural {20 + i} x 30 cm" for i in range(8)],
    "LAINE": [f"Laine de verre épaisseur {60 + 10 * i} mm" for i in range(8)],
    "DIVERS": [f"Article divers référence {i} sans mesure" for i in range(20)],
    "CRUCHE": [f"Cruche grès {1 + i} L" for i in range(6)],
    "GENERIQUE": [f"Peinture acrylique 10 L n{i}" for i in range(20)],
    "CONNUE": ["Plaque BA13 L.2,50 x l.1,20m x Ep.13mm"],
}


@pytest.fixture(scope="module")
def known(spark):
    return signed(spark, FAMILIES).checkpoint()


def test_each_model_is_found_once(known):
    got = signatures.qualify(known, F.col("family") == "CONNUE", F.col("family") == "GENERIQUE").collect()
    assert {r.family: (r.status, r.candidate_model, r.complexity) for r in got} == {
        "VIS AGGLO": ("READY_EXISTING_MODEL", "DIMENSIONAL_FASTENER", "XS"), "PANNEAU OSB": ("READY_EXISTING_MODEL", "BOARD_PANEL", "XS"), "RAIL": ("READY_EXISTING_MODEL", "LINEAR_PROFILE", "XS"),
        "TUYAU PVC": ("READY_GENERIC_FEATURES", "PIPE", "S"), "PEINTURE": ("NEEDS_IDENTITY_DECISION", "LIQUID_FINISH", "M"), "CIMENT": ("READY_GENERIC_FEATURES", "BAGGED_MATERIAL", "S"),
        "CARREAU": ("READY_GENERIC_FEATURES", "TILE_OR_FLOORING", "S"), "LAINE": ("READY_GENERIC_FEATURES", "INSULATION", "S"), "DIVERS": ("POOR_DATA", None, "L"),
        "CRUCHE": ("NEEDS_IDENTITY_DECISION", None, "M"), "GENERIQUE": ("NOISY_CLUSTER", None, "L"), "CONNUE": ("KNOWN_CATEGORY", None, "XS"),
    }
    vis = next(r for r in got if r.family == "VIS AGGLO")
    assert (vis["count"], vis.mapped, vis.features["diameter_x_length"].distinct, vis.features["diameter_mm"].examples) == (20, 5, 20, ["3.5"])
    assert vis.features["packaging_qty"].coverage == 1.0 and vis.lexical["fastener"] == 1.0
    wins = [r.family for r in signatures.quick_wins(signatures.qualify(known)).collect()]
    assert wins[:3] == ["VIS AGGLO", "PANNEAU OSB", "RAIL"] and "PEINTURE" not in wins
    assert [r.family for r in signatures.high_impact(signatures.qualify(known), 2).collect()] == ["GENERIQUE", "TUYAU PVC"]


def test_signatures_of_nothing(spark):
    none = spark.createDataFrame([], "id long, designation string")
    members = spark.createDataFrame([("A", 1), ("A", None), (None, 1), ("A", 2)], "family string, id long")
    assert signatures.signatures(members, signatures.read_labels(none)).count() == 0
    one = signatures.signatures(members, signatures.read_labels(spark.createDataFrame([(1, None)], "id long, designation string"))).collect()
    assert [(r.family, r["count"], r.technical, r.features) for r in one] == [("A", 1, 0.0, {})]


@pytest.mark.parametrize("label, want", [
    ("Plaque BA13 L.2,50 x l.1,20m x Ep.13mm", (2500, 1200, 13)), ("Panneau OSB L.2500 x l.1250 x Ep.10 mm", (2500, 1250, 10)), ("Panneau 1,25 x 2,5 x 18 mm", (2500, 1250, 18)),
    ("Panneau 50 x 100 cm x 19 mm", (1000, 500, 19)), ("Doublage 2,5 x 1,2 m x 13 + 80 mm", None), ("120 x 60 cm", None), (None, None), ("", None),
])
def test_sizes_of_boards(spark, label, want):
    row = spark.createDataFrame([(label,)], "s string").select(text.dimensions("s").alias("d"), text.length_width("s").alias("p"), text.thickness_alone("s").alias("t")).first()
    assert (row.d and tuple(row.d)) == want
    if label == "120 x 60 cm":
        assert tuple(row.p) == (1200, 600) and row.t is None


def test_thickness_alone(spark):
    cases = {"Isolant ép. 13 mm": 13, "Isolant épaisseur 1,25 cm": 13, "Dalle ép 40": 40, "Dalle": None, "Épaisseur 120": 120}
    got = frame(spark, cases).select("id", text.thickness_alone("designation").alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == list(cases.values())


def test_natures(spark):
    cases = {
        "TETE FRAISEE": "ATTRIBUTE_CLUSTER", "FRAISEE POSIDRIV": "ATTRIBUTE_CLUSTER", "VIS BOIS": "PRODUCT_FAMILY", "CHEVILLES METAL": "PRODUCT_FAMILY", "VIS TETE FRAISEE": "MIXED",
        "VIS_INOX": "PRODUCT_FAMILY", "ACIER": "UNCERTAIN", "": "UNCERTAIN", None: "UNCERTAIN", "ACIER INOX": "ATTRIBUTE_CLUSTER",
    }
    got = frame(spark, cases).select("id", consolidate.nature("designation").alias("n")).orderBy("id").collect()
    assert dict(zip(cases, (r.n for r in got))) == cases


def placed(spark, families, model="DIMENSIONAL_FASTENER"):
    named = spark.createDataFrame([(m if isinstance(m, str) else model, f) for f, (_, m) in families.items()], "model string, family string")
    members = spark.createDataFrame([(f, i) for f, (ids, _) in families.items() for i in ids], "family string, id long")
    return consolidate.consolidate(named, members).checkpoint(), members


def test_attribute_clusters_join_the_family_that_holds_them(spark):
    got, members = placed(spark, {"VIS BOIS": (range(1, 21), 0), "TETE FRAISEE": (range(1, 16), 0)})
    assert sorted((r.family, r.role, r.root) for r in got.collect()) == [("TETE FRAISEE", "attached", "VIS BOIS"), ("VIS BOIS", "primary", "VIS BOIS")]
    kept = consolidate.consolidated(got, members)
    assert [(r.root, r.unique_members, r.sources, r.attributes, r.nature) for r in kept.collect()] == [("VIS BOIS", 20, ["VIS BOIS"], ["TETE FRAISEE"], "PRODUCT_FAMILY")]
    rows = spark.createDataFrame([(i, f"Vis bois 4 x {30 + i % 5} mm tête fraisée") for i in range(1, 21)], "id long, designation string")
    tokens = discover.labelled(rows)
    done = consolidate.audit(kept, got, members, signatures.read_labels(rows), tokens).collect()
    assert [(r.diameter_coverage, r.length_coverage, r.distinct_identities, r.risks, r.false_positive, r.safe_quick_win) for r in done] == [(1.0, 1.0, 5, 0, False, True)]
    assert [r.root for r in consolidate.first_lot(consolidate.audit(kept, got, members, signatures.read_labels(rows), tokens)).collect()] == ["VIS BOIS"]


def test_roots_of_components(spark):
    got, members = placed(spark, {
        # 60 % of CHEVILLE are held by VIS; BOULON only overlaps it by its half; the uncertain one is linked and stands apart.
        "VIS": (range(100), 0), "CHEVILLE": (range(60, 110), 0), "BOULON": (range(70, 101), 0), "ACIER": (range(0, 40), 0), "NOIR": ((), 0),
        "PANNEAU": (range(100), "BOARD_PANEL"), "TORX": (range(300, 310), 0), "JAUNE": (range(304, 310), 0), "DALLE": (range(500, 505), 0), "CIMENT": (range(505, 510), 0),
    })
    assert {r.family: (r.role, r.root, r.model[:5]) for r in got.collect()} == {
        "VIS": ("primary", "VIS", "DIMEN"), "CHEVILLE": ("attached", "VIS", "DIMEN"), "BOULON": ("attached", "VIS", "DIMEN"), "ACIER": ("apart", "ACIER", "DIMEN"), "NOIR": ("primary", "NOIR", "DIMEN"),
        "PANNEAU": ("primary", "PANNEAU", "BOARD"), "TORX": ("primary", "TORX", "DIMEN"), "JAUNE": ("attached", "TORX", "DIMEN"), "DALLE": ("primary", "DALLE", "DIMEN"), "CIMENT": ("primary", "CIMENT", "DIMEN"),
    }
    kept = {r.root: (r.unique_members, r.attributes) for r in consolidate.consolidated(got, members).collect()}
    assert kept["VIS"] == (110, ["BOULON", "CHEVILLE"]) and kept["NOIR"] == (0, []) and kept["ACIER"] == (40, [])


def test_roots_that_only_touch_stand_alone(spark):
    got, _ = placed(spark, {"VIS": (range(100), 0), "CLOU": (range(60, 140), 0), "RIVET": (range(100, 150), 0)})
    # VIS and CLOU share 40 of 140; CLOU and RIVET 40 of 90, which links them; only CLOU is held by the primary of its component.
    assert {r.family: (r.role, r.root) for r in got.collect()} == {"VIS": ("primary", "VIS"), "CLOU": ("primary", "CLOU"), "RIVET": ("attached", "CLOU")}
    assert consolidate.consolidate(spark.createDataFrame([], "model string, family string"), spark.createDataFrame([], "family string, id long")).count() == 0


def test_generic_groups_and_actionable_families(spark):
    labels = [f"Vis bois pro {i} mm" for i in range(30)] + [f"Cheville nylon pro {i} mm" for i in range(30)] + [f"Autre{i} article{i} bois" for i in range(30)]
    rows = discover.labelled(frame(spark, labels))
    groups, children = discover.group_report(rows, signatures.read_labels(frame(spark, labels), mapped=F.col("id") <= 5))
    got = {(r.seed, r.kind, r["size"], r.split) for r in groups.collect()}
    assert got == {("bois pro", "bigram", 30, False), ("cheville nylon", "bigram", 30, False), ("bois", "unigram", 30, False)}
    assert not [r for r in groups.collect() if r.kind == "bigram" and r.generic] and {r.technical for r in groups.collect()} == {0.0}
    done = [(r.path, r["size"], r.mapped) for r in discover.actionable_families(groups, children).collect()]
    assert all(n >= 25 for _, n, _ in done) and len(done) >= 2 and sum(m for _, _, m in done) == 5
    none = discover.group_report(rows.limit(0))
    assert none[0].count() == 0 and discover.actionable_families(*none).count() == 0
