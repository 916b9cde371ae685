"""Registered queries of entity resolution: all rules at once, arbitration, equivalence of suppliers, families and their consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import catalogue_rules, consolidate, equivalence, resolve, signatures
from tallyforge.plans.queries import _labels, query
from tallyforge.session import ensure_checkpoint_dir, table


def _form(label: str, *values: str) -> str:
    """A label with the values for its marks, as an SQL expression that both engines have."""
    parts = label.split("%")
    return " || ".join(x for i, p in enumerate(parts) for x in (["'" + p.replace("'", "''") + "'"] + ([f"CAST({values[i]} AS STRING)"] if i < len(parts) - 1 else [])))


# Matches and seeds over all rules. The labels are those of e10: screws, boards, rails and cement by formula.

_CLAIMED = """l AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_size AS s FROM part), c AS (SELECT id, s, k, CASE k WHEN 0 THEN 'VIS_BETON' WHEN 1 THEN 'PANNEAU_OSB' WHEN 2 THEN 'OSSATURE_RAIL' ELSE 'CIMENT' END AS rule,
  CASE k WHEN 0 THEN (4 + s % 4) || 'x' || (20 + s) WHEN 1 THEN (9 + s % 12)::VARCHAR WHEN 2 THEN CASE WHEN s % 2 = 0 THEN '2500' ELSE '3000' END ELSE (20 + s % 20)::VARCHAR END AS size FROM l WHERE k < 4)"""


@query("e09_matches", f"""WITH {_CLAIMED}, m AS (SELECT *, CASE
    WHEN k = 0 THEN CASE WHEN s % 4 = 0 AND s <= 24 THEN 'EXACT' WHEN s % 4 = 1 THEN 'REVIEW' ELSE 'NO_PRODUCT' END WHEN k = 1 THEN CASE WHEN s % 12 < 4 THEN 'EXACT' WHEN s % 12 < 6 THEN 'HALF' ELSE 'NO_PRODUCT' END
    WHEN k = 2 THEN CASE WHEN s % 2 = 0 THEN 'AMBIGUOUS' ELSE 'NO_PRODUCT' END ELSE CASE WHEN s % 20 = 5 THEN 'EXACT' ELSE 'REVIEW' END END AS reason FROM c)
  SELECT id, rule, CASE reason WHEN 'EXACT' THEN 'EXACT' WHEN 'NO_PRODUCT' THEN 'UNMAPPED' ELSE 'REVIEW' END AS status,
    CASE WHEN reason = 'NO_PRODUCT' THEN NULL WHEN k = 0 AND reason = 'EXACT' THEN 1000 + s WHEN k = 0 THEN 2000 WHEN k = 1 THEN 3000 + s % 12 WHEN k = 2 THEN 4000 WHEN reason = 'EXACT' THEN 5001 ELSE 5000 END::BIGINT AS product_id,
    CASE reason WHEN 'EXACT' THEN 1.0 WHEN 'HALF' THEN 0.55 WHEN 'AMBIGUOUS' THEN 0.7 WHEN 'REVIEW' THEN 0.3 ELSE 0.0 END::DOUBLE AS score, CASE reason WHEN 'HALF' THEN 'REVIEW' ELSE reason END AS reason FROM m""")
def e09(spark, sf):
    """Screws with a product, with one of unknown length or with none; boards of known, unknown and other kinds; two products of one rail; bags of one weight or any."""
    read = resolve.extract(_labels(spark, sf)).where("rule IS NOT NULL").select("id", "rule", "identity").checkpoint()
    return resolve.match(read, _products(spark))


def _products(spark) -> DataFrame:
    ensure_checkpoint_dir(spark)
    screws = [(1000 + s, "VIS_BETON", {"type": "beton", "diameter_mm": "4.00", "length_mm": str(20 + s)}) for s in range(0, 25, 4)] + [(2000, "VIS_BETON", {"type": "beton", "diameter_mm": "5.00", "length_mm": None})]
    boards = [(3000 + t, "PANNEAU_OSB", {"type": "osb" if t < 4 else None if t < 6 else "autre", "length_mm": "2500", "width_mm": "1250", "thickness_mm": str(9 + t)}) for t in range(8)]
    rails = [(4000 + i, "OSSATURE_RAIL", {"kind": "rail", "profile": "R48", "nominal_length_mm": "2500"}) for i in range(2)]
    bags = [(5000, "CIMENT", {"type": "ciment", "weight_kg": None}), (5001, "CIMENT", {"type": "ciment", "weight_kg": "25.000"})]
    return spark.createDataFrame(screws + boards + rails + bags, "product_id long, rule string, identity map<string,string>")


@query("a24_product_seeds", """SELECT CASE p_partkey % 6 WHEN 0 THEN 'Vis béton ' || (4 + p_size % 4) || ' x ' || (20 + p_size) || ' mm' WHEN 1 THEN 'Panneau OSB 3 2500 x 1250 x ' || (9 + p_size % 12) || ' mm'
  WHEN 2 THEN 'Rail R48 longueur ' || CASE WHEN p_size % 2 = 0 THEN 2490 ELSE 3000 END || ' mm' ELSE 'Ciment gris sac ' || (20 + p_size % 20) || ' kg' END AS name, count(*) AS "references" FROM part WHERE p_partkey % 6 < 4 GROUP BY 1""")
def a24(spark, sf):
    """Seeds of every rule; the catalogue has none of the identities yet."""
    ensure_checkpoint_dir(spark)
    rows = resolve.extract(_labels(spark, sf)).where("rule IS NOT NULL").select("id", "designation", "rule", "identity").checkpoint()
    return resolve.product_seeds(rows, spark.createDataFrame([], "identity_key string"), "PRD-").select("name", "references")


@query("e13_arbitration", """WITH l AS (SELECT p_partkey AS id, p_partkey % 5 AS k, 3 + p_size % 4 AS d FROM part)
  SELECT id, CASE WHEN k = 4 THEN 'RULES_DISAGREE' WHEN k = 3 THEN 'EXACT' WHEN d = 3 THEN 'AMBIGUOUS' WHEN d = 6 THEN 'NO_PRODUCT' ELSE 'EXACT' END AS outcome,
    CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN 20 + d WHEN d = 6 THEN NULL ELSE 10 + d END::BIGINT AS product_id FROM l""")
def e13(spark, sf):
    """Bolts, chipboard screws, and labels that two rules claim: they agree on nothing, as each has a product of its own."""
    forms = {0: _form("Vis agglo % x 40 mm", "3 + p_size % 4"), 1: _form("Vis agglo tete fraisee % x 40 mm", "3 + p_size % 4"), 2: _form("Vis agglo torx % x 40 mm", "3 + p_size % 4"), 3: _form("Boulon % x 40 mm", "3 + p_size % 4"), 4: _form("Boulon goujon % x 40 mm", "3 + p_size % 4")}
    case = "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN {f}" for k, f in forms.items()) + " END"
    labels = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{case} AS designation", "p_size")
    ensure_checkpoint_dir(spark)
    read = resolve.claims(labels).select("id", "rule", "identity", "attributes").checkpoint()
    size = lambda t, d: {"type": t, "diameter_mm": f"{d}.00", "length_mm": "40"}
    have = [(10 + d, "VIS_AGGLO", size("agglo", d)) for d in (3, 4, 5)] + [(99, "VIS_AGGLO", size("agglo", 3))] + [(20 + d, "BOULON", size("boulon", d)) for d in (3, 4, 5, 6)] + [(30 + d, "GOUJON", size("goujon", d)) for d in (3, 4, 5, 6)]
    products = spark.createDataFrame(have, "product_id long, rule string, identity map<string,string>")
    return resolve.arbitrate(resolve.match(read, products)).select("id", "outcome", "product_id")


# Catalogue categories: a label form for each of seven, and the parts' names, which are in none.

_GOODS = {
    0: "'Carrelage sol grès beige ROMA ' || (30 + p_size) || ' x 60 cm'", 1: "'Peinture satinée mur blanc pur ' || p_size || ' L'", 2: "'Câble R2V 3G1,5 mm² noir - ' || (p_size + 5) || ' m'", 3: "'Lot de 2 Colle néoprène ' || (50 + p_size) || ' g'",
    4: "'Tube PVC diam. ' || (16 + p_size) || ' mm 2 m'", 5: "'Panneau polystyrène extrudé 125 cm 60 cm ' || (1 + p_size % 5) || ' cm'", 6: "'Radiateur inertie blanc ' || (500 + p_size) || ' W'",
}


@query("p30_catalogue_claims", """SELECT p_partkey AS id, ['CAT_CARRELAGE', 'CAT_LIQUIDE', 'CABLE_ELEC', 'CAT_COLLE', 'CAT_TUBE', 'POLYSTYRENE_XPS', 'CAT_RADIATEUR'][p_partkey % 8 + 1] AS rule, CASE p_partkey % 8
  WHEN 0 THEN 'color=beige|decor=roma|finish=std|format=' || 10 * greatest(30 + p_size, 60) || 'x' || 10 * least(30 + p_size, 60) || '|material=gres|usage=sol'
  WHEN 1 THEN 'color=blanc_pur|finish=satin|gamme=std|kind=peinture|usage=mur|volume=' || CASE WHEN p_size <= 30 THEN p_size || 'l' ELSE '' END
  WHEN 2 THEN 'color=noir|conductors=3|kind=r2v|length_m=' || (p_size + 5) || '|section_mm2=1.5' WHEN 3 THEN 'kind=neoprene|quantite=' || (50 + p_size) || 'g' WHEN 4 THEN 'diameter_mm=' || (16 + p_size) || '|length=2m|material=pvc'
  WHEN 5 THEN 'length_mm=1250|thickness_mm=' || 10 * (1 + p_size % 5) || '|type=xps|width_mm=600' ELSE 'color=blanc|format=|kind=inertie|modele=|power_w=' || (500 + p_size) END AS identity FROM part WHERE p_partkey % 8 < 7""")
def p30(spark, sf):
    case = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in _GOODS.items()) + " ELSE p_name END"
    found = catalogue_rules.catalogue_claims(table(spark, sf, "part").selectExpr("p_partkey AS id", f"{case} AS designation"))
    told = F.transform(F.array_sort(F.map_entries("identity")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return found.select("id", "rule", F.array_join(told, "|").alias("identity"))


# Equivalence: every third part is a product of the one supplier, the two after it are references of the other.

_SIDES = """p AS (SELECT p_partkey AS id, p_partkey - p_partkey % 3 AS k, p_partkey % 3 AS side, 2 + (p_partkey - p_partkey % 3) // 100 % 6 AS d, 11 + (p_partkey - p_partkey % 3) % 100 AS l FROM part),
  t AS (SELECT k, d, l, ['torx', 'pozidriv', 'philips'][k % 9 // 3 + 1] AS drive FROM p WHERE side = 0),
  s AS (SELECT id, k, d, l, CASE id % 4 WHEN 1 THEN 'torx' WHEN 2 THEN 'pozidriv' END AS drive, id % 4 = 3 AS conflict, CASE WHEN id % 5 = 0 THEN k ELSE -1 END AS held FROM p WHERE side <> 0)"""


@query("j13_equivalents", f"""WITH {_SIDES}, m AS (SELECT s.id, count(*) AS bucket, count_if(s.drive IS NULL OR s.drive = t.drive) AS fits, min(t.k) FILTER (s.drive IS NULL OR s.drive = t.drive) AS found FROM s JOIN t USING (d, l) GROUP BY s.id),
  o AS (SELECT s.id, held, found, CASE WHEN conflict THEN 'ambiguous' WHEN bucket IS NULL THEN 'none' WHEN fits <> 1 THEN 'ambiguous' WHEN held = found THEN 'same' ELSE 'linked' END AS outcome, bucket FROM s LEFT JOIN m USING (id))
  SELECT id, outcome, CASE WHEN outcome IN ('same', 'linked') THEN CASE WHEN bucket = 1 THEN 'complete' ELSE 'strong' END END AS level, CASE WHEN outcome IN ('same', 'linked') THEN 'VIS_AGGLO' END AS rule,
    CASE WHEN outcome IN ('same', 'linked') THEN found END AS product_id FROM o""")
def j13(spark, sf):
    """Screws by type, diameter and length; drives by label, short form or property, and lengths that contradict the label."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_partkey - p_partkey % 3 AS k", "p_partkey % 3 AS side")
    p = p.selectExpr("*", "2 + k div 100 % 6 AS d", "11 + k % 100 AS l")
    name = "'Vis agglo ' || d || ' x ' || l || ' mm'"
    targets = p.where("side = 0").selectExpr("k AS product_id", f"{name} || element_at(array(' torx', ' pozidriv', ' philips'), CAST(k % 9 div 3 + 1 AS INT)) AS name", "CAST(NULL AS MAP<STRING, STRING>) AS attributes").withColumn("designation", F.col("name"))
    told = "CASE id % 4 WHEN 2 THEN map('Empreinte de la vis', 'PZ 2', 'Longueur', l / 10 || ' cm') WHEN 3 THEN map('Longueur de la vis', l + 1 || ' mm') END AS properties"
    rows = p.where("side <> 0").selectExpr("id", f"CASE WHEN id % 4 = 1 THEN 'VIS AGGLO TX ' || d || 'x' || l ELSE {name} END AS designation", told, "CASE WHEN id % 5 = 0 THEN k ELSE -1 END AS product_id")
    return equivalence.equivalents(rows, equivalence.identity_index(targets))


# Families

_FAMILIES = {
    0: ("VIS AGGLO", "CASE WHEN p_size % 4 = 0 THEN 'Vis agglo vrac' ELSE 'Vis agglo 4 x ' || (20 + p_size) || ' mm' END"), 1: ("PANNEAU OSB", "'Panneau OSB 2500 x 1250 x ' || (9 + p_size % 12) || ' mm'"),
    2: ("RAIL", "CASE WHEN p_size % 3 = 0 THEN 'Rail divers' ELSE 'Rail R48 longueur ' || (2000 + p_size) || ' mm' END"), 3: ("TUYAU", "CASE WHEN p_size % 2 = 0 THEN 'Tuyau PVC gris' ELSE 'Tuyau PVC DN ' || (20 + p_size) END"),
    4: ("PEINTURE", "'Peinture mate ' || p_size || ' L'"), 5: ("CIMENT", "'Ciment gris ' || p_size || ' kg'"), 6: ("CARREAU", "'Carreau mural ' || (20 + p_size) || ' x 30 cm'"), 7: ("LAINE", "'Laine de verre épaisseur ' || (60 + p_size) || ' mm'"),
    8: ("DIVERS", "'Article divers'"), 9: ("CRUCHE", "'Cruche ' || p_size || ' L'"),
}
_FAMILY = "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in _FAMILIES.items()) + " END"
_FAMILY_LABEL = "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN {x}" for k, (_, x) in _FAMILIES.items()) + " END"


@query("d16_family_status", f"""WITH l AS (SELECT p_partkey % 10 AS k, {_FAMILY} AS family, p_size AS s, p_partkey % 7 <> 0 AS mapped FROM part),
  h AS (SELECT *, CASE k WHEN 0 THEN s % 4 <> 0 WHEN 2 THEN s % 3 <> 0 WHEN 3 THEN s % 2 <> 0 WHEN 8 THEN false ELSE true END AS has, CASE k WHEN 1 THEN s % 12 WHEN 6 THEN greatest(20 + s, 30) ELSE s END AS v FROM l),
  g AS (SELECT k, family, count(*) AS count, count_if(mapped) AS mapped, avg(has::INT)::DOUBLE AS technical, count(DISTINCT v) FILTER (has) AS values FROM h GROUP BY 1, 2),
  m AS (SELECT *, CASE WHEN k = 0 AND technical >= 0.7 THEN 'DIMENSIONAL_FASTENER' WHEN k = 1 THEN 'BOARD_PANEL' WHEN k = 2 AND technical >= 0.5 THEN 'LINEAR_PROFILE' WHEN k = 3 AND technical >= 0.35 THEN 'PIPE' WHEN k = 4 THEN 'LIQUID_FINISH' WHEN k = 5 THEN 'BAGGED_MATERIAL'
    WHEN k = 6 THEN 'TILE_OR_FLOORING' WHEN k = 7 THEN 'INSULATION' END AS candidate_model FROM g),
  t AS (SELECT *, CASE WHEN k = 4 THEN 'NEEDS_IDENTITY_DECISION' WHEN k < 3 AND candidate_model IS NOT NULL THEN 'READY_EXISTING_MODEL' WHEN candidate_model IS NOT NULL THEN 'READY_GENERIC_FEATURES' WHEN technical >= 0.5 THEN 'NEEDS_IDENTITY_DECISION' ELSE 'POOR_DATA' END AS status FROM m)
  SELECT family, count, mapped, round(technical, 4) AS technical, status, candidate_model, CASE status WHEN 'READY_EXISTING_MODEL' THEN 'XS' WHEN 'READY_GENERIC_FEATURES' THEN 'S' WHEN 'POOR_DATA' THEN 'L' ELSE 'M' END AS complexity, values FROM t""")
def d16(spark, sf):
    """A family of labels for each model, some without the measure that counts, and two without a model."""
    ensure_checkpoint_dir(spark)
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_FAMILY} AS family", f"{_FAMILY_LABEL} AS designation", "p_partkey % 7 <> 0 AS mapped")
    labels = signatures.read_labels(rows, mapped=F.col("mapped")).checkpoint()
    done = signatures.qualify(signatures.signatures(rows.select("family", "id"), labels))
    most = F.array_max(F.transform(F.map_values("features"), lambda x: x["distinct"]))
    return done.select("family", "count", "mapped", F.round("technical", 4).alias("technical"), "status", "candidate_model", "complexity", F.coalesce(most, F.lit(0)).alias("values"))


_CLUSTERS = (
    ("DIMENSIONAL_FASTENER", "VIS BOIS", "PRODUCT_FAMILY", "k % 3 = 0"), ("DIMENSIONAL_FASTENER", "TETE FRAISEE", "ATTRIBUTE_CLUSTER", "k % 6 = 0"), ("DIMENSIONAL_FASTENER", "VIS INOX", "PRODUCT_FAMILY", "k % 3 = 0 AND k % 4 <> 1"),
    ("DIMENSIONAL_FASTENER", "CHEVILLE NYLON", "PRODUCT_FAMILY", "k % 5 = 1"), ("DIMENSIONAL_FASTENER", "TORX", "ATTRIBUTE_CLUSTER", "k % 10 = 1"), ("DIMENSIONAL_FASTENER", "BOULON", "PRODUCT_FAMILY", "k % 7 = 2"),
    ("DIMENSIONAL_FASTENER", "FILETAGE", "UNCERTAIN", "k % 14 = 2"), ("DIMENSIONAL_FASTENER", "INOX ZINC", "ATTRIBUTE_CLUSTER", "k % 11 = 5"), ("BOARD_PANEL", "PANNEAU CORNIERE", "PRODUCT_FAMILY", "k % 3 = 0"),
    ("BOARD_PANEL", "PLAQUE BLANC NOIR", "MIXED", "k % 2 = 0"), ("BOARD_PANEL", "BRUT", "ATTRIBUTE_CLUSTER", "k % 4 = 0"), ("BOARD_PANEL", "RESTE", "UNCERTAIN", "k % 13 = 1 AND k > 20000"),
)
_MEMBERS = " UNION ALL ".join(f"SELECT '{m}' AS model, '{f}' AS family, '{n}' AS nature, p_partkey AS id FROM (SELECT p_partkey, p_partkey AS k FROM part) WHERE {c}" for m, f, n, c in _CLUSTERS)


@query("d19_consolidated", f"""WITH RECURSIVE m AS ({_MEMBERS}), f AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{f}', '{n}')" for m, f, n, _ in _CLUSTERS)}) v(model, family, nature)),
  n AS (SELECT f.*, (SELECT count(*) FROM m WHERE m.family = f.family) AS n, list_position(['PRODUCT_FAMILY', 'MIXED', 'UNCERTAIN', 'ATTRIBUTE_CLUSTER'], nature) AS rank FROM f),
  p AS (SELECT a.model, a.family AS a, b.family AS b, count(*) AS shared FROM m a JOIN m b ON a.model = b.model AND a.id = b.id AND a.family <> b.family GROUP BY 1, 2, 3),
  e AS (SELECT a, b, round(shared::DOUBLE / x.n, 4) AS held FROM p JOIN n x ON x.family = a JOIN n y ON y.family = b WHERE round(shared::DOUBLE / (x.n + y.n - shared), 4) >= 0.3 OR round(shared::DOUBLE / x.n, 4) >= 0.55 OR round(shared::DOUBLE / y.n, 4) >= 0.55),
  r(a, b) AS (SELECT family, family FROM f UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS family, min(b) AS comp FROM r GROUP BY 1),
  q AS (SELECT n.*, comp, first_value(family) OVER (PARTITION BY comp ORDER BY rank, n.n DESC, family) AS first, min(rank) OVER (PARTITION BY comp) AS least FROM n JOIN c USING (family)),
  o AS (SELECT q.*, CASE WHEN family = first THEN 'primary' WHEN nature = 'ATTRIBUTE_CLUSTER' OR rank = least AND coalesce(held, 0) >= 0.55 THEN 'attached' WHEN rank = least THEN 'alone' ELSE 'apart' END AS role FROM q LEFT JOIN e ON e.a = family AND e.b = first),
  w AS (SELECT *, CASE WHEN role IN ('primary', 'attached') THEN first ELSE family END AS root FROM o)
  SELECT w.model, root, max(nature) FILTER (w.family = root) AS nature, max(role) FILTER (w.family = root) AS role, string_agg(w.family, ',' ORDER BY w.family) FILTER (role <> 'attached') AS sources, coalesce(string_agg(w.family, ',' ORDER BY w.family) FILTER (role = 'attached'), '') AS attributes,
    (SELECT count(DISTINCT id) FROM m JOIN w v ON v.family = m.family AND v.root = w.root) AS unique_members FROM w GROUP BY w.model, root""")
def d19(spark, sf):
    """Clusters over all parts by remainders: some hold others, some touch, one is empty at small sizes."""
    k = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    named = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(f)) for _, f, _, c in _CLUSTERS)))
    members = k.select(F.col("k").alias("id"), F.explode(named).alias("family"))
    families = spark.createDataFrame([(m, f) for m, f, _, _ in _CLUSTERS], "model string, family string")
    done = consolidate.consolidated(consolidate.consolidate(families, members), members)
    return done.select("model", "root", "nature", "role", F.array_join("sources", ",").alias("sources"), F.array_join("attributes", ",").alias("attributes"), "unique_members")


@query("d18_natures", "SELECT family, nature FROM (VALUES " + ", ".join(f"('{f}', '{n}')" for _, f, n, _ in _CLUSTERS) + ") v(family, nature) JOIN (SELECT DISTINCT p_size % 12 AS i FROM part) p ON p.i = list_position([" + ", ".join(f"'{f}'" for _, f, _, _ in _CLUSTERS) + "], family) - 1")
def d18_natures(spark, sf):
    """What the labels of clusters name, one for each remainder of the parts' sizes."""
    label = F.element_at(F.array(*(F.lit(f) for _, f, _, _ in _CLUSTERS)), (F.col("p_size") % len(_CLUSTERS) + 1).cast("int"))
    return table(spark, sf, "part").select(label.alias("family")).distinct().withColumn("nature", consolidate.nature("family"))
