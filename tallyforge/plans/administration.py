"""Registered queries of catalogue writes, audits and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import feeds_text
from tallyforge.operators import administration as admin
from tallyforge.operators import discover
from tallyforge.plans.queries import WITH, WITH_SP, query
from tallyforge.session import table, tasks
from tallyforge.sources import bind


@query("w11_deactivate_catalog", f"{WITH_SP} SELECT sp_id, active AND catalog_id <> 3 AS active FROM supplier_products")
def w11(spark, sf):
    sp = bind.supplier_products(spark, sf)
    return admin.set_flag(sp, spark.createDataFrame([(3,), (3,), (99,)], "catalog_id long"), "catalog_id", "active", False).select("sp_id", "active")


@query("w12_manual_mapping", f"""{WITH_SP}, r AS (SELECT sp_id, product_id AS held, CASE WHEN sp_id % 4 = 0 THEN NULL WHEN sp_id % 4 = 1 THEN sp_id % 10000000 ELSE sp_id % 10000000 + 7 END AS wanted, sp_id % 3 = 0 AS ok FROM supplier_products),
  o AS (SELECT *, CASE WHEN wanted IS NOT NULL AND wanted NOT IN (SELECT product_id FROM products) THEN 'unknown_product' WHEN held IS NOT DISTINCT FROM wanted THEN 'same' WHEN held IS NULL THEN 'mapped'
    WHEN NOT ok THEN 'needs_confirmation' WHEN wanted IS NULL THEN 'unmapped' ELSE 'remapped' END AS outcome FROM r)
  SELECT sp_id, CASE WHEN outcome IN ('mapped', 'remapped', 'unmapped') THEN wanted ELSE held END AS product_id, outcome FROM o""")
def w12(spark, sf):
    sp = bind.supplier_products(spark, sf)
    part, kind = F.col("sp_id") % 10_000_000, F.col("sp_id") % 4
    asked = sp.select("sp_id", F.when(kind == 1, part).when(kind != 0, part + 7).alias("wanted"), (F.col("sp_id") % 3 == 0).alias("confirmed"))
    return admin.map_references(sp, bind.products(spark, sf), asked)


@query("w14_create_products", """WITH r AS (SELECT p_partkey AS request_no, CASE WHEN p_partkey % 5 = 0 THEN printf('PRD%06d', p_partkey) ELSE 'NEW' || p_size || p_brand END AS code, ['Pieces', 'ml', 'carton'][p_partkey % 3 + 1] AS unit FROM part),
  f AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY request_no) AS n FROM r)
  SELECT request_no, code, CASE WHEN request_no % 5 = 0 OR n > 1 THEN 'duplicate_code' WHEN unit = 'carton' THEN 'bad_unit' ELSE 'created' END AS outcome FROM f""")
def w14(spark, sf):
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, F.format_string("PRD%06d", k)).otherwise(F.concat(F.lit("NEW"), F.col("p_size"), F.col("p_brand")))
    unit = F.element_at(F.array(*map(F.lit, ("Pieces", "ml", "carton"))), (k % 3 + 1).cast("int"))
    asked = table(spark, sf, "part").select(k.alias("request_no"), code.alias("code"), F.col("p_name").alias("name"), unit.alias("unit"))
    return admin.create_products(asked, bind.products(spark, sf), ("pièce", "m", "m²", "kg")).select("request_no", "code", "outcome")


@query("w14_change_units", f"""{WITH}, u AS (SELECT DISTINCT l_partkey FROM lineitem)
  SELECT product_id, CASE WHEN reference_unit = 'kg' THEN 'same' WHEN product_id IN (SELECT l_partkey FROM u) THEN 'in_use' ELSE 'changed' END AS outcome,
    CASE WHEN product_id IN (SELECT l_partkey FROM u) THEN reference_unit ELSE 'kg' END AS reference_unit FROM products""")
def w14_units(spark, sf):
    products = bind.products(spark, sf)
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("product_id"))
    return admin.change_units(products, products.select("product_id", F.lit("Kilo").alias("unit")), used)


@query("a14_sources", f"""{WITH_SP}, r AS (SELECT supplier_id, count(*) AS n, count(product_id) AS m FROM supplier_products GROUP BY 1), o AS (SELECT supplier_id, count(*) AS n FROM offers GROUP BY 1)
  SELECT s.supplier_id, supplier, active, coalesce(r.n, 0) AS "references", coalesce(r.m, 0) AS mapped, coalesce(o.n, 0) AS offers FROM suppliers s LEFT JOIN r USING (supplier_id) LEFT JOIN o ON o.supplier_id = s.supplier_id""")
def a14(spark, sf):
    return admin.sources(bind.suppliers(spark, sf), bind.supplier_products(spark, sf), bind.offers(spark, sf))


@query("a25_specific_products", f"""{WITH_SP}, l AS (SELECT CASE WHEN sp_id % 11 = 0 THEN '  ' || upper(designation) || '  ' ELSE designation END AS label FROM supplier_products WHERE product_id IS NULL)
  SELECT lower(trim(label)) AS designation_key, count(*) AS "references", arg_max(label, (length(label), label)) AS name FROM l GROUP BY 1""")
def a25(spark, sf):
    sp = bind.supplier_products(spark, sf)
    label = F.when(F.col("sp_id") % 11 == 0, F.concat(F.lit("  "), F.upper("designation"), F.lit("  "))).otherwise(F.col("designation"))
    return admin.specific_products(sp.withColumn("designation", label), "SPE").select("designation_key", "references", "name")


@query("a31_exact_audit", """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN 'length' ELSE 'type' END AS key FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 IN (1, 2)""")
def a31(spark, sf):
    """Claims of which a part differs in the length, a part has no type, and a part differs in the spelling only."""
    k, n = F.col("p_partkey"), F.col("p_size")
    a = F.create_map(F.lit("length"), n.cast("string"), F.lit("type"), F.when(k % 4 != 2, F.lit("Béton")))
    b = F.create_map(F.lit("length"), F.when(k % 4 == 1, (n + 1).cast("string")).otherwise(F.concat(n.cast("string"), F.lit(".0"))), F.lit("type"), F.lit("beton"))
    claims = table(spark, sf, "part").select(k.alias("id"), F.when(k % 3 == 0, "HIGH").otherwise("EXACT").alias("reason"), a.alias("identity"), b.alias("target"))
    return admin.audit_exact(claims, ["length", "type"]).select("id", "key")


@query("a34_reference_search", f"""{WITH_SP} SELECT sp_id, supplier, supplier_reference, s.product_id, code AS product_code FROM supplier_products s JOIN suppliers USING (supplier_id) LEFT JOIN products p ON p.product_id = s.product_id
  WHERE contains(lower(designation), 're') OR contains(lower(supplier_reference), 're') OR contains(lower(s.brand), 're') OR contains(lower(supplier), 're') ORDER BY supplier, supplier_reference LIMIT 30""")
def a34(spark, sf):
    return admin.search_references(bind.supplier_products(spark, sf), bind.suppliers(spark, sf), bind.products(spark, sf), "Re", 50)


@query("a34_unmapped_search", f"""{WITH_SP} SELECT sp_id, supplier, supplier_reference, NULL::BIGINT AS product_id, NULL::VARCHAR AS product_code FROM supplier_products JOIN suppliers USING (supplier_id) WHERE product_id IS NULL ORDER BY supplier, supplier_reference LIMIT 20""")
def a34_unmapped(spark, sf):
    return admin.search_references(bind.supplier_products(spark, sf), bind.suppliers(spark, sf), bind.products(spark, sf))


@query("a36_product_usage", f"{WITH} SELECT product_id, count(DISTINCT l_orderkey) AS projects, count(l_orderkey) = 0 AS unit_editable FROM products LEFT JOIN lineitem ON l_partkey = product_id GROUP BY 1")
def a36(spark, sf):
    saved = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("product_id"))
    return admin.product_usage(bind.products(spark, sf), saved)


@query("j04_live_references", f"{WITH_SP} SELECT sp_id, supplier_id, supplier_reference, product_id, code, reference_unit FROM supplier_products s JOIN products p USING (product_id) WHERE s.active AND p.is_active")
def j04(spark, sf):
    return admin.live_references(bind.supplier_products(spark, sf), bind.products(spark, sf))


@query("j19_named_suppliers", "SELECT s_suppkey AS supplier_id FROM supplier WHERE lower(replace(replace(s_name, '#', ' '), '_', ' ')) = 'supplier 000000007'")
def j19(spark, sf):
    s = bind.suppliers(spark, sf).withColumn("supplier", F.translate("supplier", "#", "_"))
    return admin.named_suppliers(s, "SUPPLIER-000000007").select("supplier_id")


@query("s21_dominant_source", """WITH o AS (SELECT l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 'file' WHEN l_suppkey % 4 = 1 THEN 'api' WHEN l_suppkey % 4 = 2 THEN 'demo' END AS a, CASE WHEN l_linenumber > 3 THEN 'demo' END AS b FROM lineitem),
  u AS (SELECT l_suppkey, a AS t FROM o UNION ALL SELECT l_suppkey, b FROM o) SELECT l_suppkey AS supplier_id, CASE WHEN bool_or(t = 'file') THEN 'file' WHEN bool_or(t = 'api') THEN 'api' WHEN bool_or(t = 'demo') THEN 'demo' END AS source FROM u GROUP BY 1""")
def s21(spark, sf):
    li, k = table(spark, sf, "lineitem"), F.col("l_suppkey") % 4
    one = li.select(F.col("l_suppkey").alias("supplier_id"), F.when(k == 0, "file").when(k == 1, "api").when(k == 2, "demo").alias("source_type"))
    return admin.dominant_source(one.union(li.select("l_suppkey", F.when(F.col("l_linenumber") > 3, "demo"))), "supplier_id")


@query("s24_participation", """WITH s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'group' ELSE s_name END AS name, s_suppkey % 10 <> 0 AS active FROM supplier), n AS (SELECT DISTINCT name FROM s UNION SELECT 'nobody')
  SELECT n.name, coalesce(bool_or(active), true) AS participates FROM n LEFT JOIN s USING (name) GROUP BY 1""")
def s24(spark, sf):
    s = bind.suppliers(spark, sf).withColumn("supplier", F.when(F.col("supplier_id") % 3 == 0, "group").otherwise(F.col("supplier")))
    return admin.participates(s, s.select(F.col("supplier").alias("name")).union(spark.createDataFrame([("nobody",)], "name string")))


@query("t37_availability", """WITH e AS (SELECT event_id, ['Disponible', ' sous 3 JOURS', 'Sur commande', '', NULL, 'autre'][event_id % 6 + 1] AS l, CASE WHEN event_id % 7 = 0 THEN false END AS v FROM events)
  SELECT event_id, CASE WHEN v = false OR coalesce(trim(l), '') = '' THEN 'UNAVAILABLE' WHEN lower(trim(l)) = 'disponible' THEN 'AVAILABLE' WHEN contains(lower(l), 'sous') THEN 'DELAYED' ELSE 'ORDER_ONLY' END AS state,
    CASE WHEN event_id % 5 > 0 THEN event_id % 5 WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 0 END::INT AS quantity FROM e""")
def t37(spark, sf):
    k = F.col("event_id")
    label = F.element_at(F.array(*map(F.lit, ("Disponible", " sous 3 JOURS", "Sur commande", "", None, "autre"))), (k % 6 + 1).cast("int"))
    off = F.when(k % 7 == 0, F.lit(False))
    return table(spark, sf, "events").select(
        k, feeds_text.availability_state(off, F.lit(None).cast("boolean"), label).alias("state"), feeds_text.purchasable_quantity(F.lit("?"), (k % 5).cast("string"), (k % 3).cast("string")).alias("quantity")
    )


@query("t34_pack_quantity", """SELECT p_partkey AS id, round(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE p_size + 0.5 END * 1000)::BIGINT AS thousandths FROM part""")
def t34(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    raw = F.when(k == 0, n.cast("string")).when(k == 1, "lot").when(k == 2, (-n).cast("string")).otherwise(F.concat(n.cast("string"), F.lit(".5")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (feeds_text.pack_quantity(raw) * 1000).cast("bigint").alias("thousandths"))


@query("t25_plain_values", """SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.25' WHEN 2 THEN 'beton gris' WHEN 3 THEN p_size || 'd' WHEN 4 THEN '1234567890123456' || (1000 + p_size) WHEN 5 THEN '-' || p_size || '.5' END AS value FROM part""")
def t25(spark, sf):
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    forms = (F.concat(n, F.lit(".00")), F.concat(n, F.lit(".251")), F.lit(" Béton GRIS "), F.concat(n, F.lit("D")), F.concat(F.lit("1234567890123456"), (1000 + F.col("p_size")).cast("string")), F.concat(F.lit("-"), n, F.lit(",50")))
    raw = F.lit(" ")
    for i, form in enumerate(forms):
        raw = F.when(k == i, form).otherwise(raw)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), feeds_text.plain_value(raw).alias("value"))


@query("t28_line_tokens", "SELECT l_orderkey AS project, l_partkey AS line, 'db:' || l_suppkey AS place, count(*) AS n FROM lineitem GROUP BY ALL")
def t28(spark, sf):
    made = table(spark, sf, "lineitem").select(feeds_text.line_token(F.col("l_orderkey"), F.col("l_partkey"), F.concat(F.lit("db:"), "l_suppkey")).alias("token"))
    return made.select(feeds_text.token_parts(F.col("token")).alias("x")).groupBy("x.project", "x.line", "x.place").agg(F.count("*").alias("n"))


@query("f12_unit_mismatch", """WITH r AS (SELECT p_partkey AS id, ['Rail R48', 'Plaque BA13', p_name][p_partkey % 3 + 1] AS name, ['M', ' m² ', 'piece', 'ml'][p_size % 4 + 1] AS unit FROM part)
  SELECT id, CASE WHEN name = 'Rail R48' AND unit IN ('M', 'ml') THEN 'profile_in_metres' WHEN name = 'Plaque BA13' AND unit = ' m² ' THEN 'board_in_square_metres' END AS mismatch FROM r""")
def f12(spark, sf):
    pick = lambda some, n: F.element_at(F.array(*some), (n + 1).cast("int"))
    name = pick((F.lit("Rail R48"), F.lit("Plaque BA13"), F.col("p_name")), F.col("p_partkey") % 3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), feeds_text.unit_mismatch(name, pick(map(F.lit, ("M", " m² ", "piece", "ml")), F.col("p_size") % 4)).alias("mismatch"))


@query("f15_sensitive_keys", "SELECT event_id, event_id % 5 IN (0, 1, 4) AS sensitive FROM events")
def f15(spark, sf):
    """A key, a key with an escape, values that look like keys, and a text that is no JSON."""
    k = F.col("event_id") % 5
    head = F.when(k == 0, '{"a": [{"X-Access_Token" : 1}], "b": ').when(k == 1, '{"a": {"pass\\u0077ord": null}, "b": ').when(k == 2, '{"note": "a secret", "b": ').when(k == 3, '{"note": "say \\"password\\": x", "b": ').otherwise('{"Cookie": oops, "b": ')
    return table(spark, sf, "events").select("event_id", feeds_text.has_sensitive_key(F.concat(head, "props", F.lit("}"))).alias("sensitive"))


@query("f04_family_selector", f"{WITH} SELECT product_id FROM products WHERE code LIKE 'PRD0001%' OR code LIKE 'PRD00007%' OR brand IN ('Brand#11', 'Brand#3')")
def f04(spark, sf):
    return admin.select_family(bind.products(spark, sf), ("PRD0001", "PRD00007"), brand=("Brand#11", "Brand#3")).select("product_id")


@query("r15_preferred_hits", """SELECT p_size AS family, p_partkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 3 <> 0, length(p_name || p_partkey) DESC, p_name || p_partkey) AS r FROM part) WHERE r = 1""")
def r15(spark, sf):
    k = F.col("p_partkey")
    hits = table(spark, sf, "part").select(F.col("p_size").alias("family"), k.alias("id"), F.concat("p_name", k).alias("name"), F.when(k % 3 == 0, "ean").alias("ean"))
    return admin.preferred_hits(hits, "family").select("family", "id")


@query("r18_largest_families", """WITH f AS (SELECT l_suppkey AS id, l_suppkey % 7 AS family, l_suppkey % 2 AS parent, count(*) AS size FROM lineitem GROUP BY 1)
  SELECT family, parent, id, size FROM (SELECT *, row_number() OVER (PARTITION BY family, parent ORDER BY size DESC, id) AS r FROM f) WHERE r = 1""")
def r18(spark, sf):
    k = F.col("l_suppkey")
    families = table(spark, sf, "lineitem").groupBy(k.alias("id")).agg(F.count("*").alias("size")).select("id", (F.col("id") % 7).alias("family"), (F.col("id") % 2).alias("parent"), "size")
    return admin.largest_families(families, ["family", "parent"]).select("family", "parent", "id", "size")


@query("a40_leg_minutes", """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem), e AS (SELECT l_orderkey AS project_id, 'db:' || l_suppkey AS agency_key, l_linenumber, l_quantity FROM l WHERE l_linenumber <> 2)
  SELECT project_id, agency_key, arg_max(l_quantity, (l_linenumber, l_quantity)) AS minutes FROM e GROUP BY 1, 2""")
def a40(spark, sf):
    """Lines stand for legs: a supplier's key is given by every other line, by its id in the rest; a second leg has no time."""
    leg = F.struct("l_linenumber", "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("db:"), "l_suppkey")).otherwise("").alias("end_key"), F.col("l_suppkey").alias("end_id"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("minutes"))
    routes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    return admin.leg_minutes(routes)


def _clusters(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = discover.labelled(table(spark, sf, "part"), "p_partkey", "p_name")
    return rows, rows.where("id % 5 < 2")


@query("d12_coverage", "SELECT count(*) AS total, count(*) FILTER (p_partkey % 5 < 2) AS known, count(*) FILTER (p_partkey % 5 = 2) AS clustered, count(*) FILTER (p_partkey % 5 > 2) AS residual, 0::BIGINT AS overlap, true AS holds FROM part")
def d12(spark, sf):
    rows, known = _clusters(spark, sf)
    return admin.coverage(rows, rows.where("id % 5 = 2"), known)


@query("d11_destinations", """WITH m AS (SELECT p_size AS label, CASE WHEN p_partkey % 5 = 0 THEN '(residual)' ELSE 'path ' || (p_partkey % 3) END AS path FROM part), g AS (SELECT label, path, count(*) AS members FROM m GROUP BY 1, 2)
  SELECT label, path, members, round(members::DOUBLE / sum(members) OVER (PARTITION BY label), 4) AS share FROM g""")
def d11(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    new = p.where("p_partkey % 5 <> 0").select(k.alias("id"), F.concat(F.lit("path "), (k % 3).cast("string")).alias("path"))
    return admin.destinations(p.select(k.alias("id"), F.col("p_size").alias("label")), new)


@query("e28_kept_mappings", f"{WITH_SP} SELECT sp_id, product_id FROM supplier_products WHERE product_id IS NOT NULL AND sp_id % 9 = 0")
def e28(spark, sf):
    sp = bind.supplier_products(spark, sf)
    return admin.kept_mappings(sp, sp.withColumn("product_id", F.when(F.col("sp_id") % 9 != 0, F.col("product_id"))), tasks(table(spark, sf, "lineitem")))
