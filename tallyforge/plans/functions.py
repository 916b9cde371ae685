"""Registered queries of single functions and small operators over whole tables, each against SQL that goes another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import money, text, units
from tallyforge.operators import catalog, discover, labels, live, projects, resolve, upsert
from tallyforge.plans.queries import WITH_SP, query
from tallyforge.session import table
from tallyforge.sources import bind, feeds


@query("t02_numbers", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 1000000 + p_size * 1000 WHEN 1 THEN p_size * 1000 + 500 WHEN 2 THEN p_size * 1000 + 250 WHEN 3 THEN -p_size * 1000 END::BIGINT AS thousandths FROM part""")
def t02(spark, sf):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' 1 ' || lpad(p_size, 3, '0') || ' ' WHEN 1 THEN p_size || ',5' WHEN 2 THEN p_size || '.250' WHEN 3 THEN '-' || p_size ELSE p_size || ' x 3' END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (text.parse_number(raw) * 1000).cast("bigint").alias("thousandths"))


@query("t03_millimetres", """WITH r AS (SELECT p_partkey AS id, p_size AS s, ['m', 'cm', 'mm', '', 'inch', 'ML'][p_partkey % 6 + 1] AS u FROM part), v AS (SELECT *, CASE u WHEN 'm' THEN s * 1000 WHEN 'ML' THEN s * 1000 WHEN 'cm' THEN s * 10 WHEN 'mm' THEN s WHEN '' THEN s END AS mm,
  CASE WHEN u = '' AND s < 20 THEN s * 1000 END AS bare FROM r) SELECT id, CASE WHEN mm BETWEEN 1 AND 10000 THEN mm END AS mm, CASE WHEN coalesce(bare, mm) BETWEEN 1 AND 10000 THEN coalesce(bare, mm) END AS loose FROM v""")
def t03(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("m", "cm", "mm", "", "inch", "ML"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), text.to_mm(F.col("p_size"), unit).alias("mm"), text.to_mm(F.col("p_size"), unit, bare_small_as_meters=True).alias("loose"))


@query("t09_loose_sizes", """SELECT p_partkey AS id, greatest((50 + p_size) * 10, 600) AS length_mm, least((50 + p_size) * 10, 600) AS width_mm, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 10 WHEN 2 THEN 100 + p_size END AS thickness_mm FROM part""")
def t09(spark, sf):
    label = F.expr("'Dalle l. ' || (50 + p_size) || ' x L. 60 cm' || CASE p_partkey % 4 WHEN 0 THEN ' ép. ' || p_size || ' mm' WHEN 1 THEN ', épaisseur ' || p_size || ' cm' WHEN 2 THEN ' ep ' || (100 + p_size) ELSE '' END")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.length_width(label).alias("s"), text.thickness_alone(label).alias("thickness_mm"))
    return p.select("id", "s.length_mm", "s.width_mm", "thickness_mm")


@query("t17_rates", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_size * 100 WHEN 1 THEN p_size * 100 + 50 WHEN 2 THEN CASE WHEN p_size <= 25 THEN p_size * 400 END END::BIGINT AS hundredths FROM part""")
def t17(spark, sf):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || '.00 ' WHEN 1 THEN p_size || ',5' WHEN 2 THEN CAST(p_size * 4 AS STRING) WHEN 3 THEN '' ELSE '-' || p_size END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (money.parse_rate(raw) * 100).cast("bigint").alias("hundredths"))


@query("t19_addresses", """WITH a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 <> 0 THEN trim(s_name) END AS street, CASE WHEN s_suppkey % 4 <> 0 THEN lpad((s_suppkey % 90000 + 1000)::VARCHAR, 5, '0') END AS code, CASE WHEN s_suppkey % 5 <> 0 THEN 'Ville ' || s_nationkey END AS city FROM supplier)
  SELECT id, concat_ws(chr(10), nullif(street, ''), nullif(concat_ws(' ', code, city), '')) AS lines FROM a""")
def t19(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    street, code, city = F.when(k % 3 != 0, F.concat(F.lit("  "), "s_name")), F.when(k % 4 != 0, F.lpad((k % 90000 + 1000).cast("string"), 5, "0")), F.when(k % 5 != 0, F.concat(F.lit("Ville "), "s_nationkey"))
    return s.select(k.alias("id"), text.address_lines(street, code, city).alias("lines"))


@query("t29_redacted", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'failed: token=*** at <url> (' || event_id || ')' WHEN 1 THEN 'Authorization: *** for ' || event_id WHEN 2 THEN substr('x' || repeat('y', 600), 1, 500) ELSE 'plain ' || event_id END AS message FROM events""")
def t29(spark, sf):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN 'failed: token=abc' || event_id || ' at https://h.example/' || event_id || ' (' || event_id || ')' WHEN 1 THEN 'Authorization: Basic for ' || event_id WHEN 2 THEN 'x' || repeat('y', 600) ELSE 'plain ' || event_id END")
    return table(spark, sf, "events").select("event_id", text.redact(raw).alias("message"))


@query("t36_timestamps", """SELECT event_id, CASE WHEN event_id % 6 < 4 THEN date_trunc(CASE event_id % 6 WHEN 0 THEN 'second' WHEN 1 THEN 'minute' WHEN 2 THEN 'day' ELSE 'minute' END, ts) END AS at FROM events""")
def t36(spark, sf):
    forms = {0: "yyyy-MM-dd'T'HH:mm:ss", 1: "yyyy-MM-dd HH:mm", 2: "yyyy-MM-dd", 3: "dd/MM/yyyy HH:mm", 4: "EEE dd MMM"}
    raw = F.lit("none")
    for k, f in forms.items():
        raw = F.when(F.col("event_id") % 6 == k, F.date_format("ts", f)).otherwise(raw)
    return table(spark, sf, "events").select("event_id", text.parse_timestamp(raw).cast("timestamp_ntz").alias("at"))


@query("t39_pack_sizes", """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 WHEN p_partkey % 6 = 1 THEN p_size + 1 WHEN p_partkey % 6 = 5 THEN 3 ELSE 1 END AS n FROM part""")
def t39(spark, sf):
    """Counted parts, sets, mixed packs, boards and a stored quantity."""
    label = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'Boîte de ' || (p_size + 1) || ' vis bois' WHEN 1 THEN 'Chevilles nylon ' || (p_size + 1) || ' pièces' WHEN 2 THEN 'Kit de vis, lot de ' || (p_size + 1) WHEN 3 THEN 'Lot de ' || (p_size + 1) || ' chevilles + vis' WHEN 4 THEN 'Lot de ' || (p_size + 1) || ' dalles' ELSE 'Lot de 10 vis' END")
    stored = F.expr("CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN NULL WHEN 5 THEN 3 ELSE 0 END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.reference_quantity(stored, label).cast("int").alias("n"))


@query("t40_attributes", """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'fraisee' WHEN p_partkey % 3 = 0 THEN 'hex' END AS head, CASE p_partkey % 4 WHEN 0 THEN 'torx' WHEN 1 THEN 'pozidriv' WHEN 2 THEN 'philips' END AS drive, CASE p_partkey % 5 WHEN 0 THEN 'zingue' WHEN 1 THEN 'inox' WHEN 2 THEN 'jaune' END AS finish FROM part""")
def t40(spark, sf):
    label = F.expr("'Vis' || CASE WHEN p_partkey % 2 = 0 THEN ' tête fraisée' WHEN p_partkey % 3 = 0 THEN ' tête hexagonale' ELSE ' tête' END || element_at(array(' TX 20', ' posidriv', ' Philips', ''), CAST(p_partkey % 4 + 1 AS INT)) || element_at(array(' zinguée', ' inox A2', ' jaune', '', ''), CAST(p_partkey % 5 + 1 AS INT))")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))
    read = labels.by_label(rows, "label", lambda x: labels.stored(x.withColumn("t", text.fold("label"))).select("label", resolve.attributes(F.col("t")).alias("a")))
    return read.select("id", *(F.col("a")[c].alias(c) for c in ("head", "drive", "finish")))


_UNITS = ("pièce", "kg", "M²", " ", None, "Sac", "litre")


@query("f08_compatible_units", """WITH u AS (SELECT p_partkey AS id, ['pièce', 'kg', 'm²', NULL, NULL, 'sac', 'L'][p_partkey % 7 + 1] AS p, ['pièce', 'kg', 'm²', NULL, NULL, 'sac', 'L'][p_size % 7 + 1] AS s FROM part) SELECT id, p IS NOT NULL AND (s IS NULL OR p = s) AS fits FROM u""")
def f08(spark, sf):
    pick = lambda c: F.element_at(F.array(*map(F.lit, _UNITS)), (F.col(c) % 7 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), units.units_compatible(pick("p_partkey"), pick("p_size")).alias("fits"))


@query("s07_sitemap", """WITH p AS (SELECT p_partkey // 10 AS page, p_partkey, p_size FROM part) SELECT (100000 + p_size)::VARCHAR AS sku, min('https://shop.example/p/' || (p_partkey % 3) || '-' || (100000 + p_size) || '.html') AS url FROM p WHERE p_partkey % 4 <> 0 GROUP BY 1""")
def s07(spark, sf):
    """Sitemaps of ten entries each, from which pages of other kinds and repeated products go."""
    part = table(spark, sf, "part")
    loc = F.expr("'<url><loc> https://shop.example/' || CASE WHEN p_partkey % 4 = 0 THEN 'guide/' ELSE 'p/' END || (p_partkey % 3) || '-' || (100000 + p_size) || '.html </loc></url>'")
    pages = part.groupBy(F.floor(F.col("p_partkey") / 10).alias("page")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), "\n"), F.lit("</urlset>")).alias("text"))
    return feeds.sitemap_skus(pages, url_part="/p/")


@query("s09_categories", """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'a/' || p_size ELSE 'a/b/' || p_size END AS x, 'promo/c/d/' || p_partkey % 5 AS y FROM part) SELECT id, CASE WHEN id % 4 = 0 THEN y ELSE x END AS category, CASE WHEN id % 5 > 0 THEN 'https://i.example/' || id END AS image FROM a""")
def s09(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("filter(array('promo/c/d/' || p_partkey % 5, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'a/' || p_size ELSE 'a/b/' || p_size END, CASE WHEN p_partkey % 4 <> 0 THEN 'a' END), x -> x IS NOT NULL)").alias("paths"),
        F.expr("array('/local.png', CASE WHEN p_partkey % 5 > 0 THEN 'https://i.example/' || p_partkey ELSE 'ftp://i.example/1' END, 'data:x')").alias("urls"),
    )
    return p.select("id", feeds.deepest_category().alias("category"), feeds.first_image().alias("image"))


@query("s11_stores", """WITH a AS (SELECT s_nationkey AS id, s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 50 + 0.5 END AS d, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 41 + s_suppkey % 7 END AS lat FROM supplier),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d NULLS LAST, s_suppkey)::INT AS rank FROM a WHERE id <> 3) SELECT id, s_suppkey AS store_id, s_name AS name, lat::DOUBLE AS latitude, d::DOUBLE AS distance, rank FROM r WHERE rank <= 5""")
def s11(spark, sf):
    """A locator's answer for each nation, nearest stores first; one answer is no JSON."""
    s = table(spark, sf, "supplier")
    item = F.struct(
        F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 50 + 0.5).alias("distance_from_location"),
        F.struct(F.struct(F.when(F.col("s_suppkey") % 2 == 0, 41 + F.col("s_suppkey") % 7).cast("double").alias("latitude")).alias("coordinates")).alias("address_data"),
    )
    items = F.array_sort(F.collect_list(item))
    body = F.to_json(F.struct(F.struct(F.struct(items.alias("items")).alias("retailers")).alias("data")))
    answers = s.groupBy(F.col("s_nationkey").alias("id")).agg(body.alias("payload")).withColumn("payload", F.when(F.col("id") == 3, "oops").otherwise(F.col("payload")))
    return feeds.parse_stores(answers, most=5).select("id", "store_id", "name", "latitude", "distance", "rank")


@query("w08_compare_and_set", f"{WITH_SP} SELECT sp_id, CASE WHEN sp_id % 3 = 0 AND catalog_id = sp_id % 6 + 1 THEN 'changed' ELSE designation END AS designation FROM supplier_products")
def w08(spark, sf):
    sp = bind.supplier_products(spark, sf)
    return upsert.compare_and_set(sp, F.col("sp_id") % 3 == 0, F.col("catalog_id") == F.col("sp_id") % 6 + 1, {"designation": F.lit("changed")}).select("sp_id", "designation")


@query("w09_children", "SELECT l_orderkey AS project_id, l_partkey AS product_id FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def w09(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("product_id"))
    given = li.where("project_id % 4 = 0").select("project_id")
    new = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("product_id")).join(given.distinct(), "project_id", "left_semi")
    return upsert.replace_children(li, given, "project_id", new.select("project_id", "product_id"))


@query("w10_delete_catalog", f"""{WITH_SP}, o AS (SELECT *, supplier_id % 6 + 1 AS catalog_id FROM offers), k AS (SELECT * FROM o WHERE catalog_id <> 2), r AS (SELECT s.*, EXISTS (SELECT 1 FROM k WHERE k.supplier_id = s.supplier_id AND k.supplier_reference = s.supplier_reference) AS used FROM supplier_products s)
  SELECT 'offers' AS kind, catalog_id, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'references', CASE WHEN catalog_id <> 2 THEN catalog_id END, count(*) FROM r WHERE catalog_id <> 2 OR product_id IS NOT NULL OR used GROUP BY 2""")
def w10(spark, sf):
    offers = bind.offers(spark, sf).withColumn("catalog_id", F.col("supplier_id") % 6 + 1)
    left, refs = upsert.delete_catalog(2, offers, bind.supplier_products(spark, sf))
    count = lambda df, kind: df.groupBy("catalog_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "catalog_id", "n")
    return count(left, "offers").unionByName(count(refs, "references"))


@query("w18_applied_matches", f"""{WITH_SP} SELECT sp_id, CASE WHEN product_id IS NULL AND sp_id % 2 = 0 THEN sp_id % 10000000 ELSE product_id END AS product_id, CASE WHEN product_id IS NULL AND sp_id % 2 = 0 THEN 'exact_rule' ELSE correction_source END AS correction_source FROM supplier_products""")
def w18(spark, sf):
    sp = bind.supplier_products(spark, sf).withColumnRenamed("sp_id", "id")
    matches = sp.select("id", F.when(F.col("id") % 2 == 0, "EXACT").otherwise("REVIEW").alias("status"), (F.col("id") % 10_000_000).alias("product_id"))
    return resolve.apply_exact(sp, matches).select(F.col("id").alias("sp_id"), "product_id", "correction_source")


@query("w22_import_counts", f"""{WITH_SP}, n AS (SELECT supplier_id, supplier_reference, CASE WHEN sp_id % 5 = 0 THEN 'new name' ELSE designation END AS designation FROM supplier_products WHERE sp_id % 7 <> 0 UNION ALL SELECT supplier_id, 'N' || supplier_id, supplier FROM suppliers)
  SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.supplier_id IS NULL THEN 'created' WHEN n.supplier_id IS NULL THEN 'absent' WHEN o.designation IS NOT DISTINCT FROM n.designation THEN 'unchanged' ELSE 'updated' END AS action FROM supplier_products o FULL JOIN n ON o.supplier_id = n.supplier_id AND o.supplier_reference = n.supplier_reference) GROUP BY 1""")
def w22(spark, sf):
    sp = bind.supplier_products(spark, sf)
    keys = ["supplier_id", "supplier_reference"]
    new = sp.where("sp_id % 7 <> 0").select(*keys, F.when(F.col("sp_id") % 5 == 0, "new name").otherwise(F.col("designation")).alias("designation"))
    new = new.unionByName(bind.suppliers(spark, sf).select("supplier_id", F.concat(F.lit("N"), "supplier_id").alias("supplier_reference"), F.col("supplier").alias("designation")))
    return upsert.action_counts(upsert.diff(sp, new, keys, ["designation"]))


@query("a27_store_subtotals", """SELECT l_orderkey AS project_id, 'db:' || l_suppkey AS agency_key, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, min(l_linenumber) AS stop, count(*) AS lines FROM lineitem GROUP BY 1, 2""")
def a27(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.concat(F.lit("db:"), "l_suppkey").alias("agency_key"), F.col("l_extendedprice").cast("decimal(12,2)").alias("planned_total"), F.col("l_linenumber").alias("stop"))
    return projects.store_subtotals(lines).select("project_id", "agency_key", money.cents("subtotal").alias("cents"), "stop", "lines")


@query("l09_provenance", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'live' WHEN event_id % 3 = 1 THEN 'cache' ELSE 'stale' END AS label FROM events")
def l09(spark, sf):
    k = F.col("event_id") % 3
    return table(spark, sf, "events").select("event_id", live.provenance(k == 0, k == 1).alias("label"))


@query("d06_heads", "SELECT p_partkey AS id, CASE WHEN p_size / 100.0 - 0.25 > 0.05 THEN p_type ELSE p_brand END AS head, CASE WHEN p_size / 100.0 - 0.25 > 0.05 THEN p_brand ELSE p_type END AS qualifier FROM part")
def d06(spark, sf):
    x = discover.head_and_qualifier(F.lit(0.25).cast("decimal(6,2)"), (F.col("p_size") / F.lit(100).cast("decimal(6,2)")).cast("decimal(6,2)"), F.col("p_brand"), F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), x.alias("x")).select("id", "x.head", "x.qualifier")


@query("r12_pages", "WITH n AS (SELECT l_suppkey AS supplier_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT supplier_id, greatest(1, (n + 49) // 50) AS pages, greatest(1, least(supplier_id % 9, greatest(1, (n + 49) // 50))) AS page FROM n")
def r12(spark, sf) -> DataFrame:
    """The page that is shown of each supplier's references, asked for by its id."""
    n = bind.supplier_products(spark, sf).groupBy("supplier_id").agg(F.count("*").alias("n"))
    pages, page = catalog.page_of("n", 50, F.col("supplier_id") % 9)
    return n.select("supplier_id", pages.alias("pages"), page.alias("page"))


@query("s12_live_products", """WITH a AS (SELECT p_partkey AS id, (p_partkey % 500)::VARCHAR AS sku, p_name || p_partkey AS name, p_size % 5 AS stock, p_partkey % 3 <> 0 AS salable FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY name) AS r FROM a),
  w AS (SELECT DISTINCT (p_partkey % 700)::VARCHAR AS sku FROM part) SELECT sku, name, CASE WHEN name IS NOT NULL THEN stock > 0 AND salable END AS in_store FROM w LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (sku)""")
def s12(spark, sf):
    """Answers of one product each; a product that comes several times counts once, and some that are asked for never come."""
    item = F.struct((F.col("p_partkey") % 500).cast("string").alias("sku"), F.concat("p_name", "p_partkey").alias("name"), (F.col("p_size") % 5).alias("stock_quantity"), (F.col("p_partkey") % 3 != 0).alias("is_salable"), F.lit(True).alias("is_offer_available"))
    body = F.to_json(F.struct(F.struct(F.struct(F.array(item).alias("items")).alias("products")).alias("data")))
    part = table(spark, sf, "part")
    found, lost = feeds.parse_live_products(part.select(body.alias("payload")), part.select((F.col("p_partkey") % 700).cast("string").alias("sku")).distinct())
    return found.select("sku", "name", "in_store").unionByName(lost.select("sku", F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("in_store")))


@query("s29_prices", """WITH r AS (SELECT p_partkey AS id, p_size AS s, p_partkey % 6 AS k FROM part) SELECT id, CASE k WHEN 0 THEN s * 100 WHEN 1 THEN s * 100 + 50 WHEN 2 THEN s * 200 END::BIGINT AS ht_cents, CASE k WHEN 0 THEN s * 120 WHEN 1 THEN NULL WHEN 3 THEN s * 300 END::BIGINT AS ttc_cents,
  CASE k WHEN 2 THEN 'm2' WHEN 3 THEN 'm2' WHEN 0 THEN 'piece' WHEN 1 THEN 'piece' END AS per FROM r""")
def s29(spark, sf):
    """Prices at one of several places of a payload, as numbers or text, by piece or by measure; malformed and empty ones have none."""
    raw = F.expr(
        "CASE p_partkey % 6 WHEN 0 THEN '{\"price\": {\"ht\": {\"piece\": ' || p_size || '}, \"ttc\": {\"piece\": \"' || (p_size * 1.2) || '\"}}}' WHEN 1 THEN '{\"price_ht\": \"' || p_size || ',50\"}'"
        " WHEN 2 THEN '{\"price\": {\"ht\": {\"piece\": null, \"measure\": ' || (2 * p_size) || '}}}' WHEN 3 THEN '{\"price\": {\"ttc\": {\"measure\": ' || (3 * p_size) || '}}, \"price_ht\": \"\"}' WHEN 4 THEN '{\"price\": [1]}' ELSE '{oops' END"
    )
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), feeds.live_price(raw).alias("p"))
    return p.select("id", money.cents("p.ht").alias("ht_cents"), money.cents("p.ttc").alias("ttc_cents"), "p.per")


@query("s06_export_products", """SELECT p_partkey::VARCHAR AS sku, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS variant, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN lpad(p_partkey::VARCHAR, 8, '0') END AS ean FROM part WHERE p_size <> 7""")
def s06(spark, sf):
    """An export for each size of parts, each with its list of products; one of them is cut off."""
    item = F.struct(F.col("p_partkey").cast("string").alias("sku"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("variant"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("ean"))
    exports = table(spark, sf, "part").groupBy("p_size").agg(F.to_json(F.struct(F.collect_list(item).alias("products"))).alias("text"))
    exports = exports.withColumn("text", F.when(F.col("p_size") == 7, F.substring("text", 1, 40)).otherwise(F.col("text")))
    good, _ = feeds.export_products(exports.select(F.col("p_size").cast("string").alias("file"), "text"))
    return good.select("sku", "variant", "name", "ean")


@query("s16_store_directory", """SELECT s_suppkey::VARCHAR AS store_id, s_name AS name, 'https://d.example/magasin/' || s_suppkey AS url, CASE WHEN s_suppkey % 3 <> 0 THEN lpad((s_suppkey % 90000 + 1000)::VARCHAR, 5, '0') END AS postal_code, 'Ville & ' || s_nationkey AS city FROM supplier WHERE s_suppkey % 5 <> 0""")
def s16(spark, sf):
    """A page of links for each nation; links that lead elsewhere are no stores."""
    s = table(spark, sf, "supplier")
    link = F.expr(
        "'<li class=\"store\"><a href=\"' || CASE WHEN s_suppkey % 5 = 0 THEN '/aide/' ELSE 'https://d.example/magasin/' END || s_suppkey || '\">' || s_name || '</a><p>' || CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey % 90000 + 1000 AS STRING), 5, '0') || ' ' ELSE '' END || 'Ville &amp; ' || s_nationkey || '</p></li>'"
    )
    pages = s.groupBy("s_nationkey").agg(F.concat(F.lit("<html><ul>\n"), F.array_join(F.collect_list(link), "\n"), F.lit("</ul></html>")).alias("html"))
    return feeds.store_directory(pages.select(F.col("s_nationkey").cast("string").alias("file"), "html"), "/magasin/").select("store_id", "name", "url", "postal_code", "city")
