"""The registered queries over the bound views, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import geo, money, text, units
from tallyforge.operators import catalog, compare, discover, live, nearest, offers as offer_ops, optimize, projects, resolve, upsert
from tallyforge.operators.components import connected_components
from tallyforge.session import dealt, table, tasks, turns, written
from tallyforge.sources import bind, demo, feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WITH = "WITH " + bind.SQL
WITH_SP = WITH + ", " + bind.SP_SQL
#: Where carts start from in the registered comparisons.
ORIGIN = (46.0, 2.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Money, packs, units, places

@query("c01_money_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (2 * round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT + 100) // 200 AS discount_cents FROM lineitem")
def c01(spark, sf):
    li = table(spark, sf, "lineitem")
    amount = F.col("l_extendedprice").cast("decimal(12,2)") * F.round("l_discount", 2).cast("decimal(4,2)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.cents(money.money_round(amount)).alias("discount_cents"))


_HT = "CASE WHEN tax_basis = 'HT' THEN price_cents WHEN vat IS NOT NULL THEN (2 * price_cents * 100 + 100 + vat) // (2 * (100 + vat)) END"
_TTC = "CASE WHEN tax_basis = 'TTC' THEN price_cents WHEN vat IS NOT NULL THEN (2 * price_cents * (100 + vat) + 100) // 200 END"


@query("c02_convert_tax", f"{WITH} SELECT product_id, supplier_reference, {_HT} AS ht_cents, {_TTC} AS ttc_cents FROM offers")
def c02(spark, sf):
    show = lambda b: money.cents(money.converted("price", "tax_basis", "vat_rate", b))
    return bind.offers(spark, sf).select("product_id", "supplier_reference", show("HT").alias("ht_cents"), show("TTC").alias("ttc_cents"))


@query("c03_required_packs", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, ((l_quantity::BIGINT + l_partkey % 3) // (1 + l_partkey % 3))::INT AS packs FROM lineitem")
def c03(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", money.required_packs("l_quantity", 1 + F.col("l_partkey") % 3).alias("packs"))


@query("t16_derived_vat", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_tax * 100)::BIGINT AS vat FROM lineitem")
def t16(spark, sf):
    ht = F.lit(100).cast("decimal(12,4)")
    ttc = (100 + F.round(F.col("l_tax") * 100)).cast("decimal(12,4)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", money.derived_vat(ht, ttc).cast("bigint").alias("vat"))


@query("t15_units", "SELECT p_partkey, [' Pcs ', 'M2', 'litres', 'Boite', 'bidon'][p_size % 5 + 1] AS raw, ['pièce', 'm²', 'L', 'boîte', 'bidon'][p_size % 5 + 1] AS unit FROM part")
def t15(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, (" Pcs ", "M2", "litres", "Boite", "bidon"))), F.col("p_size") % 5 + 1)
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"), units.normalize_unit(raw).alias("unit"))


_HAV = "2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians(latitude - {0}) / 2), 2) + cos(radians({0})) * cos(radians(latitude)) * pow(sin(radians(longitude - {1}) / 2), 2)))))"


@query("g01_haversine", f"{WITH} SELECT agency_id, round({_HAV.format('46.0::DOUBLE', '2.0::DOUBLE')}, 6) AS km FROM agencies")
def g01(spark, sf):
    return bind.agencies(spark, sf).select("agency_id", F.round(geo.haversine_km(*ORIGIN, "latitude", "longitude"), 6).alias("km"))


@query("g02_grid_legs", f"""{WITH}, l AS (SELECT a.agency_id AS a, b.agency_id AS b, round((abs(b.latitude - a.latitude) * 111.32::DOUBLE + abs(b.longitude - a.longitude) * 111.32::DOUBLE * cos(radians((a.latitude + b.latitude) / 2))) * 1.15::DOUBLE, 2) AS km
  FROM agencies a JOIN agencies b ON a.city = b.city AND a.agency_id < b.agency_id WHERE a.latitude IS NOT NULL AND b.latitude IS NOT NULL)
  SELECT a, b, km, round(km * 3 + CASE WHEN km <> 0 THEN 2 ELSE 0 END, 2) AS minutes FROM l""")
def g02(spark, sf):
    places = bind.agencies(spark, sf).where("latitude is not null")
    a, b = places.alias("a"), places.alias("b")
    pairs = a.join(b, (F.col("a.city") == F.col("b.city")) & (F.col("a.agency_id") < F.col("b.agency_id")))
    legs = pairs.select(F.col("a.agency_id").alias("a"), F.col("b.agency_id").alias("b"), geo.grid_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")).alias("km"))
    return legs.withColumn("minutes", geo.grid_minutes("km"))


@query("g08_nearest_stores", f"""{WITH}, p AS (SELECT c_custkey AS point_id, 41 + (c_custkey * 71 % 1000)::DOUBLE / 100 AS p_lat, -4 + (c_custkey * 29 % 1200)::DOUBLE / 100 AS p_lon FROM customer),
  d AS (SELECT point_id, agency_id, {_HAV.format('p_lat', 'p_lon')} AS km FROM p, agencies WHERE latitude IS NOT NULL)
  SELECT point_id, agency_id, rank, round(km, 6) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY km, agency_id)::INT AS rank FROM d) WHERE rank <= 3""")
def g08(spark, sf):
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select(k.alias("point_id"), (41 + k * 71 % 1000 / 100).alias("p_lat"), (-4 + k * 29 % 1200 / 100).alias("p_lon"))
    return nearest.nearest_places(points, bind.agencies(spark, sf), 3).withColumn("distance_km", F.round("distance_km", 6))


# Text

@query("t01_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def t01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold("text")).alias("folded"))


_TOKENS = r"list_filter(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3)"


@query("t21_tokens", f"SELECT doc_id, len({_TOKENS})::INT AS tokens, md5(array_to_string({_TOKENS}, ' ')) AS hash FROM documents")
def t21(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", text.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("tokens"), F.md5(F.array_join("w", " ")).alias("hash"))


@query("a16_term_frequencies", f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
  k AS (SELECT * FROM t WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({', '.join(repr(w) for w in discover.STOPWORDS)})),
  n AS (SELECT count(*) AS n FROM documents)
  SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, round(ln((n + 1)::DOUBLE / (count(DISTINCT doc_id) + 1)) + 1, 4) AS idf FROM k, n GROUP BY term, n""")
def a16(spark, sf):
    rows = discover.labelled(table(spark, sf, "documents"), "doc_id", "text")
    return discover.discrimination(rows)


@query("t18_strip_html", r"SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS text FROM pages")
def t18(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html("html").alias("text"))


@query("t20_search_key", r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS key FROM documents")
def t20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.search_key("text")).alias("key"))


@query("t27_identity_code", "SELECT p_partkey, 'PRD-' || upper(substr(sha1(p_name || '|' || p_brand), 1, 8)) AS code FROM part")
def t27(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.identity_code("PRD-", F.concat_ws("|", "p_name", "p_brand")).alias("code"))


@query("t33_ean", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN printf('%013d', p_partkey * 7919) WHEN p_partkey % 3 = 1 THEN printf('%08d', p_partkey) END AS ean FROM part")
def t33(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.format_string("EAN %013d", k * 7919)).when(k % 3 == 1, F.format_string("%04d-%04d", (k / 10000).cast("bigint"), k % 10000)).otherwise(F.format_string("%d", k % 1000))
    return table(spark, sf, "part").select("p_partkey", text.ean(raw).alias("ean"))


_SIZES = "p_partkey, (p_size + 1)::INT AS s FROM part"


@query("t05_measures", """SELECT p_partkey, p_size * 10 AS volume_ml, p_size * 1000 AS weight_g, CASE WHEN p_size BETWEEN 1 AND 2000 THEN p_size END AS dn, p_size + 1 AS pieces FROM part""")
def t05(spark, sf):
    p = table(spark, sf, "part")
    label = lambda f: F.format_string(f, "p_size")
    return p.select("p_partkey", text.volume_ml(label("Peinture %d cl blanche")).alias("volume_ml"), text.weight_g(label("Ciment sac %d kg")).alias("weight_g"), text.nominal_diameter(label("Tube DN %d PVC")).alias("dn"), text.piece_count(F.format_string("Vis boîte de %d", F.col("p_size") + 1)).alias("pieces"))


@query("t08_dimensions", """SELECT p_partkey, (100 + p_size) * 10 AS length_mm, (50 + p_size) * 10 AS width_mm, p_size AS thickness_mm, round(3 + p_size % 5 + 0.5, 2)::DOUBLE AS diameter_mm, (10 + p_size) AS screw_mm, 500 + p_size * 100 AS bar_mm FROM part""")
def t08(spark, sf):
    s = F.col("p_size")
    board = text.dimensions(F.format_string("Panneau %d x %d cm x %d mm", 50 + s, 100 + s, s))
    screw = text.diameter_length(F.format_string("Vis %d,5 x %d mm", 3 + s % 5, 10 + s))
    bar = text.bar_length_mm(F.format_string("Rail longueur %d mm", 500 + s * 100))
    return table(spark, sf, "part").select("p_partkey", board["length_mm"].alias("length_mm"), board["width_mm"].alias("width_mm"), board["thickness_mm"].alias("thickness_mm"), screw["diameter_mm"].cast("double").alias("diameter_mm"), screw["length_mm"].alias("screw_mm"), bar.alias("bar_mm"))


@query("f14_urls", r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/?#]+') AND length(trim(url)) <= 500 THEN trim(url) END AS url FROM pages")
def f14(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.http_url("url").alias("url"))


# Offers and comparison

@query("m02_availability", f"""{WITH} SELECT product_id, supplier_reference, agency_key, latitude IS NOT NULL AS is_geolocated, latitude IS NULL AND city = '' AND address = '' AS is_national,
  CASE WHEN stock <= 0 AND latitude IS NULL THEN 1000000 ELSE reference_quantity * stock END AS available FROM offers""")
def m02(spark, sf):
    return bind.offers(spark, sf).select("product_id", "supplier_reference", "agency_key", offer_ops.geolocated().alias("is_geolocated"), offer_ops.national().alias("is_national"), offer_ops.available_quantity().cast("bigint").alias("available"))


@query("f09_comparable", f"{WITH} SELECT count(*) FILTER (tax_basis = 'HT' OR vat IS NOT NULL) AS kept, count(*) FILTER (tax_basis <> 'HT' AND vat IS NULL) AS excluded FROM offers")
def f09(spark, sf):
    return offer_ops.excluded_offers(bind.offers(spark, sf), "HT")


_LINES = f"""{WITH}, rows AS (SELECT c.cart_id, c.quantity, o.*, (c.quantity + o.reference_quantity - 1) // o.reference_quantity AS needed,
    CASE WHEN latitude IS NOT NULL THEN {_HAV.format('46.0::DOUBLE', '2.0::DOUBLE')} ELSE 'inf'::DOUBLE END AS distance
  FROM cart_lines c JOIN offers o USING (product_id) WHERE o.tax_basis = 'HT' OR o.vat IS NOT NULL),
pooled AS (SELECT *, CASE WHEN fulfillment IS NULL AND ((stock <= 0 AND latitude IS NULL) OR stock >= needed) THEN 0 WHEN fulfillment IS NULL AND stock > 0 THEN 1
  WHEN fulfillment = 'delayed' THEN 2 WHEN fulfillment = 'order_only' THEN 3 END AS pool FROM rows),
packed AS (SELECT *, CASE WHEN pool = 1 THEN least(stock, needed) ELSE needed END AS packs FROM pooled WHERE pool IS NOT NULL),
priced AS (SELECT *, CASE WHEN tax_basis = 'HT' THEN price_cents * packs ELSE (2 * price_cents * packs * 100 + 100 + vat) // (2 * (100 + vat)) END AS cents FROM packed),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cart_id, product_id ORDER BY pool, CASE WHEN pool = 1 THEN -packs ELSE 0 END, cents, distance, preparation_minutes, supplier, agency_key, supplier_reference) AS r FROM priced) WHERE r = 1)
"""


def _best(spark, sf) -> DataFrame:
    parts = tasks(table(spark, sf, "lineitem"))
    return compare.best_lines(bind.cart_lines(spark, sf, parts), bind.offers(spark, sf, parts), "HT", ORIGIN, parts=parts)


@query("compare_best_offer", _LINES + "SELECT cart_id, product_id, supplier, supplier_reference, agency_key, packs::INT AS packs, ['available', 'partial', 'delayed', 'order_only'][pool + 1] AS availability, cents AS total_cents FROM best")
def compare_best_offer(spark, sf):
    best = _best(spark, sf)
    return best.select("cart_id", "product_id", "supplier", "supplier_reference", "agency_key", "packs", "availability", money.cents("line_total").alias("total_cents"))


@query("r02_partial_lines", _LINES + "SELECT cart_id, product_id, packs::INT AS packs, quantity - packs * reference_quantity AS missing FROM best WHERE pool = 1")
def r02(spark, sf):
    best = _best(spark, sf).where("availability = 'partial'")
    return best.select("cart_id", "product_id", "packs", F.col("missing_quantity").cast("bigint").alias("missing"))


@query("a10_option_totals", _LINES + """, asked AS (SELECT cart_id, count(*) AS n FROM cart_lines GROUP BY 1),
got AS (SELECT cart_id, sum(cents)::BIGINT AS subtotal, count(*) FILTER (pool = 0) AS full_lines, count(*) FILTER (pool = 1) AS partial_lines, count(*) AS lines, count(DISTINCT supplier) AS suppliers, count(DISTINCT agency_key) AS agencies, max(preparation_minutes) AS prep FROM best GROUP BY 1)
SELECT cart_id, coalesce(full_lines, 0) = n AS valid, coalesce(subtotal, 0) AS subtotal_cents, CASE WHEN coalesce(full_lines, 0) = n THEN subtotal END AS total_cents, coalesce(full_lines, 0) AS lines_available, coalesce(partial_lines, 0) AS lines_partial, n - coalesce(lines, 0) AS lines_unavailable, coalesce(suppliers, 0) AS supplier_count, coalesce(agencies, 0) AS agency_count, coalesce(prep, 0)::INT AS max_preparation_minutes FROM asked LEFT JOIN got USING (cart_id)""")
def a10(spark, sf):
    parts = tasks(table(spark, sf, "lineitem"))
    t = compare.cart_totals(bind.cart_lines(spark, sf, parts), bind.offers(spark, sf, parts), "HT", ORIGIN, parts)
    return t.select("cart_id", "valid", money.cents("available_subtotal").alias("subtotal_cents"), money.cents("total").alias("total_cents"), "lines_available", "lines_partial", "lines_unavailable", "supplier_count", "agency_count", F.col("max_preparation_minutes").cast("int").alias("max_preparation_minutes"))


_ASKED = "asked AS (SELECT cart_id, product_id FROM cart_lines UNION ALL SELECT cart_id, product_id + 1000000 FROM cart_lines WHERE cart_id % 10 = 0)"


@query("c07_unavailable", f"""{WITH}, {_ASKED}, seen AS (SELECT c.cart_id, c.product_id, bool_or(fulfillment IN ('delayed', 'order_only') OR (fulfillment IS NULL AND (stock > 0 OR latitude IS NULL))) AS usable, bool_or(fulfillment = 'unavailable') AS blocked, bool_or(fulfillment IS NULL) AS stocked
  FROM asked c JOIN offers o USING (product_id) WHERE o.tax_basis = 'HT' OR o.vat IS NOT NULL GROUP BY 1, 2)
  SELECT cart_id, product_id, CASE WHEN usable IS NULL AND stocked IS NULL THEN 'no_offer' WHEN coalesce(blocked, false) AND NOT stocked THEN 'unavailable' ELSE 'out_of_stock' END AS reason
  FROM asked LEFT JOIN seen USING (cart_id, product_id) WHERE NOT coalesce(usable, false)""")
def c07(spark, sf):
    lines = bind.cart_lines(spark, sf)
    absent = lines.where("cart_id % 10 = 0").withColumn("product_id", F.col("product_id") + 1_000_000)
    return compare.unavailable_lines(lines.unionByName(absent), bind.offers(spark, sf), "HT").select("cart_id", "product_id", "reason")


@query("c08_options_by_city", _LINES.replace("PARTITION BY cart_id, product_id ORDER BY", "PARTITION BY cart_id, product_id, city ORDER BY") + "SELECT cart_id, city, sum(cents)::BIGINT AS subtotal_cents, count(*) FILTER (pool = 0) AS lines_available FROM best GROUP BY 1, 2")
def c08(spark, sf):
    parts = tasks(table(spark, sf, "lineitem"))
    n = turns(parts)
    each = -(-parts // n)
    return compare.subtotals(bind.cart_lines(spark, sf, each), bind.offers(spark, sf, parts), "city", "HT", each, n)


def _demo_carts(spark, sf) -> DataFrame:
    """Carts of three demo products each, one for each customer."""
    o = table(spark, sf, "customer").select(F.col("c_custkey").alias("cart_id"))
    line = F.explode(F.array(*(F.struct((F.pmod(F.xxhash64("cart_id", F.lit(i)), F.lit(17)) + 1).alias("product_id"), (F.pmod(F.xxhash64("cart_id", F.lit(i + 10)), F.lit(9)) + 1).cast("decimal(10,3)").alias("quantity")) for i in range(3)))).alias("x")
    lines = o.select("cart_id", line).select("cart_id", "x.*").groupBy("cart_id", "product_id").agg(F.sum("quantity").cast("decimal(10,3)").alias("quantity"))
    return lines.withColumn("origin_lat", F.lit(demo.ORIGIN[0])).withColumn("origin_lon", F.lit(demo.ORIGIN[1]))


@query("c14_strategies")
def c14(spark, sf):
    """Plans for every customer, each with a cart of demo products; the search has no SQL form, a test holds it against the published rows."""
    return optimize.strategies(_demo_carts(spark, sf), F.broadcast(demo.offers(spark))).select(
        "cart_id", "strategy", "valid", money.cents("materials").alias("materials_cents"), money.cents("cost").alias("cost_cents"), "stops", F.col("km").cast("double").alias("km"), F.col("travel").cast("double").alias("travel"), F.array_join("stop_keys", ",").alias("tour")
    )


# Catalogue

@query("s01_products_page", f"{WITH} SELECT product_id, code, name FROM products WHERE is_active AND NOT is_legacy ORDER BY code LIMIT 100 OFFSET 50")
def s01(spark, sf):
    return catalog.list_products(bind.products(spark, sf), limit=100, offset=50, for_mapping=True).select("product_id", "code", "name")


@query("f02_product_search", f"{WITH} SELECT product_id, code FROM products WHERE is_active AND (contains(lower(name), 're') OR contains(lower(code), 're') OR contains(lower(category), 're'))")
def f02(spark, sf):
    return bind.products(spark, sf).where("is_active").where(text.contains_any("RE", "name", "code", "category")).select("product_id", "code")


@query("f06_references_with_offer", f"{WITH_SP} SELECT sp_id FROM supplier_products s WHERE EXISTS (SELECT 1 FROM offers o WHERE o.supplier_id = s.supplier_id AND o.supplier_reference = s.supplier_reference)")
def f06(spark, sf):
    return catalog.with_offer(bind.supplier_products(spark, sf), bind.offers(spark, sf)).select("sp_id")


@query("j07_references_without_offer", f"{WITH_SP} SELECT sp_id FROM supplier_products s WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.supplier_id = s.supplier_id AND o.supplier_reference = s.supplier_reference)")
def j07(spark, sf):
    return catalog.with_offer(bind.supplier_products(spark, sf), bind.offers(spark, sf), "without").select("sp_id")


@query("j01_visible_offers", f"""{WITH_SP} SELECT o.product_id, o.supplier_reference FROM offers o JOIN supplier_products s USING (supplier_id, supplier_reference) JOIN products p ON s.product_id = p.product_id WHERE s.active""")
def j01(spark, sf):
    o = bind.offers(spark, sf).drop("product_id", "supplier", "agency_key", "agency_name", "city", "address", "latitude", "longitude", "active")
    sp = bind.supplier_products(spark, sf).select("supplier_id", "supplier_reference", F.col("sp_id").alias("supplier_product_id"), "product_id", "active", F.lit(None).cast("string").alias("reference_unit"))
    o = o.join(sp.select("supplier_id", "supplier_reference", "supplier_product_id"), ["supplier_id", "supplier_reference"]).withColumn("catalog_id", F.lit(None).cast("bigint"))
    products = bind.products(spark, sf).select("product_id", F.col("reference_unit").alias("product_unit"))
    imports = spark.createDataFrame([(1, True)], "id bigint, active boolean")
    rows = offer_ops.visible_offers(o, sp.drop("supplier_id", "supplier_reference"), bind.agencies(spark, sf).drop("supplier_id"), bind.suppliers(spark, sf).drop("active"), products, imports)
    return rows.select("product_id", "supplier_reference")


@query("a06_product_stats", f"""{WITH_SP}, r AS (SELECT product_id, count(*) AS refs, count(*) FILTER (active) AS act FROM supplier_products WHERE product_id IS NOT NULL GROUP BY 1),
  f AS (SELECT product_id, count(*) AS offers, min(price_cents) FILTER (tax_basis = 'HT') AS ht, min(price_cents) FILTER (tax_basis = 'TTC') AS ttc FROM offers GROUP BY 1)
  SELECT p.product_id, code, coalesce(refs, 0) AS "references", coalesce(act, 0) AS active_references, coalesce(offers, 0) AS offers, ht AS min_ht_cents, ttc AS min_ttc_cents FROM products p LEFT JOIN r USING (product_id) LEFT JOIN f USING (product_id)""")
def a06(spark, sf):
    s = catalog.product_stats(bind.products(spark, sf), bind.supplier_products(spark, sf), bind.offers(spark, sf))
    return s.select("product_id", "code", "references", "active_references", "offers", money.cents("min_ht").alias("min_ht_cents"), money.cents("min_ttc").alias("min_ttc_cents"))


@query("a09_latest_order", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def a09(spark, sf):
    return catalog.latest_by(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("a12_catalog_basis", f"{WITH_SP} SELECT catalog_id, CASE WHEN count(DISTINCT tax_basis) = 1 THEN min(tax_basis) ELSE 'MIXED' END AS tax_basis, count(*) AS offers FROM offers JOIN supplier_products USING (supplier_id, supplier_reference) GROUP BY 1")
def a12(spark, sf):
    o = bind.offers(spark, sf).join(bind.supplier_products(spark, sf).select("supplier_id", "supplier_reference", "catalog_id"), ["supplier_id", "supplier_reference"])
    return catalog.catalog_basis(o)


@query("a23_coverage", f"""{WITH_SP} SELECT supplier_id, count(*) AS total, count(*) FILTER (active) AS active, count(product_id) AS mapped, count(*) FILTER (product_id IS NULL) AS unmapped, {', '.join(f"count(*) FILTER (correction_source = '{s}') AS by_{s}" for s in ('manual', 'exact_rule', 'ean', 'equiv', 'import'))} FROM supplier_products GROUP BY 1""")
def a23(spark, sf):
    return catalog.mapping_counts(bind.supplier_products(spark, sf))


@query("j08_shared_products", f"{WITH_SP} SELECT DISTINCT product_id FROM supplier_products WHERE supplier_id = 1 AND product_id IN (SELECT product_id FROM supplier_products WHERE supplier_id = 2)")
def j08(spark, sf):
    return catalog.shared_products(bind.supplier_products(spark, sf), 1, 2)


@query("a33_unmapped", f"""{WITH_SP} SELECT sp_id, s.supplier_id, s.supplier_reference, price_cents, tax_basis FROM supplier_products s LEFT JOIN offers o ON s.supplier_id = o.supplier_id AND s.supplier_reference = o.supplier_reference WHERE s.product_id IS NULL""")
def a33(spark, sf):
    return catalog.unmapped_with_cheapest(bind.supplier_products(spark, sf), bind.offers(spark, sf)).select("sp_id", "supplier_id", "supplier_reference", money.cents("price").alias("price_cents"), "tax_basis")


@query("r13_mapping_counts", f"""{WITH_SP}, m AS (SELECT s.*, EXISTS (SELECT 1 FROM offers o WHERE o.supplier_id = s.supplier_id AND o.supplier_reference = s.supplier_reference) AS offered,
  contains(lower(supplier_reference), '1') AS found FROM supplier_products s WHERE catalog_id = 2) SELECT count(*) AS total, count(product_id) AS mapped, count(*) FILTER (found) AS found, count(product_id) FILTER (found) AS found_mapped, count(*) FILTER (found AND product_id IS NOT NULL AND offered) AS filtered FROM m""")
def r13(spark, sf):
    sp = bind.supplier_products(spark, sf)
    o = bind.offers(spark, sf).withColumn("catalog_id", F.col("supplier_id") % 6 + 1)
    counts, _ = catalog.mapping_page(sp.withColumn("designation", F.lit("")).withColumn("brand", F.lit("")), o, 2, "1", "with", "with")
    return counts


@query("j11_unique_ean", f"""{WITH_SP}, own AS (SELECT printf('%08d', p_partkey * 3 // 4) AS ean, p_partkey AS product_id FROM part), u AS (SELECT ean, min(product_id) AS found_id FROM own GROUP BY 1 HAVING count(DISTINCT product_id) = 1)
  SELECT sp_id, found_id FROM supplier_products JOIN u ON printf('%08d', (sp_id % 10000000) * 3 // 4) = ean""")
def j11(spark, sf):
    p = table(spark, sf, "part").select(F.format_string("%08d", F.expr("p_partkey * 3 div 4")).alias("ean"), F.col("p_partkey").alias("product_id"))
    sp = bind.supplier_products(spark, sf).withColumn("ean", F.format_string("%08d", F.expr("sp_id % 10000000 * 3 div 4")))
    return catalog.unique_ean_matches(sp, p).select("sp_id", "found_id")


# Merges

def _versions(spark, sf):
    sp = bind.supplier_products(spark, sf)
    new = sp.where("sp_id % 3 <> 0").withColumn("designation", F.when(F.col("sp_id") % 4 == 0, F.concat("designation", F.lit(" plus"))).otherwise(F.col("designation")))
    return sp.where("sp_id % 5 <> 0"), new.withColumn("product_id", F.col("product_id") + 1)


@query("w05_catalog_diff", f"""{WITH_SP}, n AS (SELECT *, CASE WHEN sp_id % 4 = 0 THEN designation || ' plus' ELSE designation END AS d2 FROM supplier_products WHERE sp_id % 3 <> 0), o AS (SELECT * FROM supplier_products WHERE sp_id % 5 <> 0)
  SELECT coalesce(o.sp_id, n.sp_id) AS sp_id, CASE WHEN o.sp_id IS NULL THEN 'created' WHEN n.sp_id IS NULL THEN 'absent' WHEN o.designation = n.d2 THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n USING (sp_id)""")
def w05(spark, sf):
    old, new = _versions(spark, sf)
    return upsert.diff(old, new, ["sp_id"], ["designation", "brand", "active"])


@query("w21_protected_merge", f"""{WITH_SP}, n AS (SELECT *, product_id + 1 AS p2, CASE WHEN sp_id % 4 = 0 THEN designation || ' plus' ELSE designation END AS d2 FROM supplier_products WHERE sp_id % 3 <> 0), o AS (SELECT * FROM supplier_products WHERE sp_id % 5 <> 0)
  SELECT coalesce(o.supplier_id, n.supplier_id) AS supplier_id, coalesce(o.supplier_reference, n.supplier_reference) AS supplier_reference, coalesce(n.d2, o.designation) AS designation,
  CASE WHEN o.correction_source IN ('manual', 'exact_rule', 'ean', 'equiv') THEN o.product_id ELSE coalesce(n.p2, o.product_id) END AS product_id FROM o FULL JOIN n USING (sp_id)""")
def w21(spark, sf):
    old, new = _versions(spark, sf)
    return upsert.merge_references(old, new).select("supplier_id", "supplier_reference", "designation", "product_id")


@query("w06_deactivate_absent", f"{WITH_SP} SELECT sp_id, active AND sp_id % 3 <> 0 AS active FROM supplier_products WHERE sp_id % 5 <> 0")
def w06(spark, sf):
    old, new = _versions(spark, sf)
    return upsert.deactivate_absent(old, new, ["sp_id"]).select("sp_id", "active")


@query("f13_keep_first", "SELECT l_partkey, l_suppkey, count(*) - 1 AS repeated FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def f13(spark, sf):
    _, again = upsert.keep_first(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey, l_linenumber")
    return again.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("repeated"))


@query("j21_resolve_mapping", f"""{WITH_SP} SELECT sp_id, CASE WHEN sp_id % 11 = 0 THEN NULL WHEN sp_id % 2 = 0 THEN sp_id % 10000000 ELSE product_id END AS product_id FROM supplier_products""")
def j21(spark, sf):
    sp = bind.supplier_products(spark, sf)
    rows = sp.select("sp_id", "supplier_id", "supplier_reference", F.when(F.col("sp_id") % 2 == 0, F.format_string("PRD%06d", F.col("sp_id") % 10_000_000)).alias("product_code"))
    over = sp.where("sp_id % 11 = 0").select("supplier_id", "supplier_reference", F.lit(None).cast("bigint").alias("product_id"))
    return upsert.resolve_mapping(rows, bind.products(spark, sf), sp, over).select("sp_id", "product_id")


# Discovery and resolution

_SEEDED = """WITH lab AS (SELECT p_partkey AS id, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), lambda x: length(x) >= 3) AS tokens FROM part)"""


@query("d02_clusters", _SEEDED + f""", t AS (SELECT DISTINCT id, unnest(tokens) AS term FROM lab), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 25),
  k AS (SELECT * FROM df WHERE term NOT IN ({', '.join(repr(w) for w in (*discover.ATTRIBUTES, *discover.STOPWORDS))})),
  p AS (SELECT id, term AS seed FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY df DESC, term) AS r FROM t JOIN k USING (term)) WHERE r = 1),
  s AS (SELECT seed, count(*) AS size FROM p GROUP BY 1 HAVING count(*) >= 25) SELECT lab.id, s.seed, s.size FROM lab LEFT JOIN p USING (id) LEFT JOIN s USING (seed)""")
def d02(spark, sf):
    return discover.clusters_v1(discover.labelled(table(spark, sf, "part"), "p_partkey", "p_name"))


_ATTRIBUTE = lambda x: f"{x} IN ({', '.join(repr(w) for w in discover.ATTRIBUTES)})"
_PAIRS = f"""{_SEEDED}, tok AS (SELECT id, list_filter(tokens, lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({', '.join(repr(w) for w in discover.STOPWORDS)})) AS t FROM lab),
  pr AS (SELECT DISTINCT id, t[i] || ' ' || t[i + 1] AS term FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM tok)), un AS (SELECT DISTINCT id, unnest(t) AS term FROM tok),
  rk AS (SELECT *, {_ATTRIBUTE("split_part(term, ' ', 1)")} AS a, {_ATTRIBUTE("split_part(term, ' ', 2)")} AS b FROM pr)"""


_CLUSTERED = f"""{_PAIRS},
  d1 AS (SELECT term, (a OR b)::INT AS worse, count(*) AS df FROM rk WHERE NOT (a AND b) GROUP BY term, a, b HAVING count(*) >= 15),
  p1 AS (SELECT id, term AS seed FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY worse, df DESC, term) AS r FROM pr JOIN d1 USING (term)) WHERE r = 1),
  g1 AS (SELECT id, seed, 'bigram' AS kind, count(*) OVER (PARTITION BY seed) AS size FROM p1 QUALIFY size >= 15),
  u2 AS (SELECT * FROM un WHERE id NOT IN (SELECT id FROM g1)), d2 AS (SELECT term, count(*) AS df FROM u2 WHERE NOT {_ATTRIBUTE('term')} GROUP BY 1 HAVING count(*) >= 25),
  p2 AS (SELECT id, term AS seed FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY df DESC, term) AS r FROM u2 JOIN d2 USING (term)) WHERE r = 1),
  g2 AS (SELECT id, seed, 'unigram' AS kind, count(*) OVER (PARTITION BY seed) AS size FROM p2 QUALIFY size >= 25), g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2),
  v AS (SELECT seed, round(ln(((SELECT count(*) FROM lab) + 1)::DOUBLE / (count(*) + 1)) + 1, 4) AS idf FROM (SELECT DISTINCT seed FROM g2) JOIN un ON term = seed GROUP BY 1),
  low AS (SELECT CASE WHEN count(*) >= 4 THEN round(median(idf), 4) ELSE 1.0 END AS low FROM v),
  s AS (SELECT g.id, g.seed AS parent FROM g LEFT JOIN v USING (seed), low WHERE size >= 200 OR (kind = 'unigram' AND idf < low AND size >= 24)),
  c AS (SELECT s.parent, s.id, rk.term, rk.a, rk.b FROM s JOIN rk USING (id) WHERE rk.term <> s.parent AND NOT (a AND b)), dc AS (SELECT parent, term, (a OR b)::INT AS worse, count(*) AS df FROM c GROUP BY parent, term, a, b HAVING count(*) >= 12),
  pc AS (SELECT id, parent, term AS seed FROM (SELECT c.id, parent, term, row_number() OVER (PARTITION BY parent, c.id ORDER BY worse, df DESC, term) AS r FROM c JOIN dc USING (parent, term)) WHERE r = 1),
  gc AS (SELECT id, seed AS child, count(*) OVER (PARTITION BY parent, seed) AS n FROM pc QUALIFY n >= 12)"""


@query("d03_clusters_v2", _CLUSTERED + " SELECT lab.id, kind, seed, size, child FROM lab LEFT JOIN g USING (id) LEFT JOIN gc USING (id)")
def d03(spark, sf):
    return discover.clusters_v2(discover.labelled(table(spark, sf, "part"), "p_partkey", "p_name"))


@query("d07_generic_groups", _CLUSTERED + """, z AS (SELECT seed, kind, count(*) AS size FROM g GROUP BY 1, 2), sp AS (SELECT DISTINCT parent FROM s),
  sh AS (SELECT seed, count(*) AS n FROM (SELECT g.seed, un.term, count(*) AS k, any_value(g.size) AS size FROM g JOIN un USING (id) GROUP BY 1, 2) WHERE k > 0.3 * size AND NOT list_contains(string_split(seed, ' '), term) GROUP BY 1),
  lp AS (SELECT parent, count(*) AS n FROM dc GROUP BY 1), tc AS (SELECT s.parent, max(gc.n) AS n FROM s JOIN gc USING (id) GROUP BY 1)
  SELECT z.seed, kind, size, sp.parent IS NOT NULL AS split, round(coalesce(tc.n, 0)::DOUBLE / size, 4) AS top_child_share, coalesce(lp.n, 0) AS local_pairs, coalesce(sh.n, 0) AS shared_tokens,
    CASE WHEN kind = 'bigram' AND sp.parent IS NULL THEN false ELSE sp.parent IS NOT NULL AND round(coalesce(tc.n, 0)::DOUBLE / size, 4) < 0.4 AND coalesce(lp.n, 0) > 8 OR coalesce(sh.n, 0) > 12 OR kind = 'unigram' AND v.idf < low.low END AS generic
  FROM z LEFT JOIN sp ON sp.parent = seed LEFT JOIN sh USING (seed) LEFT JOIN lp ON lp.parent = seed LEFT JOIN tc ON tc.parent = seed LEFT JOIN v USING (seed), low""")
def d07(spark, sf):
    groups, _ = discover.group_report(discover.labelled(table(spark, sf, "part"), "p_partkey", "p_name"))
    return groups.select("seed", "kind", "size", "split", "top_child_share", "local_pairs", "shared_tokens", "generic")


_REPORT = ORACLE["d02_clusters"].replace("SELECT lab.id, s.seed, s.size FROM lab LEFT JOIN p USING (id) LEFT JOIN s USING (seed)", """, m AS (SELECT p.id, s.seed, s.size FROM p JOIN s USING (seed)),
  w AS (SELECT seed, size, term, count(*) AS df FROM m JOIN t USING (id) WHERE NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (%s) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY df DESC, term) AS r FROM w)
  SELECT seed, size, round(max(df::DOUBLE / size) FILTER (term <> seed), 4) AS cohesion, string_agg(term, ' ' ORDER BY r) AS top FROM r WHERE r <= 10 GROUP BY 1, 2""" % ", ".join(repr(w) for w in discover.STOPWORDS)).replace("HAVING count(*) >= 25) , m", "HAVING count(*) >= 25), m")


@query("a18_cluster_report", _REPORT)
@query("d18_cluster_report", _REPORT)
def a18(spark, sf):
    rows = discover.labelled(table(spark, sf, "part"), "p_partkey", "p_name")
    r = discover.cluster_report(rows, discover.clusters_v1(rows))
    return r.select("seed", "size", "cohesion", F.array_join(F.transform("top_tokens", lambda x: x["term"]), " ").alias("top"))


@query("a20_overlaps", """WITH m AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS m FROM lineitem), n AS (SELECT f, count(*) AS n FROM m GROUP BY 1),
  p AS (SELECT a.f AS a, b.f AS b, count(*) AS shared FROM m a JOIN m b ON a.m = b.m AND a.f < b.f GROUP BY 1, 2)
  SELECT a, b, shared, round(shared::DOUBLE / x.n, 4) AS a_in_b, round(shared::DOUBLE / y.n, 4) AS b_in_a, round(shared::DOUBLE / (x.n + y.n - shared), 4) AS jaccard FROM p JOIN n x ON a = x.f JOIN n y ON b = y.f""")
def a20(spark, sf):
    li = table(spark, sf, "lineitem")
    return discover.overlaps(li.select(F.col("l_suppkey").alias("family"), F.col("l_partkey").alias("id")), parts=tasks(li))


@query("a21_components")
def a21(spark, sf):
    """Parts that orders connect, over all line items; no SQL, as the recursion is too slow there: tests hold it against brute force."""
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    first = e.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"))
    return connected_components(e.join(first, "l_orderkey").select("a", F.col("l_partkey").alias("b")))


def _labels(spark, sf) -> DataFrame:
    """Labels of parts by formula: screws, boards, rails, cement and others."""
    s, k = F.col("p_size"), F.col("p_partkey")
    text_ = (
        F.when(k % 6 == 0, F.format_string("Vis béton %d x %d mm", 4 + s % 4, 20 + s)).when(k % 6 == 1, F.format_string("Panneau OSB 3 2500 x 1250 x %d mm", 9 + s % 12))
        .when(k % 6 == 2, F.format_string("Rail R48 longueur %d mm", F.when(s % 2 == 0, 2490).otherwise(3000))).when(k % 6 == 3, F.format_string("Ciment gris sac %d kg", 20 + s % 20))
        .when(k % 6 == 4, F.concat(F.lit("Embout de vis "), "p_name")).otherwise(F.col("p_name"))
    )
    return table(spark, sf, "part").select(k.alias("id"), text_.alias("designation"), s.alias("s"))


@query("e10_rule_coverage", "SELECT rule, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'VIS_BETON' WHEN 1 THEN 'PANNEAU_OSB' WHEN 2 THEN 'OSSATURE_RAIL' WHEN 3 THEN 'CIMENT' END AS rule FROM part) GROUP BY 1")
def e10(spark, sf):
    return resolve.extract(_labels(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


#: One label form for each category of screws, plugs and bolts.
_FASTENERS = {
    "BOULON": "Boulons TRCC zingués", "CHEVILLE_METAL": "Cheville métallique à expansion", "CHEVILLE_NYLON": "Cheville DuoPower", "GOUJON": "Goujon d'ancrage", "TIREFOND": "Tire-fond tête hexagonale",
    "VIS_AGGLO": "Vis agglo tête fraisée", "VIS_BETON": "Béton : vis directe", "VIS_BOIS": "Bois : vis torx", "VIS_METAUX": "Vis mécanique", "VIS_MULTI": "Vis multi-matériaux",
    "VIS_PLACO": "Vis plaq platre", "VIS_TERRASSE": "Vis terrasse inox", "VIS_TOLE": "Vis tôle",
}
#: The bars: a form, the profile and the length that it names, with %d for the size.
_BARS = {
    "CORNIERE_PVC": ("Cornière PVC blanche adhésive 30 x %d mm longueur 2 m", "'30X' || d || '_blanc_ADH'", 2000), "FER_BETON": ("Fer à béton Ø %d mm - L. 6 m", "'D' || d", 6000),
    "ROND_ACIER": ("Rond acier étiré %d mm 2 m", "'D' || d", 2000), "TUBE_ROND_ACIER": ("Tube rond acier %d x 1,5 mm longueur 299 cm", "d || 'X1,5'", 3000),
}


def _form(forms, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, forms)), (k % len(forms) + 1).cast("int"))


@query("e04_fasteners", f"SELECT p_partkey AS id, {list(_FASTENERS)}[p_partkey % {len(_FASTENERS)} + 1] AS rule, (4 + p_size % 4)::DOUBLE AS diameter_mm, 20 + p_size AS length_mm FROM part")
def e04_fasteners(spark, sf):
    """A size out of bounds before the real one is skipped."""
    k, s = F.col("p_partkey"), F.col("p_size")
    labels = table(spark, sf, "part").select(k.alias("id"), F.format_string("%s 1 x 5 - %d x %d mm", _form(_FASTENERS.values(), k), 4 + s % 4, 20 + s).alias("designation"))
    found = resolve.extract(labels)
    return found.select("id", "rule", F.col("identity")["diameter_mm"].cast("double").alias("diameter_mm"), F.col("identity")["length_mm"].cast("int").alias("length_mm"))


_BAR_CASES = " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(_BARS)))


@query("e04_bars", f"""SELECT id, {list(_BARS)}[n + 1] AS rule, CASE n {_BAR_CASES.format(*(x[1] for x in _BARS.values()))} END AS profile, {[x[2] for x in _BARS.values()]}[n + 1] AS length_mm
  FROM (SELECT p_partkey AS id, p_partkey % {len(_BARS)} AS n, (31 + p_size % 10)::INT AS d FROM part)""")
def e04_bars(spark, sf):
    k = F.col("p_partkey")
    labels = table(spark, sf, "part").select(
        k.alias("id"), F.replace(_form([x[0] for x in _BARS.values()], k), F.lit("%d"), (31 + F.col("p_size") % 10).cast("string")).alias("designation")
    )
    found = resolve.extract(labels)
    return found.select("id", "rule", F.col("identity")["profile"].alias("profile"), F.col("identity")["nominal_length_mm"].cast("int").alias("length_mm"))


@query("a30_catalog_hash", f"""{WITH_SP}, p AS (SELECT sp_id // 100000 AS k, sha256(string_agg(sp_id || ':' || coalesce(product_id::VARCHAR, 'None'), chr(10) ORDER BY sp_id)) AS h FROM supplier_products GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY k)) AS hash FROM p""")
def a30(spark, sf):
    return discover.catalog_hash(bind.supplier_products(spark, sf), "sp_id", "product_id")


# Projects and live offers

@query("a28_fingerprints", "SELECT l_orderkey AS project_id, string_agg(l_partkey || ':' || q || '.000', '|' ORDER BY l_partkey) AS fingerprint FROM (SELECT l_orderkey, l_partkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a28(spark, sf):
    return projects.fingerprints(bind.cart_lines(spark, sf).withColumnRenamed("cart_id", "project_id"))


@query("a32_project_status", """WITH m AS (SELECT l_orderkey AS project_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS project_id, coalesce(n, 0) AS n_materials, CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN n IS NULL OR o_orderkey % 3 = 1 THEN CASE WHEN n IS NULL THEN 'none' ELSE 'retained' END ELSE 'obsolete' END AS status FROM orders LEFT JOIN m ON o_orderkey = project_id""")
def a32(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"))
    m = bind.cart_lines(spark, sf).withColumnRenamed("cart_id", "project_id")
    kept = projects.fingerprints(m).where("project_id % 3 <> 0").withColumn("fingerprint", F.when(F.col("project_id") % 3 == 1, F.col("fingerprint")).otherwise("changed"))
    return projects.project_status(o, m, kept)


@query("a26_planned_actual", """WITH l AS (SELECT l_orderkey AS project_id, l_partkey, sum(round(l_extendedprice * 100)::BIGINT) AS planned, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN q * 1050 END AS actual FROM l)
  SELECT project_id, sum(planned)::BIGINT AS planned_cents, sum(CASE WHEN actual IS NOT NULL THEN planned END)::BIGINT AS planned_completed_cents, sum(actual)::BIGINT AS actual_completed_cents, count(actual) AS lines_completed, count(*) AS lines FROM t GROUP BY 1""")
def a26(spark, sf):
    li = table(spark, sf, "lineitem")
    lines = dealt(li.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"), tasks(li), "l_orderkey", "l_partkey")
    planned = lines.groupBy(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("line_key")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("planned_total"), F.sum("l_quantity").cast("decimal(10,3)").alias("q"))
    bought = planned.where("line_key % 2 = 0").select("project_id", "line_key", F.col("q").alias("actual_quantity"), F.lit("10.50").cast("decimal(12,2)").alias("actual_price"), F.lit(True).alias("bought"))
    t = projects.planned_against_actual(projects.tracked_lines(planned, bought))
    return t.select("project_id", money.cents("planned").alias("planned_cents"), money.cents("planned_completed").alias("planned_completed_cents"), money.cents("actual_completed").alias("actual_completed_cents"), "lines_completed", "lines")


def _updates(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.col("event_id")
    return e.select(
        F.lit("c").alias("connector"), F.col("user_id").cast("string").alias("store"), F.col("event_type").alias("supplier_reference"), F.when(k % 2 == 0, F.round("value", 2)).alias("price_ht"), F.lit(None).cast("double").alias("price_ttc"),
        F.col("ts").alias("price_fetched_at"), F.expr("ts + interval 2 days").alias("price_expires_at"), F.when(k % 3 != 0, (k % 7).cast("int")).alias("stock"), F.col("ts").alias("stock_fetched_at"), F.expr("ts + interval 6 hours").alias("stock_expires_at"),
        F.lit(True).alias("is_salable"), F.lit(True).alias("is_offer_available"), k.alias("event_id"),
    )


_CACHE = """WITH u AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 END AS price, CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END AS stock FROM events),
  c AS (SELECT user_id, event_type, max(ts) FILTER (price IS NOT NULL) + INTERVAL 2 DAY AS pe, max(ts) FILTER (stock IS NOT NULL) + INTERVAL 6 HOUR AS se, (max({'t': ts, 's': stock}) FILTER (stock IS NOT NULL)).s AS st FROM u WHERE %s GROUP BY 1, 2),
  w AS (SELECT DISTINCT user_id, event_type FROM events),
  s AS (SELECT w.*, pe, st, pe IS NOT NULL AND pe > TIMESTAMP '2024-01-29 00:00:00' AS pf, se IS NOT NULL AND se > TIMESTAMP '2024-01-29 00:00:00' AS sf, pe IS NULL AND se IS NULL AS none FROM w LEFT JOIN c USING (user_id, event_type)),
  f AS (SELECT user_id::VARCHAR AS store, event_type AS supplier_reference, CASE WHEN none THEN 'missing' WHEN sf AND (pf OR pe IS NULL AND st = 0) THEN 'fresh' WHEN pf THEN 'price_fresh_stock_stale' WHEN sf AND pe IS NULL THEN 'stock_only' WHEN sf THEN 'stock_fresh_price_stale' ELSE 'stale' END AS freshness FROM s)"""
_NOW = "timestamp_ntz '2024-01-29 00:00:00'"


@query("l03_freshness", _CACHE.replace("%s", "true") + " SELECT store, supplier_reference, freshness FROM f")
def l03(spark, sf):
    return live.latest_offers(_updates(spark, sf)).select("store", "supplier_reference", live.freshness(F.expr(_NOW)).alias("freshness"))


@query("l04_refresh_plan", _CACHE.replace("%s", "user_id % 4 <> 0") + " SELECT store, supplier_reference, freshness, freshness <> 'fresh' AS needs_refresh FROM f")
def l04(spark, sf):
    """The plan for all keys, of which a quarter of the stores has no cached row."""
    u = _updates(spark, sf)
    return live.refresh_plan(u, live.latest_offers(u.where("store % 4 <> 0")), F.expr(_NOW)).drop("connector")


@query("l01_store_cache", """WITH a AS (SELECT user_id, ts, props, event_id FROM events WHERE event_id % 7 <> 0), l AS (SELECT user_id, max({'t': ts, 'p': '{"n": ' || event_id || '}'}) AS x FROM a GROUP BY 1)
  SELECT 'c' AS connector, l.user_id::VARCHAR AS lookup, x.p AS payload, x.t + INTERVAL 2 DAY > TIMESTAMP '2024-01-29 00:00:00' AS is_fresh FROM l WHERE l.user_id % 3 <> 0 OR x.t + INTERVAL 2 DAY > TIMESTAMP '2024-01-29 00:00:00'""")
def l01(spark, sf):
    """Answers for all users in two rounds; those with a secret are refused. A third of the look-ups takes no stale answer."""
    e = table(spark, sf, "events")
    payload = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"session": '), "event_id", F.lit("}"))).otherwise(F.concat(F.lit('{"n": '), "event_id", F.lit("}")))
    answers = e.select(F.lit("c").alias("connector"), F.col("user_id").cast("string").alias("lookup"), payload.alias("payload"), F.col("ts").alias("fetched_at"), "event_id")
    cache = answers.limit(0).drop("event_id").withColumn("expires_at", F.col("fetched_at"))
    for half in (1, 0):
        cache = live.put_stores(cache, answers.where(F.col("event_id") % 2 == half), "2 days")
    found = [live.get_stores(cache, answers.where((F.col("lookup").cast("long") % 3 == 0) == strict), F.expr(_NOW), allow_stale=not strict) for strict in (True, False)]
    return found[0].unionByName(found[1]).select("connector", "lookup", "payload", "is_fresh")


@query("s18_concentration", """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), t AS (SELECT n FROM c ORDER BY n DESC LIMIT 2), s AS (SELECT max(n) AS a, sum(n) AS b FROM t), z AS (SELECT sum(n) AS t FROM c)
  SELECT round(a * 100::DOUBLE / t, 2) AS top1, round(b * 100::DOUBLE / t, 2) AS top2, round(b * 100::DOUBLE / t, 2) > 70 AS warning FROM s, z""")
def s18(spark, sf):
    return feeds.concentration(table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")))


@query("s17_round_robin", """SELECT p_partkey::VARCHAR AS sku, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY p_type) AS f FROM part) ORDER BY turn, f LIMIT 100""")
def s17(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("sku"), "p_type", "p_partkey")
    return feeds.round_robin(rows, "p_type", "p_partkey", 100).select("sku", "p_type")


@query("x01_missing_products", f"{WITH} SELECT DISTINCT l_partkey + 500 AS product_id FROM lineitem WHERE l_partkey + 500 NOT IN (SELECT product_id FROM products)")
def x01(spark, sf):
    asked = table(spark, sf, "lineitem").select((F.col("l_partkey") + 500).alias("product_id"))
    return catalog.look_up(bind.products(spark, sf), asked, "product_id")[1]


@query("ext_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_windows(spark, sf):
    """Extension: hourly event counts; the streaming form is tallyforge.streaming.offers.event_counts."""
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


from tallyforge.plans import administration, functions, maintenance, resolution  # noqa: E402, F401  register their queries
