"""Views of the engine's entities over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import dealt, table, tasks

UNITS = ("pièce", "m", "m²", "kg", "sac")


def products(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("product_id"), F.format_string("PRD%06d", "p_partkey").alias("code"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.element_at(F.array(*map(F.lit, UNITS)), F.col("p_size") % 5 + 1).alias("reference_unit"),
        (F.col("p_partkey") % 13 != 0).alias("is_active"), (F.col("p_partkey") % 17 == 0).alias("is_legacy"),
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier"), (F.col("s_suppkey") % 10 != 0).alias("active")
    )


def agencies(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    k, here = F.col("s_suppkey"), F.col("s_suppkey") % 9 != 0
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        k.alias("agency_id"), k.alias("supplier_id"), F.concat(F.lit("db:"), k).alias("agency_key"), F.col("s_name").alias("agency_name"),
        F.when(here, F.col("n_name")).otherwise("").alias("city"), F.when(here, F.col("r_name")).otherwise("").alias("address"),
        F.when(here, 41 + (k * 37 % 1000) / 100).alias("latitude"), F.when(here, -4 + (k * 53 % 1200) / 100).alias("longitude"),
    )


def offers(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """One line item for each part and supplier stands for an offer; its other columns break ties, but for the last one, which nothing shows.

    The join with suppliers and agencies broadcasts what Spark finds small enough, and nothing else. ``parts`` tells how many
    tasks suppliers are dealt to; where none is small enough, offers meet them without being sent again.
    """
    li = table(spark, sf, "lineitem")
    li = dealt(li, parts, "l_suppkey") if parts else li
    pick = F.struct("l_linenumber", "l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    one = li.groupBy("l_partkey", "l_suppkey").agg(F.min(pick).alias("x")).select("l_partkey", "l_suppkey", "x.*")
    ext = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    q = F.col("l_quantity").cast("bigint")
    unit_cents = F.expr("(2 * ext + q) div (2 * q)")
    base = one.withColumn("ext", ext).withColumn("q", q).select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"),
        F.format_string("R%d-%d", "l_suppkey", "l_partkey").alias("supplier_reference"),
        (unit_cents.cast("decimal(12,0)") / 100).cast("decimal(12,2)").alias("price"),
        F.when(F.col("l_returnflag") == "R", "TTC").otherwise("HT").alias("tax_basis"),
        F.when(F.col("l_linestatus") != "O", F.round(F.col("l_tax") * 100).cast("decimal(5,2)")).alias("vat_rate"),
        (1 + F.col("l_partkey") % 3).cast("decimal(12,3)").alias("reference_quantity"),
        F.when(F.col("l_orderkey") % 11 == 0, 0).otherwise(q).cast("int").alias("stock"),
        (15 * F.col("l_linenumber")).cast("int").alias("preparation_minutes"),
        F.when(F.col("l_orderkey") % 29 == 0, "delayed").when(F.col("l_orderkey") % 31 == 0, "order_only").when(F.col("l_orderkey") % 37 == 0, "unavailable").alias("fulfillment"),
    )
    s, a = suppliers(spark, sf).where("active"), agencies(spark, sf)
    return base.join(s, "supplier_id").join(a, "supplier_id")


def cart_lines(spark: SparkSession, sf: str, parts: int | None = None) -> DataFrame:
    """``parts`` tells how many tasks parts are dealt to, for what meets the lines by part."""
    li = table(spark, sf, "lineitem")
    li = dealt(li, parts, "l_partkey") if parts else li
    return li.groupBy(F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("product_id")).agg(
        F.sum("l_quantity").cast("decimal(10,3)").alias("quantity")
    )


# The same views for DuckDB, as common table expressions.
SQL = """
products AS (SELECT p_partkey AS product_id, printf('PRD%06d', p_partkey) AS code, p_name AS name, p_type AS category, p_brand AS brand,
  ['pièce', 'm', 'm²', 'kg', 'sac'][p_size % 5 + 1] AS reference_unit, p_partkey % 13 <> 0 AS is_active, p_partkey % 17 = 0 AS is_legacy FROM part),
suppliers AS (SELECT s_suppkey AS supplier_id, s_name AS supplier, s_suppkey % 10 <> 0 AS active FROM supplier),
agencies AS (SELECT s_suppkey AS agency_id, s_suppkey AS supplier_id, 'db:' || s_suppkey AS agency_key, s_name AS agency_name,
  CASE WHEN s_suppkey % 9 <> 0 THEN n_name ELSE '' END AS city, CASE WHEN s_suppkey % 9 <> 0 THEN r_name ELSE '' END AS address,
  CASE WHEN s_suppkey % 9 <> 0 THEN 41 + (s_suppkey * 37 % 1000)::DOUBLE / 100 END AS latitude,
  CASE WHEN s_suppkey % 9 <> 0 THEN -4 + (s_suppkey * 53 % 1200)::DOUBLE / 100 END AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber, l_orderkey, l_extendedprice,
  l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1),
offers AS (SELECT l_partkey AS product_id, supplier_id, printf('R%d-%d', l_suppkey, l_partkey) AS supplier_reference,
  (2 * round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT) AS price_cents,
  CASE WHEN l_returnflag = 'R' THEN 'TTC' ELSE 'HT' END AS tax_basis,
  CASE WHEN l_linestatus <> 'O' THEN round(l_tax * 100)::BIGINT END AS vat, (1 + l_partkey % 3)::BIGINT AS reference_quantity,
  CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE l_quantity::BIGINT END AS stock, 15 * l_linenumber AS preparation_minutes,
  CASE WHEN l_orderkey % 29 = 0 THEN 'delayed' WHEN l_orderkey % 31 = 0 THEN 'order_only' WHEN l_orderkey % 37 = 0 THEN 'unavailable' END AS fulfillment,
  supplier, agency_id, agency_key, agency_name, city, address, latitude, longitude
  FROM picked JOIN suppliers ON l_suppkey = supplier_id JOIN agencies USING (supplier_id) WHERE active),
cart_lines AS (SELECT l_orderkey AS cart_id, l_partkey AS product_id, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2)
"""


def supplier_products(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each supplier and part with a line item; every seventh part is unmapped.

    Line items are dealt out by part once, for the distinct and the join.
    """
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    sp = li.select("l_suppkey", "l_partkey").repartition(tasks(li), "l_partkey").distinct().join(p, F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_partkey")
    source = F.element_at(F.array(*map(F.lit, ("manual", "exact_rule", "ean", "equiv", "import"))), (k % 5 + 1).cast("int"))
    return sp.select(
        (F.col("l_suppkey") * 10_000_000 + k).alias("sp_id"), F.col("l_suppkey").alias("supplier_id"), F.format_string("R%d-%d", "l_suppkey", "l_partkey").alias("supplier_reference"),
        F.when(k % 7 != 0, k).alias("product_id"), F.when(k % 7 != 0, source).alias("correction_source"), F.col("p_name").alias("designation"), F.col("p_brand").alias("brand"),
        (k % 19 != 0).alias("active"), (F.col("l_suppkey") % 6 + 1).alias("catalog_id"),
    )


SP_SQL = """
supplier_products AS (SELECT l_suppkey * 10000000 + l_partkey AS sp_id, l_suppkey AS supplier_id, printf('R%d-%d', l_suppkey, l_partkey) AS supplier_reference,
  CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END AS product_id,
  CASE WHEN l_partkey % 7 <> 0 THEN ['manual', 'exact_rule', 'ean', 'equiv', 'import'][l_partkey % 5 + 1] END AS correction_source,
  p_name AS designation, p_brand AS brand, l_partkey % 19 <> 0 AS active, l_suppkey % 6 + 1 AS catalog_id
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)
"""
