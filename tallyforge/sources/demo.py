"""The demonstration catalogue: 20 products, two suppliers with three agencies each, 120 offers, by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# List prices of products 1 to 20, units of a pack at both suppliers where it isn't one,
# and the agencies' labels and places (the second supplier's lie 0.006 and 0.008 degrees further).
PRICES = ("9.80", "3.20", "4.10", "6.50", "24.90", "7.40", "0.03", "0.12", "1.25", "2.80", "5.30", "4.60", "8.70", "1.85", "4.30", "18.90", "12.50", "32.00", "3.80", "3.10")
PACKS = {4: (6, 8), 7: (100, 200), 8: (150, 75), 9: (25, 50), 11: (4, 3)}
AGENCIES = (("Paris Est", 48.84, 2.41), ("Ivry", 48.81, 2.39), ("Saint-Denis", 48.93, 2.36))
SUPPLIERS = ("Westhall", "Eastgate")
ORIGIN = (48.8566, 2.3522)


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, f"PRD{i:04d}", f"Product {i:02d}", p) for i, p in enumerate(PRICES, 1)], "product_id long, code string, name string, base string"
    ).withColumn("base", F.col("base").cast("decimal(12,2)"))


def offers(spark: SparkSession) -> DataFrame:
    """Offers in the engine's form; suppliers take turns in being the cheaper one."""
    packs = spark.createDataFrame([(i, s, PACKS.get(i, (1, 1))[s]) for i in range(1, len(PRICES) + 1) for s in (0, 1)], "product_id long, s int, pack int")
    places = spark.createDataFrame(
        [(s, a, SUPPLIERS[s], 3 * s + a + 1, f"{SUPPLIERS[s]} · {n}", n, lat + s * 0.006, lon + s * 0.008) for s in (0, 1) for a, (n, lat, lon) in enumerate(AGENCIES)],
        "s int, a int, supplier string, agency_id long, agency_name string, city string, latitude double, longitude double",
    )
    factor = F.when(F.col("product_id") % 2 == F.col("s"), F.lit("0.92")).otherwise(F.lit("1.07")).cast("decimal(5,3)") + F.col("a") * F.lit("0.025").cast("decimal(5,3)")
    stock = (F.col("product_id") * 13 + F.col("s") * 17 + F.col("a") * 29) % 110 + 8
    none = (F.col("product_id") == 20) | ((F.col("product_id") == 18) & (F.col("s") == 0))
    return products(spark).join(packs, "product_id").join(places, "s").select(
        "product_id", "supplier", F.format_string("%s-%05d", F.when(F.col("s") == 0, "W").otherwise("E"), F.col("product_id") * 137).alias("supplier_reference"),
        F.bround(F.col("base") * F.col("pack") * factor, 2).cast("decimal(12,2)").alias("price"), F.lit("HT").alias("tax_basis"),
        F.lit(None).cast("decimal(5,2)").alias("vat_rate"), F.col("pack").cast("decimal(12,3)").alias("reference_quantity"),
        F.when(none, 0).otherwise(stock).cast("int").alias("stock"), (30 + (F.col("product_id") + F.col("s") + F.col("a")) % 5 * 30).cast("int").alias("preparation_minutes"),
        F.lit(None).cast("string").alias("fulfillment"), "agency_id", F.concat(F.lit("db:"), "agency_id").alias("agency_key"), "agency_name", "city",
        F.lit("").alias("address"), "latitude", "longitude",
    )
