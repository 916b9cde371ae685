"""Derived columns of offers, and the offers that carts may use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import comparable, required_packs
from tallyforge.functions.units import units_compatible

#: Stands for a stock without limit, of a national catalogue or a live feed that says "available".
UNLIMITED = 1_000_000


def agency_key(key, agency_id) -> Column:
    """The given key, or 'db:' and the id where it is blank. Keys order as strings."""
    return F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.concat(F.lit("db:"), F.col(agency_id).cast("string")))


def geolocated() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def national() -> Column:
    """Neither place, store id, address nor city: a national catalogue."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return ~geolocated() & blank("address") & blank("city")


def unlimited() -> Column:
    return (F.col("stock") <= 0) & ((F.coalesce("fulfillment", F.lit("")) == "available") | ~geolocated())


def available_quantity() -> Column:
    return F.when(unlimited(), F.lit(UNLIMITED).cast("decimal(22,3)")).otherwise((F.col("reference_quantity") * F.col("stock")).cast("decimal(22,3)"))


def covers(packs) -> Column:
    return unlimited() | (F.col("stock") >= packs)


def visible_offers(offers: DataFrame, supplier_products: DataFrame, agencies: DataFrame, suppliers: DataFrame, products: DataFrame, imports: DataFrame) -> DataFrame:
    """Offers with their dimensions: mapped, active, from no catalogue or an active one, in a unit that fits the product."""
    live = imports.select(F.col("id").alias("catalog_id"), F.col("active").alias("catalog_active"))
    sp = supplier_products.where("active and product_id is not null")
    joined = offers.join(sp, "supplier_product_id").join(agencies, "agency_id").join(suppliers, "supplier_id").join(products, "product_id").join(live, "catalog_id", "left")
    joined = joined.where(F.col("catalog_id").isNull() | F.coalesce("catalog_active", F.lit(False)))
    return joined.where(units_compatible("product_unit", "reference_unit"))


def for_lines(lines: DataFrame, offers: DataFrame, target: str) -> DataFrame:
    """Every line with each comparable offer of its product, and how many packs it takes."""
    kept = offers.where(comparable("tax_basis", "vat_rate", target))
    return lines.join(kept, "product_id").withColumn("needed", required_packs("quantity", "reference_quantity"))


def excluded_offers(offers: DataFrame, target: str) -> DataFrame:
    """How many offers compare in a basis, and how many are left out for want of a VAT rate."""
    return offers.agg(
        F.count_if(comparable("tax_basis", "vat_rate", target)).alias("kept"), F.count_if(~comparable("tax_basis", "vat_rate", target)).alias("excluded")
    )
