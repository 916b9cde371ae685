"""Catalogue queries: filters, joins, aggregates, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import contains_any


def list_products(products: DataFrame, query: str = "", limit: int = 100, offset: int = 0, for_mapping: bool = False, include_legacy: bool = False, include_inactive: bool = False) -> DataFrame:
    """A page of products in code order; for mapping, legacy ones are left out."""
    rows = products if include_inactive else products.where("is_active")
    if for_mapping and not include_legacy:
        rows = rows.where("not is_legacy")
    if query:
        rows = rows.where(contains_any(query, *(c for c in ("name", "code", "category", "subcategory") if c in rows.columns)))
    return rows.orderBy("code").offset(offset).limit(limit)


def look_up(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the asked keys, and the keys that have none."""
    return rows.join(ids, key, "left_semi"), ids.join(rows, key, "left_anti").select(key).distinct()


def three_state(condition: Column, state: str) -> Column:
    """'with', 'without' or 'all' of a condition."""
    return {"with": condition, "without": ~condition, "all": F.lit(True)}[state]


def with_offer(supplier_products: DataFrame, offers: DataFrame, state: str = "with") -> DataFrame:
    keys = ["supplier_id", "supplier_reference"]
    return supplier_products if state == "all" else supplier_products.join(offers.select(*keys), keys, "left_semi" if state == "with" else "left_anti")


def in_catalog(supplier_products: DataFrame, offers: DataFrame, catalog_id: int) -> DataFrame:
    """Introduced by a catalogue, or with an offer in it."""
    keys = ["supplier_id", "supplier_reference"]
    there = offers.where(F.col("catalog_id") == catalog_id).select(*keys).distinct().withColumn("__there", F.lit(True))
    return supplier_products.join(there, keys, "left").where((F.col("catalog_id") == catalog_id) | F.col("__there")).drop("__there")


def product_stats(products: DataFrame, supplier_products: DataFrame, offers: DataFrame) -> DataFrame:
    """References and offers of each product, and the least raw price in either basis."""
    refs = supplier_products.where("product_id is not null").groupBy("product_id").agg(F.count("*").alias("references"), F.count_if("active").alias("active_references"))
    price = lambda b: F.min(F.when(F.col("tax_basis") == b, F.col("price")))
    per = offers.groupBy("product_id").agg(F.count("*").alias("offers"), price("HT").alias("min_ht"), price("TTC").alias("min_ttc"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return products.join(refs, "product_id", "left").join(per, "product_id", "left").select(
        "product_id", "code", zero("references"), zero("active_references"), zero("offers"), "min_ht", "min_ttc"
    )


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order that leaves no tie."""
    by = ", ".join(order)
    return rows.withColumn("__r", F.expr(f"row_number() over (partition by {', '.join(keys)} order by {by})")).where("__r = 1").drop("__r")


def mapping_counts(supplier_products: DataFrame) -> DataFrame:
    """Coverage of each supplier: references, active, mapped, and mapped by source."""
    source = lambda s: F.count_if(F.col("correction_source") == s).alias(f"by_{s}")
    return supplier_products.groupBy("supplier_id").agg(
        F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(F.col("product_id").isNotNull()).alias("mapped"),
        F.count_if(F.col("product_id").isNull()).alias("unmapped"), *(source(s) for s in ("manual", "exact_rule", "ean", "equiv", "import")),
    )


def shared_products(supplier_products: DataFrame, a: int, b: int) -> DataFrame:
    """Products that both suppliers have."""
    mapped = supplier_products.where("product_id is not null")
    return mapped.where(F.col("supplier_id") == a).join(mapped.where(F.col("supplier_id") == b).select("product_id"), "product_id", "left_semi").select("product_id").distinct()


def mapping_page(supplier_products: DataFrame, offers: DataFrame, catalog_id: int, query: str = "", mapping: str = "all", price: str = "all", page: int = 1, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(counts, page): counts in three scopes in one pass - all, found by the search, and filtered - and the page.

    A page beyond the last is the last. The page is the only part that is limited.
    """
    keys = ["supplier_id", "supplier_reference"]
    offered = offers.select(*keys).distinct().withColumn("__offer", F.lit(True))
    rows = in_catalog(supplier_products, offers, catalog_id).join(offered, keys, "left").withColumn("__offer", F.coalesce("__offer", F.lit(False)))
    found = contains_any(query, "supplier_reference", "designation", "brand") if query else F.lit(True)
    kept = found & three_state(F.col("product_id").isNotNull(), mapping) & three_state(F.col("__offer"), price)
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("product_id").isNotNull()).alias("mapped"), F.count_if(found).alias("found"),
        F.count_if(found & F.col("product_id").isNotNull()).alias("found_mapped"), F.count_if(kept).alias("filtered"),
    )
    n = counts.first()["filtered"] or 0
    page = clamp_page(n, size, page)
    return counts, rows.where(kept).drop("__offer").orderBy("supplier_reference").offset((page - 1) * size).limit(size)


def page_of(total, size: int, asked: Column) -> tuple[Column, Column]:
    """(pages, page) as columns: one page at least, and the page that is shown for the one asked for."""
    pages = F.greatest(F.lit(1), F.ceil((total if isinstance(total, Column) else F.col(total)) / size)).cast("bigint")
    return pages, F.greatest(F.lit(1), F.least(asked, pages)).cast("bigint")


def clamp_page(total: int, size: int, page: int) -> int:
    return max(1, min(page, max(1, -(-total // size))))


def catalog_basis(offers: DataFrame, by: str = "catalog_id") -> DataFrame:
    """The tax basis of each catalogue: the only one, MIXED if several."""
    return offers.groupBy(by).agg(F.when(F.countDistinct("tax_basis") == 1, F.min("tax_basis")).otherwise("MIXED").alias("tax_basis"), F.count("*").alias("offers"))


def unmapped_with_cheapest(supplier_products: DataFrame, offers: DataFrame) -> DataFrame:
    """Unmapped references with their offer of the least raw price, whatever its basis."""
    keys = ["supplier_id", "supplier_reference"]
    best = offers.groupBy(*keys).agg(F.min(F.struct("price", "tax_basis")).alias("x"))
    return supplier_products.where("product_id is null").join(best, keys, "left").select("sp_id", *keys, "x.price", "x.tax_basis")


def unique_ean_matches(supplier_products: DataFrame, owners: DataFrame) -> DataFrame:
    """Matches by bar code, for codes that a single product owns. ``owners``: ean, product_id."""
    unique = owners.where("ean is not null").groupBy("ean").agg(F.countDistinct("product_id").alias("n"), F.min("product_id").alias("found_id")).where("n = 1")
    return supplier_products.join(unique.select("ean", "found_id"), "ean")
