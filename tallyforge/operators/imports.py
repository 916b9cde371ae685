"""Import of a supplier's offer file: one set of new table versions from a whole file, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.upsert import PROTECTED, resolve_mapping
from tallyforge.session import ensure_checkpoint_dir

#: The columns of the tables that an import writes.
TABLES = {
    "suppliers": "supplier_id long, supplier string, source_type string, source_key string",
    "agencies": "agency_id long, supplier_id long, external_id string, agency_name string, address string, postal_code string, city string, latitude double, longitude double",
    "references": "sp_id long, supplier_id long, supplier_reference string, product_id long, designation string, brand string, ean string, image_url string, supplier_unit string, reference_unit string, "
    "reference_quantity decimal(12,3), packaging_quantity decimal(12,3), active boolean, correction_source string, introduced_by long",
    "offers": "offer_id long, sp_id long, agency_id long, catalog_id long, price decimal(12,2), tax_basis string, vat_rate decimal(5,2), currency string, stock int, preparation_minutes int, observed_at timestamp, source_key string, source_url string",
    "imports": "catalog_id long, source_key string, filename string, tax_basis string, rows long, with_price long, without_price long, agencies long, references long, mapped long",
}


def empty_tables(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def numbered(rows: DataFrame, order: list[str], name: str, after: int) -> DataFrame:
    """``rows`` with ids from ``after`` + 1 on in the order of ``order``, which tells rows apart.

    Rows are dealt out by ranges and numbered where they are; only the number of rows of each range is brought together.
    The ids follow from the order alone, so that a run that is repeated gives the same ones.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__at", 33)
    held = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.count("*")).collect())
    before, at = [], after
    for k, n in held:
        before.append((k, at))
        at += n
    start = F.broadcast(rows.sparkSession.createDataFrame(before, "__part long, __start long"))
    return dealt.withColumn("__part", part).join(start, "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__start", "__at")


def next_source_key(imports: DataFrame, stamp: str) -> str:
    """'import-' and the stamp, with -002, -003 and so on if it is taken."""
    base = f"import-{stamp}"
    taken = {r[0] for r in imports.where(F.col("source_key").startswith(base)).select("source_key").collect()}
    return next(k for k in (base, *(f"{base}-{n:03d}" for n in range(2, len(taken) + 3))) if k not in taken)


def _last(c: str | Column, known: Column | None = None) -> Column:
    """The value of the last line that has one."""
    value = F.col(c) if isinstance(c, str) else c
    return F.max_by(value, F.when(known if known is not None else value.isNotNull(), F.col("line")))


def _merged(old: DataFrame, new: DataFrame, on: list[str], fields: list[str], keep: Column | None = None) -> DataFrame:
    """Old rows with the new values that are there (unless ``keep`` holds for the row), others as they are; columns of ``new`` are prefixed."""
    n = new.select(*on, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__hit"))
    value = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if keep is None else F.when(keep(c), F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c)))
    out = old.join(n, on, "left")
    return out.select(*(value(c).alias(c) if c in fields else F.col(c) for c in old.columns))


def _highest(df: DataFrame, c: str) -> int:
    return df.agg(F.max(c)).first()[0] or 0


def import_offers(offers: DataFrame, issues: DataFrame, tables: dict[str, DataFrame], products: DataFrame, filename: str, stamp: str, overrides: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, actions): the versions of all tables after the import, and how many rows each created, updated or left as they were.

    ``offers`` and ``issues`` are those of feeds.validate_offers; with an issue nothing is written, and actions has none.
    ``products``: product_id, code. ``overrides``: supplier, supplier_reference, product_id, which may be null.

    * Suppliers go by name, agencies by their external id or else by name, references by supplier and reference, offers by
      reference and agency. What is new gets the next ids in the order of these keys.
    * Of several lines for one agency or reference the last one counts; a value that is missing doesn't overwrite.
    * A reference with a protected mapping keeps its product, units, packs and source; labels and codes are taken over. Else
      the product is an override, the one of the file's code, or the one that is known.
    * Without a reference quantity the pack's size stands for it. Lines without a price make no offer. The stock is in packs
      of the quantity that the reference has after the import.
    """
    if issues.limit(1).count():
        return tables, offers.sparkSession.createDataFrame([], "table string, action string, n long")
    spark, key = offers.sparkSession, next_source_key(tables["imports"], stamp)
    catalog = _highest(tables["imports"], "catalog_id") + 1
    rows = offers.withColumn("external_id", F.nullif("agency_external_id", F.lit(""))).checkpoint()
    out = {}

    old = tables["suppliers"]
    names = rows.select("supplier").distinct()
    fresh = numbered(names.join(old, "supplier", "left_anti"), ["supplier"], "supplier_id", _highest(old, "supplier_id"))
    told = names.select("supplier", F.lit("file").alias("source_type"), F.lit(key).alias("source_key"))
    out["suppliers"] = _merged(old, told, ["supplier"], ["source_type", "source_key"]).unionByName(fresh.select("supplier_id", "supplier", F.lit("file").alias("source_type"), F.lit(key).alias("source_key"))).checkpoint()
    rows = rows.join(out["suppliers"].select("supplier", "supplier_id"), "supplier")

    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    title = F.coalesce("agency_name", F.when(F.col("external_id").isNotNull(), F.concat_ws(" · ", "supplier", "external_id")).otherwise(F.concat("supplier", F.lit(" (catalogue national)"))))
    rows = rows.withColumn("agency_name", F.substring(title, 1, 100)).checkpoint()
    new = rows.groupBy("supplier_id", "external_id").agg(
        _last("agency_name").alias("agency_name"), _last(F.substring("agency_address", 1, 200)).alias("address"), _last(F.substring("agency_postal_code", 1, 10)).alias("postal_code"), _last(F.substring("agency_city", 1, 100)).alias("city"),
        _last("latitude", F.when(both, True)).alias("latitude"), _last("longitude", F.when(both, True)).alias("longitude"),
    )
    old = tables["agencies"]
    by_code = old.select("supplier_id", F.col("external_id").alias("__code"), F.col("agency_id").alias("__a")).groupBy("supplier_id", "__code").agg(F.min("__a").alias("__a"))
    by_name = old.groupBy("supplier_id", "agency_name").agg(F.min("agency_id").alias("__b"))
    met = new.join(by_code.withColumnRenamed("supplier_id", "__s"), (F.col("supplier_id") == F.col("__s")) & F.col("external_id").eqNullSafe(F.col("__code")), "left").join(by_name, ["supplier_id", "agency_name"], "left")
    met = met.withColumn("agency_id", F.coalesce("__a", "__b")).drop("__s", "__code", "__a", "__b").checkpoint()
    fresh = numbered(met.where("agency_id IS NULL").drop("agency_id"), ["supplier_id", "external_id", "agency_name"], "agency_id", _highest(old, "agency_id"))
    blank = [F.coalesce(c, F.lit("")).alias(c) if c in ("address", "postal_code", "city") else F.col(c) for c in old.columns]
    fields = ["external_id", "agency_name", "address", "postal_code", "city", "latitude", "longitude"]
    # Two agencies of a file may be one that is there, by code and by name: the one with the code counts.
    known = met.where("agency_id IS NOT NULL").groupBy("agency_id").agg(*(F.max_by(c, F.struct(F.col("external_id").isNotNull(), "external_id")).alias(c) for c in fields))
    out["agencies"] = _merged(old, known, ["agency_id"], fields).unionByName(fresh.select(*blank)).checkpoint()
    place = met.where("agency_id IS NOT NULL").select("supplier_id", "external_id", "agency_id").unionByName(fresh.select("supplier_id", "external_id", "agency_id")).withColumnsRenamed({"supplier_id": "__s", "external_id": "__code"})
    rows = rows.join(place, (F.col("supplier_id") == F.col("__s")) & F.col("external_id").eqNullSafe(F.col("__code"))).drop("__s", "__code")

    old = tables["references"]
    keys = ["supplier_id", "supplier_reference"]
    new = rows.groupBy(*keys).agg(
        _last(F.substring("designation", 1, 200)).alias("designation"), *(_last(c).alias(c) for c in ("brand", "ean", "image_url", "reference_unit", "product_code")),
        F.max_by(F.substring(F.coalesce("supplier_unit", F.lit("unité")), 1, 40), "line").alias("supplier_unit"), F.max_by("reference_quantity", "line").alias("reference_quantity"), F.max_by("packaging_quantity", "line").alias("packaging_quantity"),
    )
    said = overrides.join(out["suppliers"].select("supplier", "supplier_id"), "supplier").select(*keys, "product_id") if overrides is not None else None
    new = resolve_mapping(new, products, old, said).withColumn("explicit", F.lit(False))
    if said is not None:
        new = new.drop("explicit").join(said.select(*keys, F.lit(True).alias("explicit")), keys, "left")
    new = new.withColumn("active", F.lit(True)).withColumn("correction_source", F.lit("import")).checkpoint()
    fresh = numbered(new.join(old, keys, "left_anti"), keys, "sp_id", _highest(old, "sp_id")).withColumn("introduced_by", F.lit(catalog).cast("long"))
    guarded = F.coalesce(F.col("correction_source").isin(*PROTECTED), F.lit(False))
    held = ("supplier_unit", "reference_quantity", "packaging_quantity", "reference_unit", "correction_source")
    fields = ["designation", "brand", "ean", "image_url", "active", *held]
    merged = _merged(old, new, keys, fields, lambda c: guarded if c in held else F.lit(False))
    mapping = new.select(*keys, F.col("product_id").alias("__product"), F.coalesce("explicit", F.lit(False)).alias("__explicit"))
    was = old.select("sp_id", guarded.alias("__guarded"))
    merged = merged.join(mapping, keys, "left").join(was, "sp_id", "left")
    take = ~F.col("__guarded") & (F.coalesce("__explicit", F.lit(False)) | F.col("__product").isNotNull())
    merged = merged.withColumn("product_id", F.when(take, F.col("__product")).otherwise(F.col("product_id"))).select(*old.columns)
    out["references"] = merged.unionByName(fresh.select(*old.columns)).checkpoint()

    old = tables["offers"]
    effective = out["references"].select(*keys, "sp_id", F.col("reference_quantity").alias("__packs"))
    priced = rows.where("price IS NOT NULL").drop("sp_id").join(effective, keys)
    stock = F.when(F.col("available_quantity").isNotNull() & (F.col("__packs") > 0), F.floor(F.col("available_quantity") / F.col("__packs"))).otherwise(0).cast("int")
    one = F.max_by(F.struct("price", "tax_basis", "vat_rate", "currency", stock.alias("stock"), "preparation_minutes", "observed_at", "source_url"), "line")
    new = priced.groupBy("sp_id", "agency_id").agg(one.alias("x")).select("sp_id", "agency_id", "x.*").withColumns({"catalog_id": F.lit(catalog).cast("long"), "source_key": F.lit(key)}).checkpoint()
    fresh = numbered(new.join(old, ["sp_id", "agency_id"], "left_anti"), ["sp_id", "agency_id"], "offer_id", _highest(old, "offer_id"))
    value = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c not in ("offer_id", "sp_id", "agency_id") else F.col(c)
    there = new.select("sp_id", "agency_id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in new.columns if c not in ("sp_id", "agency_id")))
    out["offers"] = old.join(there, ["sp_id", "agency_id"], "left").select(*map(value, old.columns)).unionByName(fresh.select(*old.columns)).checkpoint()

    used = rows.select(*keys).distinct().join(out["references"].select(*keys, "product_id"), keys)
    counts = rows.agg(
        F.when(F.countDistinct("tax_basis") > 1, "MIXED").otherwise(F.coalesce(F.min("tax_basis"), F.lit("HT"))).alias("tax_basis"), F.count("*").alias("rows"), F.count("price").alias("with_price"),
        F.count_if(F.col("price").isNull()).alias("without_price"), F.countDistinct("supplier_id", F.when(F.col("external_id").isNotNull(), F.col("external_id"))).alias("agencies"), F.countDistinct(*keys).alias("references"),
    ).crossJoin(used.agg(F.count("product_id").alias("mapped")))
    line = counts.withColumns({"catalog_id": F.lit(catalog).cast("long"), "source_key": F.lit(key), "filename": F.lit(filename)})
    out["imports"] = tables["imports"].unionByName(line.select(*tables["imports"].columns)).checkpoint()
    return out, actions(tables, out)


#: What says where a row is from, and isn't a change of it.
PROVENANCE = ("source_key", "source_type", "catalog_id", "observed_at")


def actions(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table, action, n): rows of each table that are created, updated or unchanged, by their id and all but their provenance."""
    found = None
    for name, key in (("suppliers", "supplier_id"), ("agencies", "agency_id"), ("references", "sp_id"), ("offers", "offer_id")):
        fields = [c for c in after[name].columns if c not in (*PROVENANCE, key)]
        was = before[name].select(key, F.struct(*fields).alias("__old"), F.lit(True).alias("__was"))
        kind = F.when(F.col("__was").isNull(), "created").when(F.col("__old").eqNullSafe(F.struct(*fields)), "unchanged").otherwise("updated")
        part = after[name].join(was, key, "left").groupBy(kind.alias("action")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "action", "n")
        found = part if found is None else found.unionByName(part)
    return found
