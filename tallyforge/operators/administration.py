"""Catalogue writes with their guards, audits and look-ups; every write gives the new version of its table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.feeds_text import name_key, plain_value
from tallyforge.functions.text import contains_any, fold, own_key
from tallyforge.functions.units import normalize_unit
from tallyforge.session import dealt


def set_flag(rows: DataFrame, ids: DataFrame, key: str, column: str, value: bool) -> DataFrame:
    """``rows`` with ``column`` set to ``value`` where the key is among ``ids``; null keys stay as they are."""
    asked = ids.select(key).distinct().withColumn("__asked", F.lit(True))
    return rows.join(asked, key, "left").withColumn(column, F.when(F.col("__asked"), F.lit(value)).otherwise(F.col(column))).select(*rows.columns)


def map_references(supplier_products: DataFrame, products: DataFrame, requests: DataFrame) -> DataFrame:
    """(sp_id, product_id, outcome) of each request to map a reference by hand.

    ``requests``: sp_id once, wanted, confirmed. A reference that has another product is only mapped anew if
    that is confirmed; an unknown product or reference changes nothing; a null product removes the mapping.
    """
    asked = requests.select("sp_id", "wanted", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    known = products.select(F.col("product_id").alias("wanted")).distinct().withColumn("__known", F.lit(True))
    now = supplier_products.select("sp_id", F.col("product_id").alias("held"), F.lit(True).alias("__there"))
    rows = asked.join(known, "wanted", "left").join(now, "sp_id", "left")
    outcome = (
        F.when(F.col("__there").isNull(), "unknown_reference").when(F.col("wanted").isNotNull() & F.col("__known").isNull(), "unknown_product")
        .when(F.col("held").eqNullSafe(F.col("wanted")), "same").when(F.col("held").isNull(), "mapped").when(~F.col("confirmed"), "needs_confirmation")
        .when(F.col("wanted").isNull(), "unmapped").otherwise("remapped")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select("sp_id", F.when(F.col("outcome").isin("mapped", "remapped", "unmapped"), F.col("wanted")).otherwise(F.col("held")).alias("product_id"), "outcome")


def create_products(requests: DataFrame, products: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """Each request (request_no, code, name, unit) with ``outcome``: created, duplicate_code, bad_unit or no_code.

    Codes are unique among products and requests; the first request of a code counts, whatever comes of it.
    """
    first = F.expr("row_number() over (partition by code order by request_no)") == 1
    known = products.select("code").distinct().withColumn("__known", F.lit(True))
    rows = requests.withColumn("__first", first).join(known, "code", "left").withColumn("unit", normalize_unit(F.col("unit")))
    blank = F.coalesce(F.trim("code"), F.lit("")) == ""
    outcome = F.when(blank, "no_code").when(F.col("__known").isNotNull() | ~F.col("__first"), "duplicate_code").when(F.coalesce(F.col("unit").isin(*units), F.lit(False)), "created").otherwise("bad_unit")
    return rows.select("request_no", "code", "name", "unit", outcome.alias("outcome"))


def product_usage(products: DataFrame, materials: DataFrame) -> DataFrame:
    """(product_id, projects, unit_editable): a unit may only be changed while no project uses the product."""
    used = materials.groupBy("product_id").agg(F.countDistinct("project_id").alias("projects"))
    return products.select("product_id").join(used, "product_id", "left").select(
        "product_id", F.coalesce("projects", F.lit(0)).cast("long").alias("projects"), F.col("projects").isNull().alias("unit_editable")
    )


def change_units(products: DataFrame, requests: DataFrame, materials: DataFrame) -> DataFrame:
    """(product_id, reference_unit, outcome) of each request (product_id once, unit): changed, same, in_use or unknown."""
    rows = requests.join(product_usage(products, materials), "product_id", "left").join(products.select("product_id", "reference_unit"), "product_id", "left")
    wanted = normalize_unit(F.col("unit"))
    outcome = F.when(F.col("unit_editable").isNull(), "unknown").when(F.col("reference_unit").eqNullSafe(wanted), "same").when(F.col("unit_editable"), "changed").otherwise("in_use")
    return rows.select("product_id", F.when(outcome == "changed", wanted).otherwise(F.col("reference_unit")).alias("reference_unit"), outcome.alias("outcome"))


def sources(suppliers: DataFrame, supplier_products: DataFrame, offers: DataFrame) -> DataFrame:
    """References, mapped references and offers of every supplier, with or without any."""
    refs = supplier_products.groupBy("supplier_id").agg(F.count("*").alias("references"), F.count("product_id").alias("mapped"))
    per = offers.groupBy("supplier_id").agg(F.count("*").alias("offers"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return suppliers.join(refs, "supplier_id", "left").join(per, "supplier_id", "left").select("supplier_id", "supplier", "active", *map(zero, ("references", "mapped", "offers")))


def search_references(supplier_products: DataFrame, suppliers: DataFrame, products: DataFrame, query: str = "", limit: int = 20, most: int = 30) -> DataFrame:
    """A page of references by supplier and reference: those that hold the text, or the unmapped ones if there is none."""
    rows = supplier_products.join(suppliers.select("supplier_id", "supplier"), "supplier_id").join(products.select("product_id", F.col("code").alias("product_code")), "product_id", "left")
    rows = rows.where(contains_any(query, "designation", "supplier_reference", "brand", "supplier")) if query else rows.where("product_id is null")
    return rows.orderBy("supplier", "supplier_reference").limit(min(max(1, limit), most)).select("sp_id", "supplier", "supplier_reference", "product_id", "product_code")


def live_references(supplier_products: DataFrame, products: DataFrame) -> DataFrame:
    """Active mapped references with their active product: what live prices are asked for."""
    return supplier_products.where("active").join(products.where("is_active").select("product_id", "code", "reference_unit"), "product_id").select("sp_id", "supplier_id", "supplier_reference", "product_id", "code", "reference_unit")


def named_suppliers(suppliers: DataFrame, wanted: str | None) -> DataFrame:
    """Suppliers of a name, however it is written; all of them without one."""
    return suppliers if not wanted else suppliers.where(name_key(F.col("supplier")) == name_key(F.lit(wanted)))


def participates(suppliers: DataFrame, names: DataFrame) -> DataFrame:
    """(name, participates): a named connector takes part if no supplier has its name, or an active one has it."""
    there = suppliers.groupBy(F.col("supplier").alias("name")).agg(F.bool_or("active").alias("__active"))
    return names.select("name").distinct().join(there, "name", "left").select("name", F.coalesce("__active", F.lit(True)).alias("participates"))


def dominant_source(offers: DataFrame, by: str, order: tuple[str, ...] = ("file", "api", "demo")) -> DataFrame:
    """(by, source): the foremost kind of source that a key's offers come from; null if it has none of these."""
    rank = F.coalesce(*(F.when(F.col("source_type") == s, F.lit(i)) for i, s in enumerate(order)))
    return offers.groupBy(by).agg(F.min(rank).alias("__rank")).select(by, F.element_at(F.array(*map(F.lit, order)), F.col("__rank") + 1).alias("source"))


def specific_products(supplier_products: DataFrame, prefix: str) -> DataFrame:
    """(code, designation_key, name, references): one product for each different label of unmapped references.

    Labels are equal if they are when folded and squeezed; one without a label goes by its reference. The
    name is the longest label, the greatest of them in case of a tie; the code a hash of the key.
    """
    key = own_key("designation", F.coalesce("supplier_reference", F.col("sp_id").cast("string")))
    rows = supplier_products.where("product_id is null").withColumn("designation_key", key)
    named = rows.groupBy("designation_key").agg(F.max_by("designation", F.struct(F.length("designation"), "designation")).alias("name"), F.count("*").alias("references"))
    return named.select(F.concat(F.lit(prefix), F.upper(F.substring(F.sha1("designation_key"), 1, 16))).alias("code"), "designation_key", "name", "references")


def audit_exact(claims: DataFrame, keys: list[str]) -> DataFrame:
    """(id, key, extracted, product) of each EXACT claim's first identity key that isn't the same on both sides.

    ``claims``: id, reason, and the maps identity and target. Numbers are equal as numbers, other values as
    folded text; a key that either side doesn't know is a mismatch.
    """
    wrong = [
        F.when(~F.coalesce(plain_value(F.col("identity")[k]) == plain_value(F.col("target")[k]), F.lit(False)), F.struct(F.lit(k).alias("key"), F.col("identity")[k].alias("extracted"), F.col("target")[k].alias("product")))
        for k in keys
    ]
    return claims.where("reason = 'EXACT'").select("id", F.coalesce(*wrong).alias("x")).where("x is not null").select("id", "x.*")


def kept_mappings(before: DataFrame, after: DataFrame, parts: int | None = None) -> DataFrame:
    """(sp_id, product_id) of the mappings that were there before and aren't any more: none, if a batch did no harm.

    A row goes as often as it was there more often before. Rows are dealt out before they are counted, to ``parts`` tasks if told.
    """
    told = lambda df, n: df.where("product_id is not null").select("sp_id", "product_id", F.lit(n).alias("n"))
    both = dealt(told(before, 1).union(told(after, -1)), parts, "sp_id", "product_id")
    gone = both.groupBy("sp_id", "product_id").agg(F.sum("n").alias("n")).where("n > 0")
    return gone.select("sp_id", "product_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("n")).drop("n")


def select_family(rows: DataFrame, prefixes: tuple[str, ...] = (), **equal: tuple[str, ...]) -> DataFrame:
    """Products whose code starts with one of the prefixes, or with one of the given values in one of the columns."""
    parts: list[Column] = [F.col("code").startswith(p) for p in prefixes] + [F.col(c).isin(*values) for c, values in equal.items()]
    return rows.where(reduce(lambda a, b: a | b, parts, F.lit(False)))


def preferred_hits(hits: DataFrame, key: str) -> DataFrame:
    """Of each key's hits the one with a bar code, then the longest name, then the least name."""
    order = F.struct(F.col("ean").isNull(), -F.length("name"), "name", "ean")
    return hits.groupBy(key).agg(F.min_by(F.struct(*hits.columns), order).alias("x")).select("x.*")


def largest_families(families: DataFrame, keys: list[str]) -> DataFrame:
    """Each family once: its largest row; the least id in case of a tie."""
    return families.groupBy(*keys).agg(F.min_by(F.struct(*families.columns), F.struct(-F.col("size"), "id")).alias("x")).select("x.*")


def leg_minutes(routes: DataFrame) -> DataFrame:
    """(project_id, agency_key, minutes) of each leg's end, the last leg of a key counting.

    ``routes``: project_id, legs (array of end_key, end_id, minutes). An end without a key goes by its id; legs
    without minutes or an end are passed by.
    """
    legs = routes.select("project_id", F.posexplode("legs").alias("pos", "leg"))
    key = F.coalesce(F.when(F.col("leg.end_key") != "", F.col("leg.end_key")), F.concat(F.lit("db:"), F.col("leg.end_id")))
    told = legs.select("project_id", "pos", key.alias("agency_key"), F.col("leg.minutes").alias("minutes")).where("minutes is not null and agency_key is not null")
    return told.groupBy("project_id", "agency_key").agg(F.max_by("minutes", "pos").alias("minutes"))


def coverage(rows: DataFrame, clustered: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Known, clustered and left over rows, all of them, and whether the three add up without an overlap."""
    flag = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(1))
    joined = rows.select(key).join(flag(known, "k"), key, "left").join(flag(clustered, "c"), key, "left")
    out = joined.agg(
        F.count("*").alias("total"), F.count("k").alias("known"), F.count_if(F.col("k").isNull() & F.col("c").isNotNull()).alias("clustered"),
        F.count_if(F.col("k").isNull() & F.col("c").isNull()).alias("residual"), F.count_if(F.col("k").isNotNull() & F.col("c").isNotNull()).alias("overlap"),
    )
    return out.select("*", ((F.col("overlap") == 0) & (F.col("known") + F.col("clustered") + F.col("residual") == F.col("total"))).alias("holds"))


def destinations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(label, path, members, share): where the members of each old cluster are now; those in no new one are residual."""
    moved = old.select("id", "label").join(new.select("id", "path"), "id", "left").groupBy("label", F.coalesce("path", F.lit("(residual)")).alias("path")).agg(F.count("*").alias("members"))
    return moved.withColumn("share", F.round(F.col("members") / F.expr("sum(members) over (partition by label)"), 4))
