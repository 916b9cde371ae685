"""Supplier files and feeds: CSV offers with validation, JSON exports, sitemaps, store pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import http_url, parse_timestamp, strip_html
from tallyforge.operators.upsert import keep_first

# Columns of an offer file, other names of one, and its limits.
REQUIRED = ("supplier", "agency_external_id", "product_external_reference", "product_name", "currency", "tax_basis")
OPTIONAL = ("agency_name", "agency_address", "agency_postal_code", "agency_city", "agency_latitude", "agency_longitude", "brand", "ean", "supplier_unit", "packaging_quantity", "reference_unit", "reference_quantity", "available_quantity", "preparation_minutes", "observed_at", "product_code", "price", "source_url", "seller", "verification_status", "image_url", "vat_rate")
OTHER_NAMES = {"supplier_reference": "product_external_reference", "product_reference": "product_external_reference", "external_reference": "product_external_reference"}
MAX_BYTES = 2 * 1024 * 1024


def valid_filename(name: str) -> bool:
    """A plain .csv name of at most 180 usual characters."""
    return len(name) <= 180 and re.fullmatch(r"[\w.\- ()]+\.csv", name) is not None


def sniff_delimiter(sample: str) -> str:
    """';' if the first 4096 characters hold a line end and more of it than of ','."""
    head = sample[:4096]
    return ";" if head.count(";") > head.count(",") and "\n" in head else ","


def read_offer_csv(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """Rows of an offer file, or of a folder of them, as strings, with ``line``, the place of the record in its file (the first is 2).

    Blank rows are left out, but count as lines where the reader gives them. Missing columns are an error, and so is a file of
    more than ``most`` bytes; its contents aren't read for that.
    """
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > most).select("path").first()
    if large:
        raise ValueError(f"{large.path} has more than {most} bytes")
    head = spark.read.text(path).limit(64).collect()
    sep = sniff_delimiter("\n".join(r[0] for r in head) + "\n")
    raw = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(path)
    named = {c: OTHER_NAMES.get(c.strip("﻿ \t"), c.strip("﻿ \t")) for c in raw.columns}
    # A file with quoted line ends is read by one task, so that its records have ascending numbers.
    rows = raw.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id()).withColumnsRenamed(named)
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    line = F.row_number().over(Window.partitionBy("__file").orderBy("__at")).cast("long") + 1
    rows = rows.select(*(F.trim(F.col(c)).alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in REQUIRED + OPTIONAL), line.alias("line"))
    return rows.where(F.exists(F.array(*REQUIRED, *OPTIONAL), lambda v: v.isNotNull() & (v != "")))


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _number(c: str) -> Column:
    return F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("decimal(18,6)")


def _bad_number(c: str, low: float | None = None, above: bool = False, high: float | None = None) -> Column:
    n = _number(c)
    out = n.isNull()
    if low is not None:
        out = out | (n <= low if above else n < low)
    if high is not None:
        out = out | (n > high)
    return _given(c) & F.coalesce(out, F.lit(True))


def issues_of() -> Column:
    """What is wrong with a row, as an array of (code, column)."""
    checks = [(f"required_{c}", c, ~_given(c)) for c in REQUIRED if c != "agency_external_id"]
    checks += [
        ("price", "price", _bad_number("price", 0)), ("currency", "currency", _given("currency") & (F.upper("currency") != "EUR")),
        ("tax_basis", "tax_basis", _given("tax_basis") & ~F.upper("tax_basis").isin("HT", "TTC")), ("vat_rate", "vat_rate", _bad_number("vat_rate", 0, False, 100)),
        ("packaging_quantity", "packaging_quantity", _bad_number("packaging_quantity", 0, True)), ("reference_quantity", "reference_quantity", _bad_number("reference_quantity", 0, True)),
        ("available_quantity", "available_quantity", _bad_number("available_quantity", 0)), ("preparation_minutes", "preparation_minutes", _given("preparation_minutes") & (F.coalesce(F.col("preparation_minutes").try_cast("int"), F.lit(-1)) < 0)),
        ("observed_at", "observed_at", _given("observed_at") & parse_timestamp("observed_at").isNull()),
        ("latitude", "agency_latitude", _bad_number("agency_latitude", -90, False, 90)), ("longitude", "agency_longitude", _bad_number("agency_longitude", -180, False, 180)),
        ("coordinates", "agency_latitude", _given("agency_latitude") != _given("agency_longitude")),
        ("source_url", "source_url", _given("source_url") & http_url("source_url").isNull()), ("image_url", "image_url", _given("image_url") & http_url("image_url").isNull()),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(col).alias("column"))) for code, col, cond in checks)))


def validate_offers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers, issues): typed offers of rows without an issue, the first of each key; and all issues by line."""
    checked = rows.withColumn("__issues", issues_of())
    bad = checked.select("line", F.explode("__issues").alias("i")).select("line", "i.code", "i.column")
    fine, again = keep_first(checked.where(F.size("__issues") == 0), ["supplier", "coalesce(agency_external_id, '')", "product_external_reference"], "line")
    twice = again.select("line", F.lit("duplicate").alias("code"), F.lit("product_external_reference").alias("column"))
    packs = F.coalesce(_number("reference_quantity"), _number("packaging_quantity"), F.lit(1)).cast("decimal(12,3)")
    offers = fine.select(
        "line", "supplier", F.coalesce("agency_external_id", F.lit("")).alias("agency_external_id"), F.col("product_external_reference").alias("supplier_reference"), F.col("product_name").alias("designation"),
        "brand", "product_code", _number("price").cast("decimal(12,2)").alias("price"), F.upper("tax_basis").alias("tax_basis"), _number("vat_rate").cast("decimal(5,2)").alias("vat_rate"), "supplier_unit",
        packs.alias("reference_quantity"), F.when(_number("reference_quantity").isNull(), F.lit(1)).otherwise(F.coalesce(_number("packaging_quantity"), F.lit(1))).cast("decimal(12,3)").alias("packaging_quantity"),
        F.floor(F.coalesce(_number("available_quantity"), F.lit(0)) / packs).cast("int").alias("stock"), F.coalesce(F.col("preparation_minutes").try_cast("int"), F.lit(60)).alias("preparation_minutes"),
        parse_timestamp("observed_at").alias("observed_at"), _number("agency_latitude").cast("double").alias("latitude"), _number("agency_longitude").cast("double").alias("longitude"), http_url("source_url").alias("source_url"),
        *(F.nullif(c, F.lit("")).alias(c) for c in ("agency_name", "agency_address", "agency_postal_code", "agency_city", "ean", "reference_unit")), http_url("image_url").alias("image_url"),
        F.upper("currency").alias("currency"), _number("available_quantity").alias("available_quantity"),
    )
    return offers, bad.union(twice)


def import_report(rows: DataFrame, offers: DataFrame, issues: DataFrame) -> DataFrame:
    """Counters of an import: rows, valid ones, with and without price, by basis, and issues by code."""
    counts = offers.agg(
        F.count("*").alias("valid"), F.count_if(F.col("price").isNotNull()).alias("with_price"), F.count_if(F.col("price").isNull()).alias("without_price"),
        F.count_if(F.col("tax_basis") == "HT").alias("ht"), F.count_if(F.col("tax_basis") == "TTC").alias("ttc"), F.countDistinct("supplier").alias("suppliers"),
    )
    per = issues.groupBy("code").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("issues"))
    return rows.agg(F.count("*").alias("rows")).crossJoin(counts).crossJoin(per)


STORE = "struct<data:struct<retailers:struct<items:array<struct<entity_id:bigint,seller_code:string,name:string,address:string,distance_from_location:double,address_data:struct<city:string,postcode:string,coordinates:struct<latitude:double,longitude:double>>>>>>>"
PRODUCT = "struct<data:struct<products:struct<items:array<struct<sku:string,name:string,ean_code:string,stock_status:string,stock_quantity:int,is_salable:boolean,is_offer_available:boolean>>>>>"


def parse_stores(payloads: DataFrame, column: str = "payload", most: int = 10) -> DataFrame:
    """Stores of locator answers, nearest first, unknown distances last; malformed answers give none."""
    items = payloads.select("id", F.posexplode(F.from_json(column, STORE)["data"]["retailers"]["items"]).alias("pos", "s"))
    out = items.select("id", "pos", F.col("s.entity_id").alias("store_id"), "s.seller_code", "s.name", "s.address", F.col("s.address_data.city").alias("city"), F.col("s.address_data.postcode").alias("postal_code"), F.col("s.address_data.coordinates.latitude").alias("latitude"), F.col("s.address_data.coordinates.longitude").alias("longitude"), F.col("s.distance_from_location").alias("distance"))
    return out.withColumn("rank", F.expr("row_number() over (partition by id order by distance nulls last, pos)")).where(F.col("rank") <= most).drop("pos")


def parse_live_products(payloads: DataFrame, wanted: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(products by exact sku, skus without an answer)."""
    items = payloads.select(F.explode(F.from_json(column, PRODUCT)["data"]["products"]["items"]).alias("p")).select("p.*").where("sku is not null")
    open_ = F.col("stock_quantity") > 0
    rows = items.withColumn("in_store", F.coalesce(open_ & F.col("is_salable") & F.col("is_offer_available"), F.lit(False)))
    first, _ = keep_first(rows, ["sku"], "name, ean_code")
    return wanted.join(first, "sku"), wanted.join(first, "sku", "left_anti")


def sitemap_skus(pages: DataFrame, column: str = "text", url_part: str = "") -> DataFrame:
    """(sku, url) of product pages in sitemaps: the last number of the path; of a repeated sku the first url."""
    urls = pages.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"))).alias("url"))
    if url_part:
        urls = urls.where(F.contains("url", F.lit(url_part)))
    skus = urls.select(F.regexp_extract(F.parse_url("url", F.lit("PATH")), r"(\d{4,})(?:[^\d]*)$", 1).alias("sku"), "url").where("sku <> ''")
    return keep_first(skus, ["sku"], "url")[0]


def deepest_category(paths: str = "paths", promo: str = r"promo|solde|destockage") -> Column:
    """The path with the most parts; those of promotions only if there is no other. Ties go to the first by alphabet."""
    ranked = F.array_sort(F.transform(F.col(paths), lambda p: F.struct(p.rlike(promo).cast("int").alias("promo"), (-F.size(F.split(p, "/"))).alias("minus"), p.alias("path"))))
    return F.try_element_at(ranked, F.lit(1))["path"]


def first_image(urls: str = "urls") -> Column:
    return F.try_element_at(F.filter(F.col(urls), lambda u: u.rlike(r"^https?://")), F.lit(1))


def round_robin(rows: DataFrame, family: str, order: str, n: int) -> DataFrame:
    """A diverse sample: one of each family a round, families in the order of their first row, no sku twice."""
    once = keep_first(rows, ["sku"], order)[0]
    turn = once.withColumn("__turn", F.expr(f"row_number() over (partition by {family} order by {order})"))
    turn = turn.withColumn("__first", F.expr(f"min({order}) over (partition by {family})"))
    return turn.orderBy("__turn", "__first", family).limit(n).drop("__turn", "__first")


def concentration(counts: DataFrame, n: str = "n") -> DataFrame:
    """Shares in percent of the largest and the two largest, and a warning above 70 for the two."""
    top = counts.select(F.col(n)).orderBy(F.col(n).desc()).limit(2).agg(F.max(n).alias("a"), F.sum(n).alias("b"))
    total = counts.agg(F.sum(n).alias("t"))
    share = lambda c: F.round(F.col(c) * 100 / F.col("t"), 2)
    return top.crossJoin(total).select(share("a").alias("top1"), share("b").alias("top2"), (share("b") > 70).alias("warning"))


# Where the price of a live payload may stand, by basis and by piece or measure, in order.
PRICE_PATHS = {
    "ht": (("piece", "$.price.ht.piece"), ("piece", "$.price_ht"), ("measure", "$.price.ht.measure")), "ttc": (("piece", "$.price.ttc.piece"), ("piece", "$.price_ttc"), ("measure", "$.price.ttc.measure")),
}


def live_price(payload) -> Column:
    """struct(ht, ttc, per): the prices of a live payload (JSON text), to cents, and what they are for: piece, or m2 by measure.

    Of several places the first with a positive number counts, by piece before by measure; both prices are for the
    same. A payload that is no JSON, or has something else where a price should be, has none.
    """
    v = F.try_parse_json(payload if isinstance(payload, Column) else F.col(payload))

    def read(doc: Column) -> Column:
        def price(basis: str, per: str) -> Column:
            said = [F.replace(F.try_variant_get(doc, path, "string"), F.lit(","), F.lit(".")).try_cast("decimal(12,4)") for kind, path in PRICE_PATHS[basis] if kind == per]
            return F.round(F.coalesce(*(F.when(p > 0, p) for p in said)), 2).cast("decimal(12,2)")

        both = {per: F.struct(price("ht", per).alias("ht"), price("ttc", per).alias("ttc"), F.lit(name).alias("per")) for per, name in (("piece", "piece"), ("measure", "m2"))}
        there = lambda s: s["ht"].isNotNull() | s["ttc"].isNotNull()
        return F.try_element_at(F.filter(F.array(*both.values()), there), F.lit(1))

    return F.element_at(F.transform(F.array(v), read), 1)


EXPORT = "struct<products:array<struct<sku:string,variant:string,name:string,ean:string,brand:string,url:string>>>"


def export_products(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, bad): the products of JSON exports (file, text), an object with a list 'products', in their order; and files that hold none.

    A product without a sku is left out. To read a folder: spark.read.text(path, wholetext=True) with its file's name.
    """
    read = files.withColumn("__doc", F.from_json("text", EXPORT)).withColumn("__list", F.col("__doc.products"))
    rows = read.where("__list IS NOT NULL").select("file", F.posexplode("__list").alias("pos", "p")).select("file", "pos", "p.*").where(F.trim(F.coalesce("sku", F.lit(""))) != "")
    return rows, read.where("__list IS NULL").select("file")


_LINK = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>(.*?)(?=<a\b|$)"


def store_directory(pages: DataFrame, url_part: str) -> DataFrame:
    """(file, store_id, name, url, postal_code, city) of the links of HTML store lists (file, html) whose address holds ``url_part``.

    The id is the last number of the address. Postal code and city stand after the link: five digits and what follows,
    or the text alone. Of several links to one store in a file the first counts.
    """
    groups = F.struct(*(F.regexp_extract_all("html", F.lit(_LINK), F.lit(i)).alias(n) for i, n in enumerate(("url", "name", "rest"), 1)))
    links = pages.select("file", groups.alias("g")).select("file", F.posexplode(F.arrays_zip("g.url", "g.name", "g.rest")).alias("pos", "x")).where(F.contains("x.url", F.lit(url_part)))
    plain = lambda c: F.trim(F.regexp_replace(F.replace(F.replace(strip_html(c), F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" ")), r"\s+", " "))
    rows = links.select("file", "pos", F.regexp_extract("x.url", r"(\d+)\D*$", 1).alias("store_id"), plain(F.col("x.name")).alias("name"), F.col("x.url").alias("url"), plain(F.col("x.rest")).alias("__rest")).where("store_id <> ''")
    code = F.nullif(F.regexp_extract("__rest", r"\b(\d{5})\b", 1), F.lit(""))
    city = F.nullif(F.trim(F.when(code.isNotNull(), F.regexp_extract("__rest", r"\b\d{5}\b(.*)$", 1)).otherwise(F.col("__rest"))), F.lit(""))
    return keep_first(rows.withColumns({"postal_code": code, "city": city}).drop("__rest"), ["file", "store_id"], "pos")[0].drop("pos")
