"""Upkeep by hand of catalogue and projects: pack overrides, retained plans, projects with tokens, connectors, origins, leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.feeds_text import name_key
from tallyforge.functions.text import fold, search_key
from tallyforge.functions.units import normalize_unit
from tallyforge.operators.projects import fingerprints


def set_packs(references: DataFrame, offers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, offers, outcomes) after overrides by hand, which later imports leave alone.

    ``requests``: sp_id (each once), supplier_unit, packaging_quantity, reference_unit, reference_quantity, and for the
    reference's offers price, tax_basis, vat_rate, which may be null, and clear_vat. Quantities have to be positive, units
    given, the basis HT or TTC, the rate within 0 and 100; else the request is invalid and changes nothing.
    """
    unit, own = normalize_unit("reference_unit"), F.nullif(F.trim("supplier_unit"), F.lit(""))
    fine = (F.col("packaging_quantity") > 0) & (F.col("reference_quantity") > 0) & unit.isNotNull() & own.isNotNull()
    fine = fine & (F.col("tax_basis").isNull() | F.col("tax_basis").isin("HT", "TTC")) & (F.col("vat_rate").isNull() | F.col("vat_rate").between(0, 100))
    there = references.select("sp_id", F.lit(True).alias("__there"))
    asked = requests.where("sp_id IS NOT NULL").join(there, "sp_id", "left").withColumn("outcome", F.when(F.col("__there").isNull(), "unknown_reference").when(F.coalesce(fine, F.lit(False)), "changed").otherwise("invalid"))
    done = asked.where("outcome = 'changed'").select(
        "sp_id", F.substring(own, 1, 40).alias("__supplier_unit"), F.col("packaging_quantity").alias("__packaging_quantity"), unit.alias("__reference_unit"), F.col("reference_quantity").alias("__reference_quantity"),
        F.lit("manual").alias("__correction_source"), F.col("price").alias("__price"), F.col("tax_basis").alias("__tax_basis"), F.col("vat_rate").alias("__vat_rate"), F.coalesce("clear_vat", F.lit(False)).alias("__clear"), F.lit(True).alias("__hit"),
    )

    def taken(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
        new = df.join(done, "sp_id", "left")
        value = lambda c: F.when(F.col("__clear"), F.col("__vat_rate")).otherwise(F.coalesce("__vat_rate", "vat_rate")) if c == "vat_rate" else F.coalesce(F.col(f"__{c}"), F.col(c))
        return new.select(*((F.when(F.col("__hit"), value(c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)) for c in df.columns))

    return taken(references, ("supplier_unit", "packaging_quantity", "reference_unit", "reference_quantity", "correction_source")), taken(offers, ("price", "tax_basis", "vat_rate")), asked.select("sp_id", "outcome")


def clear_override(references: DataFrame, requests: DataFrame) -> DataFrame:
    """References whose override goes, so that the next import may write their packs again."""
    hit = requests.select("sp_id").distinct().withColumn("__hit", F.lit(True))
    return references.join(hit, "sp_id", "left").withColumn("correction_source", F.when(F.col("__hit").isNull(), F.col("correction_source"))).select(*references.columns)


def _token(now: Column) -> Column:
    """The next state of updated_at: now, but later than the one before."""
    return F.greatest(now, F.col("updated_at") + F.expr("interval 1 microsecond"))


def retain_plans(projects: DataFrame, materials: DataFrame, retained: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, retained, outcomes) after plans were chosen.

    ``projects``: project_id, updated_at; ``retained`` and ``requests`` (project_id once): project_id, fingerprint, plan (a JSON text);
    requests also expected, the updated_at they were made on. A plan is saved if its fingerprint is that of the project's
    materials (else stale) and nothing changed meanwhile (else conflict). It takes the place of the one before.
    """
    prints = fingerprints(materials).select("project_id", F.col("fingerprint").alias("__now"))
    asked = requests.join(projects.select("project_id", "updated_at"), "project_id", "left").join(prints, "project_id", "left")
    same = F.coalesce("__now", F.lit("")) == F.col("fingerprint")
    outcome = F.when(F.col("updated_at").isNull(), "unknown_project").when(~F.coalesce(same, F.lit(False)), "stale").when(F.col("expected") == F.col("updated_at"), "saved").otherwise("conflict")
    asked = asked.withColumn("outcome", outcome)
    saved = asked.where("outcome = 'saved'")
    hit = saved.select("project_id", F.lit(True).alias("__hit"))
    left = projects.join(hit, "project_id", "left").withColumn("updated_at", F.when(F.col("__hit"), _token(now)).otherwise(F.col("updated_at"))).select(*projects.columns)
    kept = retained.join(hit, "project_id", "left_anti").unionByName(saved.select(*retained.columns))
    return left, kept, asked.select("project_id", "outcome")


def write_projects(projects: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(projects, outcomes) after updates and deletions (project_id once, action, name, expected).

    Either holds only if the project is as it was when the request was made; else it is a conflict. A new name changes
    the token too; a blank or missing one is invalid.
    """
    asked = requests.join(projects.select("project_id", "updated_at"), "project_id", "left")
    outcome = (
        F.when(F.col("updated_at").isNull(), "unknown_project").when(~F.coalesce(F.col("expected") == F.col("updated_at"), F.lit(False)), "conflict").when(F.col("action") == "delete", "deleted")
        .when(F.coalesce(F.trim("name"), F.lit("")) == "", "invalid").otherwise("updated")
    )
    asked = asked.withColumn("outcome", outcome)
    hit = asked.where("outcome IN ('updated', 'deleted')").select("project_id", F.col("outcome").alias("__outcome"), F.trim("name").alias("__name"))
    out = projects.join(hit, "project_id", "left").where("coalesce(__outcome, '') <> 'deleted'")
    new = F.col("__outcome") == "updated"
    out = out.withColumns({"name": F.when(new, F.col("__name")).otherwise(F.col("name")), "updated_at": F.when(new, _token(now)).otherwise(F.col("updated_at"))})
    return out.select(*projects.columns), asked.select("project_id", "outcome")


def comparison_connectors(suppliers: DataFrame, live: DataFrame, preferred: tuple[str, ...] = ()) -> DataFrame:
    """(connector, supplier, kind, rank): what a comparison asks, catalogues first in the preferred order and then by name, live ones after them.

    ``suppliers``: supplier, source_type, active; ``live``: supplier, active. A catalogue makes way for the live connector of the
    same name, however it is written; inactive suppliers have neither.
    """
    key = lambda c: name_key(F.col(c))
    off = suppliers.where("NOT coalesce(active, false)").select(key("supplier").alias("__key")).distinct()
    on = live.where("coalesce(active, false)").withColumn("__key", key("supplier")).join(off, "__key", "left_anti")
    files = suppliers.where("coalesce(active, false)").withColumn("__key", key("supplier")).join(on.select("__key").distinct(), "__key", "left_anti")
    source = F.coalesce("source_type", F.lit("demo"))
    place = F.nullif(F.array_position(F.array(*map(F.lit, preferred or ("",))), F.col("supplier")), F.lit(0))
    out = files.select(F.concat_ws(":", source, "supplier").alias("connector"), "supplier", F.lit("catalogue").alias("kind"), F.struct(F.lit(0), F.coalesce(place, F.lit(1000)), "supplier").alias("__o"))
    out = out.unionByName(on.select(F.concat(F.lit("api:"), "supplier").alias("connector"), "supplier", F.lit("live").alias("kind"), F.struct(F.lit(1), F.lit(1000).cast("bigint"), "supplier").alias("__o")))
    # A comparison asks a few dozen connectors; they are ranked in one place.
    return out.withColumn("rank", F.expr("row_number() OVER (ORDER BY __o)")).drop("__o")


#: What origins of a kind are called.
ORIGIN_LABELS = {"site": "Chantier", "current_location": "Ma position", "company": "Entreprise", "other": "Autre adresse"}


def resolve_origins(requests: DataFrame, addresses: DataFrame, places: DataFrame, site: tuple[float, float], company: tuple[float, float, str]) -> DataFrame:
    """(id, type, label, source, latitude, longitude, address, city) of each request (id, type, latitude, longitude, address).

    A request without a type is at the configured site; the company's own coordinates count for it, given ones for
    others. ``places`` (latitude, longitude, city, address) tells what is there, to five decimals; where it tells nothing
    the coordinates do. Without coordinates the address is looked up in ``addresses`` (address, latitude, longitude, city), by
    its letters and digits; of several the one with the smallest coordinates counts; without one the source is 'unknown'.
    """
    known = addresses.groupBy(search_key("address").alias("__key")).agg(F.min(F.struct("latitude", "longitude", "city")).alias("__found"))
    there = places.groupBy(F.round("latitude", 5).alias("__lat"), F.round("longitude", 5).alias("__lon")).agg(F.min(F.struct("city", "address")).alias("__there"))
    kind, firm = F.col("type"), F.col("type") == "company"
    lat = F.when(kind.isNull(), F.lit(site[0])).when(firm, F.lit(company[0])).otherwise(F.col("latitude"))
    lon = F.when(kind.isNull(), F.lit(site[1])).when(firm, F.lit(company[1])).otherwise(F.col("longitude"))
    rows = requests.withColumns({"__y": lat, "__x": lon}).withColumns({"__lat": F.when(kind.isNotNull(), F.round("__y", 5)), "__lon": F.round("__x", 5), "__key": F.when(F.col("__y").isNull(), search_key("address"))})
    rows = rows.join(there, ["__lat", "__lon"], "left").join(known, "__key", "left")
    labels = F.create_map(*(F.lit(x) for pair in ORIGIN_LABELS.items() for x in pair))
    source = F.when(kind.isNull(), "configuration").when(F.col("__there").isNotNull(), "reverse").when(firm, "configuration").when(F.col("__y").isNotNull(), "coordinates").when(F.col("__found").isNotNull(), "address").otherwise("unknown")
    given = F.when(firm, F.lit(company[2])).when(F.col("__y").isNull(), F.col("address"))
    return rows.select(
        "id", F.coalesce(kind, F.lit("site")).alias("type"), labels[F.coalesce(kind, F.lit("site"))].alias("label"), source.alias("source"), F.coalesce("__y", "__found.latitude").alias("latitude"), F.coalesce("__x", "__found.longitude").alias("longitude"),
        F.coalesce(given, F.col("__there.address")).alias("address"), F.coalesce("__there.city", "__found.city").alias("city"),
    )


def leftover_heads(references: DataFrame, text_col: str = "designation") -> DataFrame:
    """(head, n): the first words of the labels that are mapped to nothing, '?' without any."""
    first = F.try_element_at(F.split(F.trim(fold(F.coalesce(text_col, F.lit("")))), r"\s+"), F.lit(1))
    return references.where("product_id IS NULL").groupBy(F.coalesce(F.nullif(first, F.lit("")), F.lit("?")).alias("head")).agg(F.count("*").alias("n"))


#: Families of what is left over, by the first pattern that a folded label holds.
LEFTOVERS = {
    "peinture": r"\bpeinture\b", "meuble": r"\bmeuble\b|\bfacade\b", "menuiserie": r"\bporte\b|\bfenetre\b|\bvolet\b|\bbloc[- ]porte\b", "carrelage": "carrelage|gres cere|faience", "stratifie": "stratif", "lame_sol": r"\blame\b",
    "robinetterie": "robinet|mitigeur|melangeur", "radiateur": r"\bradiateur\b", "lot_kit": r"\blot de\b|\bkit de\b|\bboite de\b", "enduit": r"\benduit\b", "mortier_colle": r"\bmortier\b|\bcolle\b",
    "appareillage": r"\bprise\b|\binterrupteur\b|\bva[- ]et[- ]vient\b", "plinthe": r"\bplinthe\b",
}


def leftover_buckets(references: DataFrame, text_col: str = "designation") -> DataFrame:
    """(bucket, n) of the labels that are mapped to nothing; other where no pattern fits."""
    rows = references.where("product_id IS NULL").select(fold(F.coalesce(text_col, F.lit(""))).alias("t"))
    bucket = F.coalesce(*(F.when(F.col("t").rlike(p), F.lit(name)) for name, p in LEFTOVERS.items()), F.lit("other"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def run_counts(matches: DataFrame, mapped: DataFrame) -> DataFrame:
    """(rule, outcome, n) of a run: what was mapped before (``mapped``: id) is not counted by its match."""
    seen = mapped.select("id").distinct().withColumn("__mapped", F.lit(True))
    outcome = F.when(F.col("__mapped"), "ALREADY_MAPPED").otherwise(F.col("reason"))
    return matches.join(seen, "id", "left").groupBy("rule", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def mark_legacy(products: DataFrame, twins: DataFrame) -> DataFrame:
    """Products with legacy set: those with a code of PMC and four digits, and those in ``twins`` (product_id)."""
    twin = twins.select("product_id").distinct().withColumn("__twin", F.lit(True))
    return products.join(twin, "product_id", "left").withColumn("is_legacy", F.coalesce("is_legacy", F.lit(False)) | F.coalesce(F.col("code").rlike("^PMC[0-9]{4}$"), F.lit(False)) | F.col("__twin").isNotNull()).select(*products.columns)
