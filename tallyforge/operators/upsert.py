"""Keyed merges of tables, written as new versions: diffs, protected fields, removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources of a mapping that an import never overwrites.
PROTECTED = ("manual", "exact_rule", "specific", "ean", "equiv")


def diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, action): created, updated, unchanged, or absent from the new rows."""
    o = old.select(*keys, F.struct(*fields).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(*keys, F.struct(*fields).alias("__new"), F.lit(True).alias("__in_new"))
    same = F.col("__old").eqNullSafe(F.col("__new"))
    action = F.when(F.col("__in_old").isNull(), "created").when(F.col("__in_new").isNull(), "absent").when(same, "unchanged").otherwise("updated")
    return o.join(n, keys, "full").select(*keys, action.alias("action"))


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], fields: dict[str, Column | None] | list[str]) -> DataFrame:
    """Old rows with the new values, and rows that are new.

    ``fields`` names what is taken over. Given as a dict, a value is a condition on the old row (its columns
    are prefixed ``old_``) under which the field keeps its old value; None for none. A missing new value doesn't
    overwrite. Fields not named keep their old value.
    """
    fields = fields if isinstance(fields, dict) else dict.fromkeys(fields)
    o = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys), F.lit(True).alias("__in_old"))
    n = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys))
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in fields and c in new.columns:
            value = F.coalesce(F.col(f"new_{c}"), F.col(f"old_{c}"))
            keep = fields[c]
            out.append((F.when(F.col("__in_old") & keep, F.col(f"old_{c}")).otherwise(value) if keep is not None else value).alias(c))
        else:
            out.append((F.when(F.col("__in_old"), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")) if c in new.columns else F.col(f"old_{c}")).alias(c))
    return o.join(n, keys, "full").select(*out)


def merge_references(old: DataFrame, new: DataFrame) -> DataFrame:
    """Import of supplier references: labels are taken over, a mapping only where its source isn't protected."""
    guarded = F.col("old_correction_source").isin(*PROTECTED)
    return merge(old, new, ["supplier_id", "supplier_reference"], {"designation": None, "brand": None, "active": None, "product_id": guarded, "correction_source": guarded})


def deactivate_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the export no longer holds become inactive."""
    there = new.select(*keys).distinct().withColumn("__there", F.lit(True))
    return old.join(there, keys, "left").withColumn("active", F.col("active") & F.col("__there").isNotNull()).drop("__there")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(kept, repeated): the first row of each key, and the later ones."""
    ranked = rows.withColumn("__r", F.expr(f"row_number() over (partition by {', '.join(keys)} order by {order})"))
    return ranked.where("__r = 1").drop("__r"), ranked.where("__r > 1").drop("__r")


def compare_and_set(rows: DataFrame, key: Column, token: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows with changes where key and token hold; others, such as those changed meanwhile, stay."""
    hit = key & token
    return rows.select(*((F.when(hit, changes[c]).otherwise(F.col(c)).alias(c)) if c in changes else F.col(c) for c in rows.columns))


def replace_children(children: DataFrame, parents: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """Children of the given parents make way for the new ones."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_catalog(catalog_id: int, offers: DataFrame, supplier_products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offers, references) without a catalogue: its offers go, then its references that are unmapped and have no offer
    left; other references of it are unlinked."""
    left = offers.where(~F.coalesce(F.col("catalog_id") == catalog_id, F.lit(False)))
    keys = ["supplier_id", "supplier_reference"]
    used = left.select(*keys).distinct().withColumn("__used", F.lit(True))
    own = F.coalesce(F.col("catalog_id") == catalog_id, F.lit(False))
    rows = supplier_products.join(used, keys, "left").where(~(own & F.col("product_id").isNull() & F.col("__used").isNull())).drop("__used")
    return left, rows.withColumn("catalog_id", F.when(~own, F.col("catalog_id"))).select(*supplier_products.columns)


def resolve_mapping(rows: DataFrame, products: DataFrame, known: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """A product for each imported row: an override, which may say none, else the row's product code, else the known mapping."""
    by_code = products.select(F.col("code").alias("product_code"), F.col("product_id").alias("__by_code"))
    keys = ["supplier_id", "supplier_reference"]
    out = rows.join(by_code, "product_code", "left").join(known.select(*keys, F.col("product_id").alias("__known")), keys, "left")
    value = F.coalesce("__by_code", "__known")
    if overrides is not None:
        out = out.join(overrides.select(*keys, F.col("product_id").alias("__said"), F.lit(True).alias("__over")), keys, "left")
        value = F.when(F.col("__over"), F.col("__said")).otherwise(value)
    return out.withColumn("product_id", value).select(*rows.columns, "product_id")
