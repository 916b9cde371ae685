"""Projects: fingerprints of their materials, retained plans, purchases against plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(materials: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, fingerprint): 'id:quantity' with three places, in the order of ids, joined by '|'."""
    part = F.struct("product_id", F.col("quantity").cast("decimal(12,3)").alias("quantity"))
    text = F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat(x["product_id"].cast("string"), F.lit(":"), x["quantity"].cast("string")))
    return materials.groupBy(by).agg(F.array_join(text, "|").alias("fingerprint"))


def project_status(projects: DataFrame, materials: DataFrame, retained: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, n_materials, status): none without a retained plan, retained if its fingerprint still holds, else obsolete."""
    n = materials.groupBy(by).agg(F.count("*").alias("n_materials"))
    kept = retained.select(by, F.col("fingerprint").alias("__kept"))
    out = projects.select(by).join(n, by, "left").join(fingerprints(materials, by), by, "left").join(kept, by, "left")
    status = F.when(F.col("__kept").isNull(), "none").when(F.col("__kept") == F.coalesce("fingerprint", F.lit("")), "retained").otherwise("obsolete")
    return out.select(by, F.coalesce("n_materials", F.lit(0)).alias("n_materials"), status.alias("status"))


def tracked_lines(planned: DataFrame, bought: DataFrame, by: str = "project_id") -> DataFrame:
    """Planned lines with what was bought: actual total, variance, and whether the line is complete. Unknown stays null."""
    rows = planned.join(bought, [by, "line_key"], "left")
    actual = F.round(F.col("actual_quantity") * F.col("actual_price"), 2).cast("decimal(14,2)")
    return rows.withColumn("actual_total", actual).withColumn("variance", F.col("actual_total") - F.col("planned_total")).withColumn("completed", F.coalesce("bought", F.lit(False)))


def planned_against_actual(lines: DataFrame, by: str = "project_id") -> DataFrame:
    """Totals of each project; plan and purchase are compared over completed lines with a known total only."""
    known = F.col("completed") & F.col("actual_total").isNotNull()
    return lines.groupBy(by).agg(
        F.sum("planned_total").alias("planned"), F.sum(F.when(known, F.col("planned_total"))).alias("planned_completed"),
        F.sum(F.when(known, F.col("actual_total"))).alias("actual_completed"), F.count_if(known).alias("lines_completed"), F.count("*").alias("lines"),
    )


def store_subtotals(lines: DataFrame, by: str = "project_id") -> DataFrame:
    """Planned total of each stop, in the order of the tour."""
    return lines.groupBy(by, "agency_key").agg(F.sum("planned_total").alias("subtotal"), F.min("stop").alias("stop"), F.count("*").alias("lines"))
