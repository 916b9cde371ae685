"""Import of offer files: whole versions of all tables, once, again and with what is protected."""

from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import imports
from tallyforge.sources import feeds

FILE = str(Path(__file__).parent / "data" / "offers.csv")


@pytest.fixture(scope="module")
def read(spark):
    return feeds.validate_offers(feeds.read_offer_csv(spark, FILE))


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(1, "PRD000001"), (2, "PRD000002"), (7, "X")], "product_id long, code string")


@pytest.fixture(scope="module")
def first(spark, read, products):
    return imports.import_offers(*read, imports.empty_tables(spark), products, "offers.csv", "20260925-100000")


def counted(actions):
    return {(r.table, r.action): r.n for r in actions.collect()}


def test_lines_and_size(spark, read, tmp_path):
    assert sorted(r.line for r in read[0].collect()) == [2, 3, 4, 5, 6] and read[1].count() == 0
    with pytest.raises(ValueError, match="more than 100 bytes"):
        feeds.read_offer_csv(spark, FILE, 100)
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("supplier,agency_external_id,product_external_reference,product_name,currency,tax_basis,price\n" + "".join(f"S,A,R{k}{i},N,EUR,HT,1\n" for i in range(3)))
    assert sorted(r.line for r in feeds.read_offer_csv(spark, str(tmp_path)).collect()) == [2, 2, 3, 3, 4, 4]


def test_first_import(first):
    tables, actions = first
    assert [(r.supplier_id, r.supplier) for r in tables["suppliers"].orderBy("supplier_id").collect()] == [(1, "NORD"), (2, "SUD")]
    assert [(r.agency_id, r.external_id, r.agency_name, r.city, r.latitude) for r in tables["agencies"].orderBy("agency_id").collect()] == [(1, "N-1", "Nord Est", "Paris", 48.84), (2, "N-2", "Nord Ouest", "Ivry", None), (3, None, "SUD (catalogue national)", "", None)]
    refs = {r.supplier_reference: r for r in tables["references"].collect()}
    assert {k: (r.sp_id, r.product_id, r.designation, r.reference_quantity, r.packaging_quantity) for k, r in refs.items()} == {
        "R-1": (1, 1, "Plaque BA13 blanche", Decimal(1), Decimal(1)), "R-2": (2, 2, "Rail R48", Decimal(10), Decimal(1)), "R-3": (3, None, "Vis\nen vrac", Decimal(1), Decimal(1)), "S-1": (4, None, "Sac", Decimal(1), Decimal(1)),
    }
    assert refs["R-1"].brand == "Maison" and refs["R-3"].supplier_unit == "unité" and all(r.introduced_by == 1 for r in refs.values())
    assert {(r.sp_id, r.agency_id): (float(r.price), r.stock, r.preparation_minutes) for r in tables["offers"].collect()} == {(1, 1): (8.5, 80, 45), (1, 2): (14.5, 8, 90), (2, 1): (2.9, 4, 45), (4, 3): (22.0, 5, 120)}
    line = tables["imports"].first()
    assert (line.source_key, line.tax_basis, line["rows"], line.with_price, line.without_price, line.agencies, line["references"], line.mapped) == ("import-20260925-100000", "MIXED", 5, 4, 1, 2, 4, 2)
    assert counted(actions) == {("suppliers", "created"): 2, ("agencies", "created"): 3, ("references", "created"): 4, ("offers", "created"): 4}


def test_again_changes_nothing_but_provenance(read, products, first):
    tables, actions = imports.import_offers(*read, first[0], products, "offers.csv", "20260925-100000")
    assert counted(actions) == {("suppliers", "unchanged"): 2, ("agencies", "unchanged"): 3, ("references", "unchanged"): 4, ("offers", "unchanged"): 4}
    assert {r.source_key for r in tables["offers"].collect()} == {"import-20260925-100000-002"} and tables["imports"].count() == 2


def test_protected_references_overrides_and_issues(spark, read, products, first):
    tables = dict(first[0])
    guard = F.col("supplier_reference") == "R-2"
    tables["references"] = tables["references"].withColumns({
        "correction_source": F.when(guard, "manual").otherwise(F.col("correction_source")), "product_id": F.when(guard, 7).otherwise(F.col("product_id")), "reference_quantity": F.when(guard, F.lit(5).cast("decimal(12,3)")).otherwise(F.col("reference_quantity")),
        "designation": F.when(guard, "x").otherwise(F.col("designation")),
    }).checkpoint()
    said = spark.createDataFrame([("NORD", "R-1", None), ("NORD", "R-2", 1), ("SUD", "S-1", 7)], "supplier string, supplier_reference string, product_id long")
    after, _ = imports.import_offers(*read, tables, products, "offers.csv", "x", said)
    refs = {r.supplier_reference: r for r in after["references"].collect()}
    assert (refs["R-2"].product_id, refs["R-2"].correction_source, refs["R-2"].reference_quantity, refs["R-2"].designation) == (7, "manual", Decimal(5), "Rail R48")
    assert refs["R-1"].product_id is None and refs["S-1"].product_id == 7
    assert {(r.sp_id, r.agency_id): r.stock for r in after["offers"].collect()}[(2, 1)] == 9
    bad = spark.createDataFrame([(3, "price", "price")], "line long, code string, column string")
    same, none = imports.import_offers(read[0], bad, tables, products, "offers.csv", "x")
    assert same is tables and none.count() == 0
    empty, _ = imports.import_offers(read[0].limit(0), read[1], tables, products, "offers.csv", "y")
    assert empty["offers"].count() == 4 and empty["imports"].count() == 2


def test_ids_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5)
    assert [(r.k, r.i) for r in imports.numbered(rows, ["k"], "i", 40).orderBy("k").collect()] == [(k, 41 + k) for k in range(1000)]
