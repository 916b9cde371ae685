"""Steps that send so much that disk must not hold all of it at once: narrow rows, dealt to tasks by their number, in turns."""

import glob
from decimal import Decimal

import compare
import pytest
from pyspark.sql import functions as F

from tallyforge import session
from tallyforge.operators import compare as operators
from tallyforge.plans.queries import ORACLE, QUERIES
from tallyforge.sources import bind


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_subtotals_take_carts_in_turns(spark, sf, monkeypatch, batch):
    """every line sent a row for each city, all at once, to as few tasks as Spark found enough by the packed bytes."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(session, "TASK_ROWS", 400)
    monkeypatch.setattr(session, "TURN_TASKS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        taken_in_turns(spark, sf)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def taken_in_turns(spark, sf):
    parts = session.tasks(session.table(spark, sf, "lineitem"))
    n = session.turns(parts)
    found = lambda: set(glob.glob(f"{session.ensure_checkpoint_dir(spark).removeprefix('file:')}/*"))
    before = found()
    names, extra, missing = compare.differences(QUERIES["c08_options_by_city"](spark, sf), compare.connect(sf), ORACLE["c08_options_by_city"])
    assert names and not extra and not missing, (list(extra)[:3], list(missing)[:3])
    new = [x.rsplit("/", 1)[1] for x in found() - before]
    assert n > 3 and sum(x.startswith("subtotals-") for x in new) == n and not [x for x in new if x.startswith("scratch-")], new


def test_subtotals_of_all_pools(spark):
    """Partial, delayed, unlimited and equal offers, a value that is null, and a line with no offer."""
    offer = "product_id long, city string, stock int, reference_quantity decimal(12,3), price decimal(12,2), tax_basis string, vat_rate decimal(5,2), fulfillment string, latitude double, longitude double"
    d = Decimal
    rows = [
        (1, "a", 5, d(2), d("1.10"), "HT", None, None, 1.0, 1.0), (1, "a", 3, d(2), d("0.10"), "HT", None, None, 1.0, 1.0), (1, "b", 0, d(1), d("3.33"), "TTC", d("20.00"), None, None, None),
        (1, None, 9, d(1), d("7.00"), "HT", None, "delayed", 1.0, 1.0), (1, None, None, d(1), d("8.00"), "HT", None, "order_only", 1.0, 1.0), (1, None, 2, d(1), d("9.00"), "HT", None, None, 1.0, 1.0), (1, "c", 9, d(1), d("1.00"), "TTC", None, None, 1.0, 1.0),
        (2, "a", 0, d(1), d("1.00"), "HT", None, None, 1.0, 1.0), (2, "b", 4, d(1), d("1.00"), "HT", None, "order_only", 1.0, 1.0), (2, "b", 4, d(1), d("1.00"), "HT", None, "unavailable", 1.0, 1.0),
    ]
    lines = spark.createDataFrame([(1, 1, d(4)), (1, 2, d(1)), (2, 1, d(20)), (3, 3, d(1))], "cart_id long, product_id long, quantity decimal(10,3)")
    for turns in (1, 3):
        got = operators.subtotals(lines, spark.createDataFrame(rows, offer), "city", "HT", 3, turns)
        # Cart 1: two packs at 0.10 in a; four at 3.33 / 1.2 in b, and one on order; in no city the partial offer comes before the delayed one.
        want = {(1, "a", 20, 1), (1, "b", 1110 + 100, 1), (1, None, 1800, 0), (2, "a", 550, 0), (2, "b", 5550, 1), (2, None, 1800, 0)}
        assert {tuple(r) for r in got.select("cart_id", "city", "subtotal_cents", "lines_available").collect()} == want


@pytest.mark.parametrize("name", ["a10_option_totals", "compare_best_offer", "r02_partial_lines"])
def test_best_offers_are_found_by_tasks_that_grow_with_the_rows(spark, sf, monkeypatch, name):
    """offers were sent by part and supplier and again by part, with all that is shown of them, and a line's offer four times to its cart."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    n, plans, write = session.tasks(session.table(spark, sf, "lineitem")), [], operators.written
    monkeypatch.setattr(operators, "written", lambda df, *a, **k: plans.append(plan_of(df)) or write(df, *a, **k))
    plans.append(plan_of(QUERIES[name](spark, sf)))
    sent = [x for p in plans for x in p.splitlines() if "Exchange hashpartitioning" in x]
    assert n > 10 and sent and all(f", {n})" in x for x in sent), sent
    if name == "a10_option_totals":
        assert len([x for x in sent if "cart_id" in x]) == 1, sent


def test_cart_totals_are_those_of_the_chosen_offers(spark, sf):
    lines, offers = bind.cart_lines(spark, sf), bind.offers(spark, sf)
    lines = lines.unionByName(lines.where("cart_id % 10 = 0").withColumn("product_id", F.col("product_id") + 1_000_000))
    lines = lines.unionByName(lines.where("cart_id % 10 = 3").selectExpr("-cart_id - 1 AS cart_id", "product_id + 1000000 AS product_id", "quantity"))
    want = operators.option_totals(lines, operators.best_lines(lines, offers, "TTC", (46.0, 2.0)))
    got = operators.cart_totals(lines, offers, "TTC", (46.0, 2.0), 3)
    assert got.dtypes == want.dtypes
    got, want = (sorted(map(tuple, df.collect())) for df in (got, want))
    assert got == want and min(got)[0] < 0 and any(x[1] for x in got)
