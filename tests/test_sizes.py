"""What only shows on larger tables: rare keys and dates, repeated labels, tasks and plans that must not grow with the rows."""

import datetime
import os

import compare
import pytest

from tallyforge.operators import catalogue_rules, resolve, signatures
from tallyforge.plans.queries import ORACLE, QUERIES


@pytest.fixture()
def tables(spark, sf, tmp_path):
    """A folder like ``sf`` with some of the tables put in others' place."""

    def made(**changed):
        for name in os.listdir(sf):
            if name.removesuffix(".parquet") not in changed:
                os.symlink(f"{sf}/{name}", tmp_path / name)
        for name, rows in changed.items():
            rows.toPandas().to_parquet(tmp_path / f"{name}.parquet", engine="pyarrow", coerce_timestamps="us")
        return str(tmp_path)

    return made


def same(spark, folder, name):
    names, extra, missing = compare.differences(QUERIES[name](spark, folder), compare.connect(folder), ORACLE[name])
    assert names and not extra and not missing, (list(extra)[:3], list(missing)[:3])


def test_origins_with_an_agency_at_the_company(spark, sf, tables):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    one = s.limit(1).selectExpr(*("CAST(4200 AS BIGINT) AS s_suppkey" if c == "s_suppkey" else c for c in s.columns))
    same(spark, tables(supplier=s.union(one)), "s23_origins")


def test_projects_of_any_date(spark, sf, tables):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    one = o.limit(1).selectExpr(*({"o_orderkey": "CAST(2100000021 AS BIGINT) AS o_orderkey", "o_orderdate": "TIMESTAMP_NTZ '2001-01-01' AS o_orderdate"}.get(c, c) for c in o.columns))
    assert one.first()["o_orderdate"] == datetime.datetime(2001, 1, 1)
    same(spark, tables(orders=o.union(one)), "w25_projects")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("read", [catalogue_rules.catalogue_claims, resolve.extract, resolve.claims, signatures.read_labels])
def test_labels_are_read_once_each_and_by_all_tasks(spark, read):
    """One task held all rows before, and each row was read by itself within the plan of the result."""
    rows = spark.range(0, 4000, 1, 1).selectExpr("id", "element_at(array('Vis agglo 4 x 40 mm', 'Câble R2V 3G1,5 mm² noir - 5 m', CAST(NULL AS STRING), ''), CAST(id % 4 + 1 AS INT)) AS designation")
    got = read(rows)
    plan = plan_of(got)
    assert "RLIKE" not in plan and "regexp" not in plan and "SortMergeJoin" in plan
    few = read(rows.where("id < 4")).drop("id").collect()
    many = got.drop("id").collect()
    assert {str(r) for r in many} == {str(r) for r in few} and len(many) == 1000 * len(few)


@pytest.mark.parametrize("name", ["compare_best_offer", "r02_partial_lines", "a10_option_totals", "c08_options_by_city"])
def test_no_row_of_a_line_and_an_offer_is_sorted_for_its_rank(spark, sf, name):
    """The best offer was the least of structs before, for which Spark sorts all rows."""
    sorts = [x for x in plan_of(QUERIES[name](spark, sf)).splitlines() if "SortAggregate" in x and "cart_id" in x]
    assert not sorts, sorts


def test_no_carts_are_broadcast_for_their_plans(spark, sf):
    """Carts' tables pack so well that they looked small: F2, they went through the driver."""
    plan = plan_of(QUERIES["c14_strategies"](spark, sf))
    assert "cart_id" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin [cart_id" in x]
