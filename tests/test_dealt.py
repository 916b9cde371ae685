"""Steps whose memory or time for a row must not grow with the table: rows are dealt to tasks by their number."""

from collections import Counter

import pytest

from tallyforge import session
from tallyforge.operators import administration, discover
from tallyforge.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_families_overlap_without_a_row_for_each_pair_of_a_member(spark):
    """the members were joined with themselves, which made a row for each pair of a member's families, twice."""
    rows = [(f, m) for m in range(40) for f in range(m % 13)] + [(0, 3), (None, 1), (1, None), (50, 77)] + [(f, 99) for f in range(20, 45)]
    for parts in (None, 3):
        got = discover.overlaps(spark.createDataFrame(rows, "family long, id long"), parts=parts)
        assert not [x for x in plan_of(got).splitlines() if "Join" in x and "[m#" in x]
        held = {}
        for f, m in rows:
            if f is not None and m is not None:
                held.setdefault(f, set()).add(m)
        want = {}
        for a in held:
            for b in held:
                n = len(held[a] & held[b])
                if a < b and n:
                    want[a, b] = (n, round(n / len(held[a]), 4), round(n / len(held[b]), 4), round(n / len(held[a] | held[b]), 4))
        assert {(r.a, r.b): tuple(r)[2:] for r in got.collect()} == want and len(want) > 300


@pytest.mark.parametrize("name,keys", [("a26_planned_actual", "l_orderkey"), ("e28_kept_mappings", "sp_id"), ("e28_kept_mappings", "l_partkey"), ("a20_overlaps", "l_partkey")])
def test_tasks_grow_with_the_rows(spark, sf, monkeypatch, name, keys):
    """F16, F19: as few tasks as Spark found enough by the packed bytes sorted and counted all rows."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    dealt = [x for x in plan_of(QUERIES[name](spark, sf)).splitlines() if "Exchange hashpartitioning" in x and f", {n})" in x]
    assert n > 10 and (any(keys in x for x in dealt) or keys == "l_partkey" and any("m#" in x for x in dealt)), dealt


def test_mappings_are_kept_as_often_as_they_are_missed(spark):
    """F16: rows were counted where they were read, before they were dealt out."""
    before = [(1, 5)] * 3 + [(2, 5), (2, 6), (3, None), (None, 4), (7, 7)]
    after = [(1, 5), (2, 6), (2, 6), (9, 9), (7, None)]
    mapped = lambda rows: spark.createDataFrame(rows, "sp_id long, product_id long")
    got = administration.kept_mappings(mapped(before), mapped(after))
    plan = plan_of(got)
    assert Counter(map(tuple, got.collect())) == Counter({(1, 5): 2, (2, 5): 1, (None, 4): 1, (7, 7): 1})
    assert plan.index("partial_sum") < plan.index("Exchange"), plan
