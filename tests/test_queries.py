"""Registered queries: contract, plans, and agreement with their SQL twins on the smallest tables."""
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLED = [
    "join_01_zone_of_parcel", "join_05_nearest_per_category", "join_08_near_relations", "join_13_adjacency", "agg_07_building_aggregates", "agg_15_diagnosis",
    "scr_01_scored_search", "win_04_progressive_relaxation", "win_04_semantic_fallback", "flt_17_neighborhood_card", "stm_04_phase_steps", "win_09_feedback_rerank", "mat_01_search_places", "txt_02_keywords", "vec_04_vector_with_constraints", "snk_08_upsert",
]


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{round(float(v), 4) + 0.0:.4f}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 200 and set(o) <= set(q)
    own = {n for n in set(q) - set(o) if not re.match(r"op\d+_|pipeline$", n)}
    assert not own


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["id_dzialki", "gmina", "area_m2"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLED)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["join_08_near_relations", "vec_07_resolve_location", "mat_01_search_places", "win_09_feedback_rerank", "scr_01_scored_search", "join_16_category_edges"])
def test_no_cartesian_plan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark):
    from hectara.plans.testbed import raw

    plan = raw(spark, SF, "lineitem").filter("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan
