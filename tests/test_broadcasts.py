"""Sides that nobody counted are not broadcast, however small Spark thinks their files are."""

from hectara.catalog import load
from hectara.operators import edges as E
from hectara.operators import graph as G
from hectara.operators import relations as R
from hectara.plans.testbed import table

SF = "/root/testdata/sf0.001"
QUERIES = load().QUERIES


def planned_broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin")


def test_borders_are_not_broadcast(spark):
    assert planned_broadcasts(E.adjacent_pairs(table(spark, SF, "bricks"), "plot_id")) == 0


def test_paths_and_neighbours_are_not_broadcast(spark):
    bricks = table(spark, SF, "bricks")
    pairs = E.adjacent_pairs(bricks, "plot_id")
    assert planned_broadcasts(R.same_district_paths(pairs, bricks.select("plot_id", "district"))) == 0
    assert planned_broadcasts(QUERIES["join_24_neighbours"](spark, SF)) == 0


def test_validity_is_not_broadcast(spark):
    assert planned_broadcasts(QUERIES["geo_11_validity"](spark, SF)) == 0


def test_embedding_rounds_hold_one_row_a_kind(spark, monkeypatch):
    """Items with the same nodes share their vectors, so no written table of vectors grows with the items."""
    rows = []
    cut = G.cut_lineage

    def counted(df):
        out = cut(df)
        if any(f.dataType.typeName() == "array" for f in out.schema):
            rows.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", counted)
    links = spark.createDataFrame([(f"i{i}", f"n{n}", "r") for i in range(60) for n in (i % 2, 2)], "src string, dst string, rel string")
    got = G.node_embedding(links, dimension=8).collect()
    assert len(got) == 60 and len({tuple(r.embedding) for r in got}) == 2 and max(rows) <= 2
