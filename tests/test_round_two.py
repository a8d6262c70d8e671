"""Searches without a city, polygon pairs of very different sizes, filters before cuts, upserts as writes."""
import random

import pytest
from pyspark.sql import functions as F

from hectara import session
from hectara.catalog.registry import Tables
from hectara.operators import search as S
from hectara.operators import similarity as V
from hectara.operators import spatial
from hectara.operators.statistics import diagnose
from hectara.sources import writers as W

SF = "/root/testdata/sf0.001"


def test_searches_without_a_city(spark):
    t = Tables(spark, SF)
    parcels, asked = t("parcels"), S.split_lists(t("searches"))
    free = asked.filter("gmina is null").withColumn("miejscowosc", F.lit(None).cast("string"))
    n = free.count()
    assert n > 0
    many = S.scored_search_many(parcels, free, 5)
    assert many.groupBy("search_id").count().filter("count = 5").count() == n
    assert diagnose(parcels, free).filter(F.col("total") == parcels.count()).count() == n


def boxes(spark, rows, side):
    names = [side + c for c in ("minx", "miny", "maxx", "maxy")]
    return spark.createDataFrame(rows, f"{side}id long, " + ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("limit", [spatial.BROADCAST_SHAPES, 0])
def test_envelope_pairs_stay_near_linear(spark, monkeypatch, limit):
    monkeypatch.setattr(spatial, "BROADCAST_SHAPES", limit)
    rng = random.Random(2)

    def make(n, big):
        rows = [(i, x, y, x + rng.uniform(1, 9), y + rng.uniform(1, 9)) for i in range(n) for x, y in [(rng.uniform(0, 5000), rng.uniform(0, 5000))]]
        return rows + [(n + k, 0.0, 0.0, 5000.0 - k, 5000.0) for k in range(big)]

    a, b = make(700, 1), make(700, 2)
    pairs = spatial.envelope_pairs(boxes(spark, a, "a"), boxes(spark, b, "b"))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert sorted(map(tuple, pairs.select("aid", "bid").collect())) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.split("\n")) == 2


def test_filter_comes_before_the_cut(spark):
    df = spark.createDataFrame([(i, [1.0, i / 100], i % 10 == 0) for i in range(100)], "id long, v array<double>, good boolean")
    got = [r.id for r in V.most_similar(df, "id", "v", [1.0, 0.0], 5, 6, exclude=0, condition=F.col("good")).collect()]
    assert got == [10, 20, 30, 40, 50, 60]


def test_upsert_takes_the_last_row_of_a_key(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, n int")
    updates = spark.createDataFrame([(1, "old", 1), (1, "new", 5), (1, "mid", 3), (3, "c", 1), (None, "lost", 9)], "k long, x string, at int")
    assert sorted(map(tuple, W.upsert(base, updates, "k", ["at"]).collect())) == [(1, "new", 1), (2, "b", 2), (3, "c", None)]


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    W.load_table(spark.createDataFrame([(i, f"p{i % 3}", i) for i in range(30)], "k long, part string, v long"), path, "part")
    before = {f.name for f in (tmp_path / "t/part=p2").iterdir()}
    W.upsert_table(spark, path, spark.createDataFrame([(0, 100), (3, 103), (0, 50)], "k long, v long"), "k", "part", ["v"])
    W.upsert_table(spark, path, spark.createDataFrame([(99, "p9", 9)], "k long, part string, v long"), "k", "part")
    got = {r.k: (r.part, r.v) for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 and got[0] == ("p0", 100) and got[3] == ("p0", 103) and got[99] == ("p9", 9) and got[4] == ("p1", 4)
    assert {f.name for f in (tmp_path / "t/part=p2").iterdir()} == before


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

        getConf = get

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://elsewhere:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Fake())


def test_semantic_list_ranks_all_parcels_in_slices(spark):
    """Every search meets every parcel; ties go to the smaller id, rows without a direction are not found."""
    from hectara.operators import ranking

    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [-1.0, 0.0])], "id_dzialki string, vector array<double>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 5.0]), (3, None)], "search_id int, vector array<double>")
    got = [tuple(r) for r in ranking.semantic_list(vectors, asked, 3).orderBy("search_id", "rank").select("search_id", "rank", "id_dzialki", "similarity").collect()]
    assert got == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "c", 0.0), (2, 1, "c", 1.0), (2, 2, "a", 0.0), (2, 3, "b", 0.0)]
    assert ranking.semantic_list(vectors, asked.limit(0), 3).count() == 0
