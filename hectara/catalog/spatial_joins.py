"""JOIN-01..JOIN-15: spatial joins."""
import math

from pyspark.sql import functions as F

from hectara.catalog.registry import query
from hectara.functions import constants as C
from hectara.functions import geometry as G
from hectara.functions import labels as L
from hectara.operators import edges as E
from hectara.operators import spatial as S
from hectara.operators import zoning as Z
from hectara.plans.flagship import service_distances

D2 = "(a.centroid_x-b.x)*(a.centroid_x-b.x)+(a.centroid_y-b.y)*(a.centroid_y-b.y)"
IN_ZONE = "p.centroid_x >= z.x0 AND p.centroid_x < z.x1 AND p.centroid_y >= z.y0 AND p.centroid_y < z.y1"
BOX = ("x0", "y0", "x1", "y1")


def spots(t):
    return t("parcels").select("id_dzialki", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))


@query(
    "join_01_zone_of_parcel",
    f"""WITH m AS (SELECT p.id_dzialki, min(z.zone_id) AS zone_id FROM parcels p JOIN zones z ON {IN_ZONE} GROUP BY 1)
        SELECT p.id_dzialki, z.zone_id AS pog_id, z.oznaczenie AS pog_oznaczenie, z.symbol AS pog_symbol, z.nazwa AS pog_nazwa,
          z.profil_podstawowy AS pog_profil_podstawowy, z.profil_podstawowy_nazwy AS pog_profil_podstawowy_nazwy, z.profil_dodatkowy AS pog_profil_dodatkowy,
          z.maks_intensywnosc AS pog_maks_intensywnosc, z.maks_zabudowa_pct AS pog_maks_zabudowa_pct, z.maks_wysokosc_m AS pog_maks_wysokosc_m, z.min_bio_pct AS pog_min_bio_pct
        FROM parcels p LEFT JOIN m ON p.id_dzialki = m.id_dzialki LEFT JOIN zones z ON m.zone_id = z.zone_id""",
)
def zone_of_parcel(t):
    return Z.attach_zone(t("parcels").select("id_dzialki", "centroid_x", "centroid_y"), "id_dzialki", t("zones"), BOX)


@query("join_01_fine_outlines", f"SELECT p.id_dzialki, min(z.zone_id) AS zone_id FROM parcels p JOIN zones z ON {IN_ZONE} GROUP BY 1")
def fine_outlines(t):
    """The zones again, with 240 vertices on each outline, so that they are tessellated."""
    steps = F.sequence(F.lit(0), F.lit(59))

    def walk(x, y):
        return F.transform(steps, lambda i: G.vertex(x(i / 60), y(i / 60)))

    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    start = F.array(G.vertex(x0, y0))
    sides = [
        walk(lambda f: x0 + (x1 - x0) * f, lambda f: y0), walk(lambda f: x1, lambda f: y0 + (y1 - y0) * f),
        walk(lambda f: x1 - (x1 - x0) * f, lambda f: y1), walk(lambda f: x0, lambda f: y1 - (y1 - y0) * f),
    ]
    zones = t("zones").withColumn("rings", F.array(F.concat(*sides, start)))
    return Z.first_zone(t("parcels").select("id_dzialki", "centroid_x", "centroid_y"), "id_dzialki", zones, "zone_id", BOX)


@query(
    "join_02_district_or_nearest",
    f"""WITH m AS (SELECT p.id_dzialki, min(z.zone_id) AS zone_id FROM parcels p JOIN zones z ON {IN_ZONE} GROUP BY 1),
        r AS (SELECT p.* FROM parcels p WHERE p.id_dzialki NOT IN (SELECT id_dzialki FROM m)),
        n AS (SELECT r.id_dzialki, z.zone_id, row_number() OVER (PARTITION BY r.id_dzialki ORDER BY
               sqrt(((z.x0+z.x1)/2-r.centroid_x)*((z.x0+z.x1)/2-r.centroid_x)+((z.y0+z.y1)/2-r.centroid_y)*((z.y0+z.y1)/2-r.centroid_y)), z.zone_id) AS rn FROM r CROSS JOIN zones z)
        SELECT id_dzialki, zone_id, 'within' AS how FROM m UNION ALL SELECT id_dzialki, zone_id, 'nearest' FROM n WHERE rn = 1""",
)
def district_or_nearest(t):
    return Z.district_or_nearest(t("parcels").select("id_dzialki", "centroid_x", "centroid_y"), "id_dzialki", t("zones"), "zone_id", BOX)


@query(
    "join_03_largest_overlap",
    """WITH o AS (SELECT p.plot_id, z.zone_id, (least(p.x1,z.x1)-greatest(p.x0,z.x0))*(least(p.y1,z.y1)-greatest(p.y0,z.y0)) AS a
         FROM plots p JOIN zones z ON p.gmina = z.gmina AND p.x0 < z.x1 AND z.x0 < p.x1 AND p.y0 < z.y1 AND z.y0 < p.y1),
       b AS (SELECT *, row_number() OVER (PARTITION BY plot_id ORDER BY a DESC, zone_id) AS rn FROM o),
       c AS (SELECT DISTINCT gmina FROM zones)
       SELECT p.plot_id, CASE WHEN c.gmina IS NULL THEN p.gmina ELSE coalesce('Z' || b.zone_id, concat(p.gmina, ' (inne)')) END AS dzielnica,
         round(coalesce(b.a, 0), 3) AS overlap
       FROM plots p LEFT JOIN b ON p.plot_id = b.plot_id AND b.rn = 1 LEFT JOIN c ON p.gmina = c.gmina""",
)
def largest_overlap(t):
    return Z.district_by_overlap(t("plots"), t("zones"))


BUILT = """SELECT plot_id, count(*) AS building_count, sum(bld_area) AS building_area_m2, max(kondygnacje) AS building_max_floors
  FROM plots p JOIN buildings b ON b.x >= p.x0 AND b.x < p.x1 AND b.y >= p.y0 AND b.y < p.y1 GROUP BY plot_id"""


@query("join_04_buildings_in_parcels", f"WITH g AS ({BUILT}) SELECT p.plot_id, coalesce(building_count, 0) AS building_count, coalesce(building_area_m2, 0) AS building_area_m2, building_max_floors FROM plots p LEFT JOIN g ON p.plot_id = g.plot_id")
def buildings_in_parcels(t):
    hits = S.points_in_polygons(t("buildings").select("x", "y", "bld_area", "kondygnacje"), "x", "y", t("plots").select("plot_id", "rings", *BOX), BOX)
    per = hits.groupBy("plot_id").agg(F.count(F.lit(1)).alias("building_count"), F.sum("bld_area").alias("building_area_m2"), F.max("kondygnacje").alias("building_max_floors"))
    return t("plots").select("plot_id").join(per, "plot_id", "left").na.fill(0, ["building_count"]).na.fill(0.0, ["building_area_m2"])


CATS = ["school", "bus_stop", "pharmacy", "doctors", "shop", "restaurant", "forest", "water", "industrial", "main_road", "kindergarten"]


@query(
    "join_05_nearest_per_category",
    f"""SELECT a.id_dzialki, {", ".join(f"CAST(round_even(sqrt(min(CASE WHEN b.type='{c}' THEN {D2} END)),0) AS INT) AS dist_{c}" for c in CATS)}
        FROM parcels a CROSS JOIN poi b GROUP BY a.id_dzialki""",
)
def nearest_per_category(t):
    parcels = t("parcels")
    found = service_distances(parcels, t("poi"), {c: f"dist_{c}" for c in CATS})
    return parcels.select("id_dzialki").join(found, "id_dzialki", "left")


@query(
    "join_06_nearest_capped",
    f"""SELECT a.id_dzialki, CAST(floor(least(coalesce(sqrt(min(CASE WHEN b.type='school' THEN {D2} END)), 1500), 1500)) AS INT) AS dist_to_school
        FROM parcels a CROSS JOIN poi b GROUP BY a.id_dzialki""",
)
def nearest_capped(t):
    near = S.nearest(spots(t), "id_dzialki", t("poi"), "poi_id", ["school"], "type", max_distance=1500.0)
    d = F.coalesce("distance", F.lit(1500.0)).cast("int")
    return spots(t).select("id_dzialki").join(near, "id_dzialki", "left").select("id_dzialki", d.alias("dist_to_school"))


WATERS = ["morze", "rzeka", "jezioro", "staw"]
WKIND = "CASE poi_id % 4 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WATERS)) + " END"


@query(
    "join_07_nearest_water_types",
    f"""WITH w AS (SELECT x, y, {WKIND} AS k FROM poi),
        d AS (SELECT a.id_dzialki, {", ".join(f"CAST(round_even(CASE WHEN min(CASE WHEN k='{w}' THEN {D2} END) > 2500000000 THEN 50000 ELSE sqrt(min(CASE WHEN k='{w}' THEN {D2} END)) END, 0) AS INT) AS d_{w}" for w in C.WATER_ORDER)}
        FROM parcels a CROSS JOIN w b GROUP BY a.id_dzialki)
        SELECT id_dzialki, d_morze AS dist_to_sea, d_rzeka AS dist_to_river, d_jezioro AS dist_to_lake, d_kanal AS dist_to_canal, d_staw AS dist_to_pond,
        least(d_morze,d_rzeka,d_jezioro,d_kanal,d_staw) AS dist_to_water,
        CASE least(d_morze,d_rzeka,d_jezioro,d_kanal,d_staw) WHEN d_morze THEN 'morze' WHEN d_rzeka THEN 'rzeka' WHEN d_jezioro THEN 'jezioro' WHEN d_kanal THEN 'kanal' WHEN d_staw THEN 'staw' END AS nearest_water_type FROM d""",
)
def nearest_water_types(t):
    kind = F.element_at(F.array(*[F.lit(w) for w in WATERS]), (F.col("poi_id") % 4 + 1).cast("int"))
    near = S.nearest(spots(t), "id_dzialki", t("poi").withColumn("kind", kind), "poi_id", C.WATER_ORDER, "kind")
    wide = near.groupBy("id_dzialki").pivot("cat", C.WATER_ORDER).agg(F.min("distance"))
    cols = {w: C.WATER_DISTANCE_COLUMNS[w] for w in C.WATER_ORDER}
    wide = spots(t).select("id_dzialki").join(wide, "id_dzialki", "left").select(
        "id_dzialki", *[F.rint(F.least(F.col(w), F.when(F.col(w).isNotNull(), F.lit(50000.0)))).cast("int").alias(c) for w, c in cols.items()]
    )
    d, kind = L.nearest_water({w: F.col(c) for w, c in cols.items()})
    return wide.select("*", d.alias("dist_to_water"), kind.alias("nearest_water_type"))


@query(
    "join_08_near_relations",
    "WITH r AS (SELECT a.id_dzialki AS src, b.poi_id AS dst, b.type, sqrt(" + D2 + """) AS d FROM parcels a CROSS JOIN poi b),
       k AS (SELECT *, row_number() OVER (PARTITION BY src, type ORDER BY d, dst) AS rn FROM r WHERE """
    + " OR ".join(f"(type = '{c}' AND d < {m})" for c, (_, m, _) in C.NEAR_RELATIONS.items())
    + ") SELECT src, dst, CASE type "
    + " ".join(f"WHEN '{c}' THEN '{r}'" for c, (r, _, _) in C.NEAR_RELATIONS.items())
    + " END AS rel, round_even(d, 1) AS distance_m FROM k WHERE "
    + " OR ".join(f"(type = '{c}' AND rn <= {n})" for c, (_, _, n) in C.NEAR_RELATIONS.items()),
)
def near_relations(t):
    return Z.near_edges(spots(t), "id_dzialki", t("poi"))


def _corner(a, b, r):
    u = f"sqrt(greatest({r}*{r}-({b})*({b}),0))"

    def f(v):
        return f"((({v})*sqrt(greatest({r}*{r}-({v})*({v}),0))+{r}*{r}*asin(greatest(least(({v})/{r},1),-1)))/2)"

    def seg(h):
        return f"(2*({f(r)}-{f(h)}))"

    return (
        f"(CASE WHEN ({a}) >= {r} OR ({b}) >= {r} THEN 0 WHEN ({a}) <= -{r} AND ({b}) <= -{r} THEN pi()*{r}*{r} WHEN ({a}) <= -{r} THEN {seg(b)} WHEN ({b}) <= -{r} THEN {seg(a)} "
        f"WHEN ({a})*({a})+({b})*({b}) <= {r}*{r} THEN {f(u)}-{f(a)}-({b})*({u}-({a})) + CASE WHEN ({b}) < 0 THEN 2*({f(r)}-{f(u)}) ELSE 0 END "
        f"WHEN ({a}) >= 0 AND ({b}) >= 0 THEN 0 WHEN ({a}) < 0 AND ({b}) >= 0 THEN {seg(b)} WHEN ({a}) >= 0 THEN {seg(a)} ELSE pi()*{r}*{r}-(pi()*{r}*{r}-{seg(a)})-(pi()*{r}*{r}-{seg(b)}) END)"
    )


R = "500e0"
COVER = f"({_corner('u0','v0',R)}-{_corner('u1','v0',R)}-{_corner('u0','v1',R)}+{_corner('u1','v1',R)})"


@query(
    "join_09_coverage_percent",
    f"""WITH k AS (SELECT p.id_dzialki, z.x0-p.centroid_x AS u0, z.x1-p.centroid_x AS u1, z.y0-p.centroid_y AS v0, z.y1-p.centroid_y AS v1 FROM parcels p JOIN zones z
          ON z.x0 <= p.centroid_x+500 AND z.x1 >= p.centroid_x-500 AND z.y0 <= p.centroid_y+500 AND z.y1 >= p.centroid_y-500),
        s AS (SELECT id_dzialki, sum({COVER})/(pi()*250000)*100 AS pct FROM k GROUP BY id_dzialki)
        SELECT p.id_dzialki, round(coalesce(s.pct, 0), 4) AS pct_500m FROM parcels p LEFT JOIN s ON p.id_dzialki = s.id_dzialki""",
)
def coverage(t):
    return S.coverage_percent(spots(t), "id_dzialki", t("zones"), 500.0).select("id_dzialki", F.round("pct", 4).alias("pct_500m"))


@query(
    "join_09_union_coverage",
    f"""WITH k AS (SELECT p.id_dzialki, z.x0-p.centroid_x AS a0, z.x1-p.centroid_x AS a1, z.y0-p.centroid_y AS b0, z.y1-p.centroid_y AS b1 FROM parcels p JOIN zones z
          ON z.x0 <= p.centroid_x+500 AND z.x1 >= p.centroid_x-500 AND z.y0 <= p.centroid_y+500 AND z.y1 >= p.centroid_y-500),
        e AS (SELECT id_dzialki, a0 AS u0 FROM k UNION SELECT id_dzialki, a1 FROM k),
        s AS (SELECT * FROM (SELECT id_dzialki, u0, lead(u0) OVER (PARTITION BY id_dzialki ORDER BY u0) AS u1 FROM e) WHERE u1 IS NOT NULL),
        i AS (SELECT s.id_dzialki, u0, u1, b0, b1, max(b1) OVER (PARTITION BY s.id_dzialki, u0 ORDER BY b0, b1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM s JOIN k ON s.id_dzialki = k.id_dzialki AND a0 <= u0 AND a1 >= u1),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR b0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id_dzialki, u0 ORDER BY b0, b1 ROWS UNBOUNDED PRECEDING) AS part FROM i),
        m AS (SELECT id_dzialki, u0, u1, min(b0) AS v0, max(b1) AS v1 FROM g GROUP BY id_dzialki, u0, u1, part),
        a AS (SELECT id_dzialki, sum({COVER})/(pi()*250000)*100 AS pct FROM m GROUP BY id_dzialki)
        SELECT p.id_dzialki, abs(round(coalesce(a.pct, 0), 4)) AS pct_500m FROM parcels p LEFT JOIN a ON p.id_dzialki = a.id_dzialki""",
)
def union_coverage(t):
    """Zones overlap; what several of them cover counts once."""
    covered = E.union_coverage_percent(spots(t), "id_dzialki", t("zones"), "zone_id", 500.0)
    return covered.select("id_dzialki", F.abs(F.round("pct", 4)).alias("pct_500m"))


@query(
    "join_10_counts_within_radius",
    f"""WITH c AS (SELECT a.id_dzialki, sum(CASE WHEN {D2} <= 250000 THEN 1 ELSE 0 END) AS at_most, sum(CASE WHEN {D2} < 250000 THEN 1 ELSE 0 END) AS below FROM parcels a CROSS JOIN buildings b GROUP BY 1),
        q AS (SELECT a.id_dzialki, count(*) AS n FROM parcels a JOIN zones z ON pow(greatest(z.x0-a.centroid_x, a.centroid_x-z.x1, 0),2)+pow(greatest(z.y0-a.centroid_y, a.centroid_y-z.y1, 0),2) <= 250000 GROUP BY 1)
        SELECT c.id_dzialki, CAST(at_most AS BIGINT) AS at_most, CAST(below AS BIGINT) AS below, coalesce(q.n, 0) AS touching FROM c LEFT JOIN q ON c.id_dzialki = q.id_dzialki""",
)
def counts_within_radius(t):
    s = spots(t)
    counts = S.counts_in_discs(s, "id_dzialki", t("buildings"), 500.0).withColumnsRenamed({"n": "at_most", "n_strict": "below"})
    touching = S.count_touching(s, "id_dzialki", t("zones"), 500.0).withColumnRenamed("n", "touching")
    return touching.join(counts, "id_dzialki", "left").na.fill(0)


PAIR2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"


@query(
    "join_11_distance_dedup",
    f"""SELECT poi_id, source FROM poi WHERE source = 'bdot10k' OR subtype IS NOT NULL
        UNION ALL SELECT b.poi_id, b.source FROM poi b WHERE b.source = 'osm' AND b.subtype IS NULL
          AND NOT EXISTS (SELECT 1 FROM poi a WHERE a.source = 'bdot10k' AND {PAIR2} < 360000)""",
)
def distance_dedup(t):
    return Z.merge_sources(t("poi"), 600.0).select("poi_id", "source")


@query(
    "join_12_backfill",
    f"""WITH m AS (SELECT a.poi_id AS pid, b.poi_id AS sid, row_number() OVER (PARTITION BY a.poi_id ORDER BY b.poi_id) AS rn FROM poi a JOIN poi b
          ON a.source='bdot10k' AND b.source='osm' AND {PAIR2} < 1000000)
        SELECT a.poi_id, coalesce(a.name, b.name) AS name, coalesce(a.network, b.network) AS network FROM poi a LEFT JOIN m ON a.poi_id = m.pid AND m.rn = 1 LEFT JOIN poi b ON m.sid = b.poi_id WHERE a.source = 'bdot10k'""",
)
def backfill(t):
    return Z.backfill_from_secondary(t("poi"), 1000.0, ["name", "network"])


@query(
    "join_13_adjacency",
    """WITH a AS (SELECT p.plot_id AS id1, q.plot_id AS id2, least(p.x1,q.x1)-greatest(p.x0,q.x0) AS w, least(p.y1,q.y1)-greatest(p.y0,q.y0) AS h
         FROM bricks p JOIN bricks q ON p.plot_id < q.plot_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1)
       SELECT id1, id2, round_even(greatest(w, h), 2) AS shared_border_m FROM a WHERE (w = 0 OR h = 0) AND greatest(w, h) > 0.1""",
)
def adjacency(t):
    return E.adjacent_pairs(t("bricks"), "plot_id")


@query(
    "join_13_bent_adjacency",
    """WITH a AS (SELECT p.plot_id AS id1, q.plot_id AS id2, least(p.x1,q.x1)-greatest(p.x0,q.x0) AS w, least(p.y1,q.y1)-greatest(p.y0,q.y0) AS h
         FROM bricks p JOIN bricks q ON p.plot_id < q.plot_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1)
       SELECT id1, id2, round_even(greatest(w, h), 2) AS shared_border_m FROM a WHERE (w = 0 OR h = 0) AND greatest(w, h) > 0.1""",
)
def bent_adjacency(t):
    """The brick wall turned by 30 degrees, the left border of every brick bent by a vertex 0.1 mm out of line; borders keep their lengths."""
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)

    def turned(x, y):
        return G.vertex(500000 + c * x - s * y, 300000 + s * x + c * y)

    x0, y0, x1, y1 = (F.col(v) for v in BOX)
    bent = F.array(turned(x0, y0), turned(x1, y0), turned(x1, y1), turned(x0, y1), turned(x0 + F.when(F.col("plot_id") % 2 == 0, 1e-4).otherwise(-1e-4), (y0 + y1) / 2), turned(x0, y0))
    return E.adjacent_pairs(t("bricks").withColumn("rings", F.array(bent)), "plot_id")


@query(
    "join_14_radius_search",
    """WITH d AS (SELECT plot_id, sqrt(pow(greatest(x0-5000, 5000-x1, 0),2)+pow(greatest(y0-5000, 5000-y1, 0),2)) AS d FROM plots)
       SELECT plot_id, round(d, 3) AS distance_m FROM d WHERE d <= 1200 ORDER BY d, plot_id LIMIT 50""",
)
def radius_search(t):
    return Z.radius_search(t("plots"), "plot_id", BOX, 5000.0, 5000.0, 1200.0).orderBy("distance_m", "plot_id").limit(50).select("plot_id", F.round("distance_m", 3).alias("distance_m"))


@query(
    "join_15_window_search",
    "SELECT plot_id FROM plots WHERE x1 >= 3000 AND x0 <= 4500 AND y1 >= 2000 AND y0 <= 5000 ORDER BY plot_id LIMIT 100",
)
def window_search(t):
    return Z.window_search(t("plots"), BOX, 3000.0, 2000.0, 4500.0, 5000.0).select("plot_id").orderBy("plot_id").limit(100)
