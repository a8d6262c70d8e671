"""GEO: geometry scalar functions."""
from pyspark.sql import functions as F

from hectara.catalog.registry import query
from hectara.functions import geometry as G
from hectara.operators.edges import with_faults
from hectara.operators.spatial import spread, within_radius
from hectara.operators.terrain import surface_statistics

RINGS = "rings"

@query(
    "geo_01_area",
    "SELECT shape_id, CAST(round_even((x1-x0)*(y1-y0), 0) AS INT) AS area_m2, round((x1-x0)*(y1-y0), 4) AS true_area FROM shapes",
)
def area(t):
    return t("shapes").select("shape_id", F.rint(G.area(F.col(RINGS))).cast("int").alias("area_m2"), F.round(G.area(F.col(RINGS)), 4).alias("true_area"))


@query("geo_02_centroid", "SELECT shape_id, round((x0+x1)/2, 4) AS cx, round((y0+y1)/2, 4) AS cy FROM shapes")
def centroid(t):
    c = G.centroid(F.col(RINGS))
    return t("shapes").withColumn("c", c).select("shape_id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query(
    "geo_03_shape_index",
    """SELECT shape_id, 2*((x1-x0)+(y1-y0)) AS perimeter,
       round(least(greatest(4*pi()*round_even((x1-x0)*(y1-y0),0) / pow(2*((x1-x0)+(y1-y0)),2), 0), 1), 6) AS shape_index FROM shapes""",
)
def shape_index(t):
    return t("shapes").select("shape_id", F.rint(G.area(F.col(RINGS))).alias("a"), G.perimeter(F.col(RINGS)).alias("perimeter")).select(
        "shape_id", "perimeter", F.round(G.compactness(F.col("a"), F.col("perimeter")), 6).alias("shape_index")
    )


@query("geo_04_envelope", "SELECT shape_id, x1-x0 AS bbox_width, y1-y0 AS bbox_height FROM shapes")
def envelope(t):
    box = G.envelope(F.col(RINGS))
    return t("shapes").select("shape_id", (box["maxx"] - box["minx"]).alias("bbox_width"), (box["maxy"] - box["miny"]).alias("bbox_height"))


@query(
    "geo_05_aspect_ratio",
    """SELECT id_dzialki, CASE WHEN least(bbox_width, bbox_height) > 0
       THEN round(greatest(bbox_width, bbox_height) / least(bbox_width, bbox_height), 6) END AS ratio FROM parcels""",
)
def aspect_ratio(t):
    return t("parcels").select("id_dzialki", F.round(G.aspect_ratio(F.col("bbox_width"), F.col("bbox_height")), 6).alias("ratio"))


@query(
    "geo_06_grid_round_trip",
    "SELECT id_dzialki, round(centroid_lat, 7) AS lat, round(centroid_lon, 7) AS lon, round(centroid_lat, 7) AS lat_2177, round(centroid_lon, 7) AS lon_2177 FROM parcels",
)
def grid_round_trip(t):
    df = t("parcels").select("id_dzialki", "centroid_lat", "centroid_lon")
    out = [F.col("id_dzialki")]
    for srid, suffix in ((2180, ""), (2177, "_2177")):
        x, y = G.to_grid(F.col("centroid_lat"), F.col("centroid_lon"), srid)
        df = df.withColumn(f"x{srid}", x).withColumn(f"y{srid}", y)
        lat, lon = G.from_grid(F.col(f"x{srid}"), F.col(f"y{srid}"), srid)
        out += [F.round(lat, 7).alias("lat" + suffix), F.round(lon, 7).alias("lon" + suffix)]
    return df.select(*out)


@query(
    "geo_07_linear_projection",
    """SELECT id_dzialki, round((centroid_lon-19e0)*111320*cos(radians(centroid_lat))+500000, 3) AS x, round((centroid_lat-52e0)*111320+312000, 3) AS y FROM parcels""",
)
def linear_projection(t):
    x, y = G.to_grid_linear(F.col("centroid_lat"), F.col("centroid_lon"))
    return t("parcels").select("id_dzialki", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(
    "geo_08_as_point",
    """SELECT shape_id, CASE shape_id % 3 WHEN 0 THEN (x0+x1)/2 ELSE x0 END AS px, CASE shape_id % 3 WHEN 0 THEN (y0+y1)/2 ELSE y0 END AS py FROM shapes""",
)
def as_point(t):
    kind = F.element_at(F.array(F.lit("Polygon"), F.lit("LineString"), F.lit("Point")), (F.col("shape_id") % 3 + 1).cast("int"))
    p = t("shapes").withColumn("p", G.as_point(kind, F.col(RINGS)))
    return p.select("shape_id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query(
    "geo_09_sample_points",
    """WITH n AS (SELECT shape_id, x0, y0, x1-x0 AS w, y1-y0 AS h, greatest(1, CAST(floor(2*((x1-x0)+(y1-y0))/50) AS INT)) AS n FROM shapes),
       s AS (SELECT *, unnest(range(n)) AS i FROM n), d AS (SELECT *, i*2*(w+h)/n AS d FROM s)
       SELECT shape_id, round(x0+w/2, 4) AS px, round(y0+h/2, 4) AS py FROM n
       UNION ALL SELECT shape_id,
         round(CASE WHEN d <= w THEN x0+d WHEN d <= w+h THEN x0+w WHEN d <= 2*w+h THEN x0+w-(d-w-h) ELSE x0 END, 4),
         round(CASE WHEN d <= w THEN y0 WHEN d <= w+h THEN y0+(d-w) WHEN d <= 2*w+h THEN y0+h ELSE y0+h-(d-2*w-h) END, 4) FROM d""",
)
def sample_points(t):
    shapes = spread(t("shapes"), "shape_id")  # the table may come in one file, and every shape makes many points
    p = G.sample_points(shapes.select("shape_id", "rings", F.lit("Polygon").alias("gtype")), "gtype", "rings", 50)
    return p.select("shape_id", F.round("p.x", 4).alias("px"), F.round("p.y", 4).alias("py"))


@query(
    "geo_10_disc_region",
    """SELECT poi_id, count(*) AS n FROM poi JOIN buildings ON (poi.x-buildings.x)*(poi.x-buildings.x)+(poi.y-buildings.y)*(poi.y-buildings.y) <= 490000 GROUP BY poi_id""",
)
def disc_region(t):
    """A circular region is a distance test, never a drawn polygon."""
    return within_radius(t("poi"), "poi_id", t("buildings"), 700.0)


# What each of twelve kinds of derived rings has wrong, as text for both engines.
RING_FAULTS = [None, "crossing", "open ring", "few vertices", None, "hole outside", "crossing", "touch", "crossing", "hole in hole", None, "split inside"]
FAULT_SQL = "CASE shape_id % 12 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(RING_FAULTS) if f) + " END"


def faulty_shapes(t):
    """Every shape with rings of the kind that its number names: sound, crossed, open, spiked, self-touching, with holes out of place."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2

    def ring(*points):
        return F.array(*[G.vertex(x, y) for x, y in (*points, points[0])])

    def box(a, b, c, d):
        return ring((a, b), (c, b), (c, d), (a, d))

    whole = box(x0, y0, x1, y1)
    kinds = [
        [whole],
        [ring((x0, y0), (x1, y1), (x1, y0), (x0, y1 + 2))],
        [F.slice(whole, 1, 4)],
        [ring((x0, y0), (x1, y0), (x1, y0))],
        [whole, box(x0 + 2, y0 + 2, x0 + 5, y0 + 5)],
        [whole, box(x1 + 5, y1 + 5, x1 + 7, y1 + 7)],
        [ring((x0, y0), (x1, y0), (x1, ym), (x1 + 4, ym), (x1, ym), (x1, y1), (x0, y1))],
        [ring((x0, y0), (x1, y0), (x1, y1), (xm, y0), (x0, y1))],
        [whole, box(x1 - 2, y0 + 2, x1 + 2, y0 + 5)],
        [whole, box(x0 + 1, y0 + 1, x0 + 7, y0 + 7), box(x0 + 2, y0 + 2, x0 + 4, y0 + 4)],
        [whole, ring((x0, ym), (x0 + 3, ym - 1), (x0 + 3, ym + 1))],
        [whole, ring((x0, ym), (xm, ym - 1), (x1, ym), (xm, ym + 1))],
    ]
    rings = F.array(*[F.array(*k) for k in kinds])
    return t("shapes").withColumn(RINGS, F.get(rings, (F.col("shape_id") % 12).cast("int")))


@query("geo_11_validity", f"SELECT shape_id, {FAULT_SQL} IS NULL AS valid, {FAULT_SQL} AS fault FROM shapes")
def validity(t):
    return with_faults(faulty_shapes(t)).select("shape_id", "valid", "fault")


@query(
    "geo_12_grid_tiles",
    """WITH b AS (SELECT shape_id, unnest(range(CAST(floor((x0*40+200000-140000)/1000) AS BIGINT), CAST(floor((x1*40+200000-140000)/1000) AS BIGINT)+1)) AS gx,
                CAST(floor((y0*40+300000-120000)/1000) AS BIGINT) AS gy0, CAST(floor((y1*40+300000-120000)/1000) AS BIGINT) AS gy1 FROM shapes),
       c AS (SELECT shape_id, gx, unnest(range(gy0, gy1+1)) AS gy FROM b)
       SELECT shape_id, format('tile_{:04d}_{:04d}', gx, gy) AS tile FROM c""",
)
def grid_tiles(t):
    x0, y0, x1, y1 = F.col("x0") * 40 + 200000, F.col("y0") * 40 + 300000, F.col("x1") * 40 + 200000, F.col("y1") * 40 + 300000
    return t("shapes").select("shape_id", F.explode(G.tiles_of_box(x0, y0, x1, y1)).alias("tile"))


@query(
    "geo_13_location_centre",
    """SELECT gmina, round(avg(centroid_lat),6) AS lat, round(avg(centroid_lon),6) AS lon, count(*) AS parcels, 3000 AS radius_m FROM parcels
       WHERE dzielnica = 'MACHINERY' OR dzielnica LIKE 'MACHINERY %' GROUP BY gmina""",
)
def location_centre(t):
    from hectara.operators.search import in_district, location_centres

    return location_centres(t("parcels").filter(in_district(F.col("dzielnica"), "MACHINERY")), ["gmina"], district=True)


@query(
    "geo_14_terrain",
    """WITH p AS (SELECT p_partkey // 50 AS surface, p_partkey % 50 AS seq, CAST(p_size AS DOUBLE) + p_partkey % 7 AS x, CAST(p_partkey % 50 AS DOUBLE) AS y, (p_partkey * 37 % 101) / 1e1 AS z FROM part),
       d AS (SELECT a.surface, abs(degrees(atan((b.z-a.z)/sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))))) AS slope FROM p a JOIN p b ON a.surface=b.surface AND b.seq=a.seq+1
             WHERE (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) > 0),
       s AS (SELECT surface, avg(slope) AS sa, max(slope) AS sm FROM d GROUP BY surface),
       e AS (SELECT surface, min(z) AS min_z, max(z) AS max_z, round(avg(z),4) AS avg_z, arg_max(z, seq)-arg_min(z, seq) AS dz, count(*) AS n FROM p GROUP BY surface)
       SELECT e.surface, min_z, max_z, avg_z, round(sa,4) AS slope_avg_deg, round(sm,4) AS slope_max_deg,
         CASE WHEN n > 1 AND abs(dz) > 0.5 THEN CASE WHEN dz > 0 THEN 'N' ELSE 'S' END ELSE 'flat' END AS aspect,
         sa < 15 AS flat_enough, sa < 2 AS drainage_concern, sa > 5 AS view_potential,
         CASE WHEN sa < 5 THEN 'minimal' WHEN sa < 15 THEN 'moderate' ELSE 'significant' END AS earthwork
       FROM e JOIN s ON e.surface = s.surface""",
)
def terrain(t):
    k = F.col("p_partkey")
    points = t.raw("part").select(
        F.floor(k / 50).alias("surface"), (k % 50).alias("seq"), (F.col("p_size").cast("double") + k % 7).alias("x"),
        (k % 50).cast("double").alias("y"), (k * 37 % 101 / 10).alias("z"),
    )
    return surface_statistics(points)
