"""Aggregations over parcels, edges, zones and logs. All are hash aggregates with partial sums before the shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.functions.scores import half_even
from hectara.operators.search import in_district
from hectara.session import cut_lineage, sized_broadcast


def share(test: Column) -> Column:
    """Percent of rows where the test holds; unknown counts as not."""
    return F.avg(F.when(test, 1.0).otherwise(0.0)) * 100


def count() -> Column:
    return F.count(F.lit(1))


def city_statistics(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("gmina").agg(
        count().alias("parcels"), F.round(F.avg("area_m2"), 4).alias("avg_area"), F.round(share(F.col("has_pog")), 4).alias("pct_pog"),
        F.countDistinct("dzielnica").alias("districts"), F.round(F.avg("quietness_score"), 4).alias("avg_quietness"),
        F.round(F.avg("nature_score"), 4).alias("avg_nature"), F.round(share(F.col("is_residential_zone")), 4).alias("pct_buildable"),
    )


def symbol_statistics(zones: DataFrame) -> DataFrame:
    residential = F.arrays_overlap(F.split("profil_podstawowy", "[|]"), F.array(F.lit("MN"), F.lit("MW")))
    inner = zones.groupBy("symbol", "nazwa").agg(F.bool_or(F.coalesce(residential, F.lit(False))).alias("r"), count().alias("n"))
    return inner.groupBy("symbol").agg(F.min("nazwa").alias("nazwa"), F.bool_or("r").alias("is_residential"), F.sum("n").alias("n"))


def children_with_counts(parents: DataFrame, key: str, parcels: DataFrame, child: str) -> DataFrame:
    """Counts per key including keys nobody refers to."""
    counts = parcels.groupBy(F.col(child).alias(key)).agg(count().alias("n"))
    return parents.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def administrative_tree(parcels: DataFrame) -> DataFrame:
    """Rollup over the levels; null marks a subtotal, level tells which."""
    return parcels.filter(F.col("dzielnica").isNotNull()).rollup("wojewodztwo", "gmina", "dzielnica").agg(
        count().alias("n"), F.grouping_id().alias("level")
    )


def tree_children(parcels: DataFrame) -> DataFrame:
    pairs = parcels.filter(F.col("dzielnica").isNotNull()).groupBy("gmina", "dzielnica").agg(count().alias("n"))
    return pairs.groupBy("gmina").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("dzielnica", "n"))).alias("children"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(count().alias("n")).select(F.lit(name).alias("entity"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def distributions(parcels: DataFrame, dims: list[str]) -> DataFrame:
    """One pass: every category column becomes (dim, value) rows that are counted map-side."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])
    return parcels.select(F.inline(pairs)).groupBy("dim", "value").agg(count().alias("n"))


def data_summary(parcels: DataFrame) -> DataFrame:
    flags = F.array(
        F.struct(F.lit("kategoria_ciszy").alias("dim"), F.col("kategoria_ciszy").alias("value")),
        F.struct(F.lit("kategoria_natury").alias("dim"), F.col("kategoria_natury").alias("value")),
        F.struct(F.lit("gestosc_zabudowy").alias("dim"), F.col("gestosc_zabudowy").alias("value")),
        F.struct(F.lit("gmina").alias("dim"), F.col("gmina").alias("value")),
        F.struct(F.lit("total").alias("dim"), F.lit("all").alias("value")),
        F.when(F.col("has_pog"), F.struct(F.lit("total").alias("dim"), F.lit("with_pog").alias("value"))),
        F.when(F.col("is_residential_zone"), F.struct(F.lit("total").alias("dim"), F.lit("residential").alias("value"))),
    )
    return parcels.select(F.inline(F.array_compact(flags))).groupBy("dim", "value").agg(count().alias("n"))


def dominant(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key; ties to the smaller value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(count().alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("t")).select(*keys, F.col("t.v").alias(name))


def building_aggregates(hits: DataFrame, plots: DataFrame) -> DataFrame:
    """hits: building rows with plot_id; plots: plot_id, area_m2."""
    from hectara.functions.labels import building_function

    b = hits.withColumn("fn", building_function(F.col("funkcja")))
    main = b.groupBy("plot_id").agg(
        count().alias("building_count"), F.sum("bld_area").alias("building_area_m2"), F.max("kondygnacje").alias("building_max_floors"),
        F.bool_or(F.coalesce(F.col("funkcja") == "budynki mieszkalne", F.lit(False))).alias("has_residential"),
        F.bool_or(F.coalesce(F.col("funkcja") == "budynki przemysłowe", F.lit(False))).alias("has_industrial"),
        F.count_if(F.col("kategoria") == "w budowie").alias("under_construction"),
    )
    full = plots.join(main, "plot_id", "left").join(dominant(b, ["plot_id"], "fn", "building_main_function"), "plot_id", "left").join(dominant(b, ["plot_id"], "typ", "building_type"), "plot_id", "left")
    pct = F.least(F.greatest(F.try_divide("building_area_m2", "area_m2") * 100, F.lit(0.0)), F.lit(100.0))
    zero = {"building_count": 0, "building_area_m2": 0.0, "has_residential": False, "has_industrial": False, "under_construction": 0}
    return full.na.fill(zero).withColumn("building_coverage_pct", F.round(F.coalesce(pct, F.lit(0.0)), 4)).withColumn("is_built", F.col("building_count") > 0)


def area_statistics(parcels: DataFrame, gmina: str | None, dzielnica: str | None) -> DataFrame:
    """Totals of a location in one row."""
    df = parcels
    if gmina:
        df = df.filter(F.col("gmina") == gmina)
    if dzielnica:
        df = df.filter(in_district(F.col("dzielnica"), dzielnica))
    tests = {"with_pog": F.col("has_pog"), "residential": F.col("is_residential_zone"), "road_access": F.col("dist_to_main_road") < 50, "built": F.col("is_built")}
    counts = df.agg(count().alias("total"), *[F.count_if(test).alias(k) for k, test in tests.items()])
    return counts.select("*", *[F.when(F.col("total") > 0, half_even(F.col(k) * 100 / F.col("total"), 1)).alias(f"pct_{k}") for k in tests])


WATER_COUNTS = [
    ("near_sea_500", "dist_to_sea", 500), ("near_sea_1000", "dist_to_sea", 1000), ("near_lake_300", "dist_to_lake", 300), ("near_lake_500", "dist_to_lake", 500),
    ("near_river_200", "dist_to_river", 200), ("near_river_500", "dist_to_river", 500), ("near_canal_200", "dist_to_canal", 200), ("near_pond_200", "dist_to_pond", 200),
    ("near_any_300", "dist_to_water", 300), ("near_any_500", "dist_to_water", 500),
]


def water_statistics(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("gmina").agg(
        count().alias("total"), *[F.count_if(F.col(c) <= limit).alias(name) for name, c, limit in WATER_COUNTS],
        *[F.count_if(F.col("nearest_water_type") == w).alias(f"nearest_{w}") for w in ("morze", "jezioro", "rzeka", "kanal", "staw")],
    )


def top_districts(parcels: DataFrame, column: str, values: list[str], limit: int) -> DataFrame:
    hits = parcels.filter(F.col(column).isin(values) & F.col("dzielnica").isNotNull())
    return hits.groupBy("dzielnica", "gmina").agg(count().alias("n")).orderBy(F.col("n").desc(), "dzielnica", "gmina").limit(limit)


def neighbourhood_context(parcels: DataFrame) -> DataFrame:
    """Figures over the other parcels of the district: district totals minus the parcel itself.

    Totals are grouped first and joined back, so a district with a third of all rows is never
    gathered into a window.
    """
    q, a = F.col("quietness_score"), F.col("area_m2")
    totals = parcels.filter(F.col("dzielnica").isNotNull()).groupBy("dzielnica").agg(
        count().alias("n"), F.sum("area_m2").alias("sa"), F.count("area_m2").alias("na"), F.sum("quietness_score").alias("sq"), F.count("quietness_score").alias("nq"),
        F.count_if("is_built").alias("nb"), F.count_if("has_residential").alias("nr"),
    )
    j = parcels.join(sized_broadcast(totals), "dzielnica", "left")
    others = F.coalesce(F.col("n") - 1, F.lit(0))
    na, nq = F.col("na") - a.isNotNull().cast("int"), F.col("nq") - q.isNotNull().cast("int")
    return j.select(
        "id_dzialki", others.alias("parcel_count_in_district"),
        F.round(F.when(na > 0, (F.col("sa") - F.coalesce(a, F.lit(0))) / na).otherwise(0.0), 4).alias("avg_area_m2"),
        F.round(F.coalesce(F.when(nq > 0, (F.col("sq") - F.coalesce(q, F.lit(0))) / nq), q.cast("double"), F.lit(0.0)), 4).alias("avg_quietness"),
        F.round(F.when(others > 0, (F.col("nb") - F.col("is_built").cast("int")) / others).otherwise(0.0), 6).alias("pct_built"),
        F.round(F.when(others > 0, (F.col("nr") - F.col("has_residential").cast("int")) / others).otherwise(0.0), 6).alias("pct_residential"),
    )


MEDIAN_ROWS = 2_000_000
MEDIAN_BUCKETS = 4096


def exact_median(df: DataFrame, keys: list[str], column: str, name: str = "median", rows: int = MEDIAN_ROWS) -> DataFrame:
    """Exact interpolating median per key without gathering a large group.

    While a group has more than `rows` values, they are counted in equal-width buckets and only
    the buckets holding the middle ranks are kept; what is left is small enough to order.
    """
    vals = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v")).groupBy(*keys, "v").agg(count().alias("n"))
    size = vals.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("v").alias("distinct_v"))
    most = size.agg(F.max("distinct_v")).first()[0] or 0
    w = Window.partitionBy(*keys)
    if most <= rows:
        lead = vals.join(size, keys).withColumn("skip", F.lit(0).cast("bigint"))
    else:
        lead = cut_lineage(vals.join(size, keys).withColumn("skip", F.lit(0).cast("bigint")))
    while most > rows:
        span = lead.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        b = lead.join(span, keys).withColumn("bucket", F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * MEDIAN_BUCKETS), F.lit(MEDIAN_BUCKETS - 1)))
        per = b.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"), F.first("total").alias("t"), F.first("skip").alias("s"))
        before = F.col("s") + F.sum("bn").over(w.orderBy("bucket")) - F.col("bn")
        low, high = F.floor((F.col("t") - 1) / 2), F.ceil((F.col("t") - 1) / 2)
        per = per.withColumn("before", before).filter((F.col("before") <= high) & (F.col("before") + F.col("bn") > low))
        per = per.withColumn("first_before", F.min("before").over(w)).select(*keys, "bucket", "first_before")
        lead = cut_lineage(b.join(per, [*keys, "bucket"]).select(*keys, "v", "n", "total", F.col("first_before").alias("skip")))
        left = lead.groupBy(*keys).agg(count().alias("c")).agg(F.max("c")).first()[0]
        if left >= most:
            break
        most = left
    upto = F.col("skip") + F.sum("n").over(w.orderBy("v"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    mid = lead.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    hit = mid.filter((F.col("from") <= high) & (F.col("upto") > low))
    return hit.groupBy(*keys).agg(((F.min("v") + F.max("v")) / 2).alias(name))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, exact median and count of each column, one row per column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])))
    base = long.groupBy("column").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 4).alias("mean"), F.count("v").alias("n"))
    return base.join(exact_median(long, ["column"], "v"), "column", "left").withColumn("median", F.round("median", 4))


AREA_EDGES = [500, 1000, 1500, 2000, 5000, 10000]


def area_bins(parcels: DataFrame) -> DataFrame:
    """Right-closed area bins and their share of the rows that fall into a bin."""
    low, rule = 0, F
    for edge in AREA_EDGES:
        test = F.col("area_m2") <= edge
        label = f"({low},{edge}]"
        rule = rule.when(test & (F.col("area_m2") > low), label) if rule is not F else F.when(test & (F.col("area_m2") > low), label)
        low = edge
    rule = rule.when(F.col("area_m2") > low, f"({low},inf]")
    bins = parcels.select(rule.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(count().alias("n"))
    total = bins.agg(F.sum("n").alias("total"))
    return bins.join(F.broadcast(total)).select("bin", "n", F.round(F.col("n") * 100 / F.col("total"), 4).alias("pct"))


def degree_statistics(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Spread of neighbour counts, isolated nodes included."""
    ends = pairs.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(count().alias("degree"))
    d = nodes.select("id").join(ends, "id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.percentile("degree", 0.5).alias("median_degree"))


def edge_statistics(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(count().alias("n"), F.round(F.avg("distance_m"), 4).alias("avg_m"), F.min("distance_m").alias("min_m"), F.max("distance_m").alias("max_m"))


def fill_rates(df: DataFrame, columns: list[str], at_least: float = 10.0) -> DataFrame:
    """Non-null count, percent and distinct count per column, one scan; sparse columns are left out."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])))
    distinct = long.groupBy("column", "v").agg(count().alias("n"))
    r = distinct.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("filled"), F.count("v").alias("distinct_values"))
    return r.withColumn("pct", F.round(F.col("filled") * 100 / F.col("rows"), 4)).filter(F.col("pct") >= at_least).drop("rows")


def quality_report(df: DataFrame, key: str, numeric: str, columns: list[str], crs: Column, expected_crs: str, gtype: Column) -> DataFrame:
    """One row: rows, CRS match, geometry counts and ratio, type histogram, spread of a number, nulls by column, candidate ids, bounds and pass flag.

    A column without nulls or repeats is a candidate id. The report passes when the CRS is the expected one, at least 99 % of the geometries are
    valid and the key is a candidate id.
    """
    from hectara.functions import geometry as G
    from hectara.operators.edges import with_faults

    box = G.envelope(F.col("rings"))
    judged = with_faults(df.select("*", crs.alias("_crs"), gtype.alias("_type")))
    base = cut_lineage(judged.select(*dict.fromkeys([key, numeric, *columns]), "_crs", "_type", "valid", "fault", *[v.alias("e_" + k) for k, v in box.items()]))
    one = base.agg(
        count().alias("rows"), F.bool_and(F.coalesce(F.col("_crs") == expected_crs, F.lit(False))).alias("crs_valid"),
        F.count_if("valid").alias("valid"), F.count_if(~F.col("valid") & (F.col("fault") != "empty")).alias("invalid"), F.count_if(F.col("fault") == "empty").alias("empty"),
        F.min(numeric).alias("min_v"), F.max(numeric).alias("max_v"), F.round(F.avg(numeric), 4).alias("mean_v"), F.round(F.stddev(numeric), 4).alias("std_v"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns], *[F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(f"null_ratio_{c}") for c in columns],
        F.min("e_minx").alias("minx"), F.min("e_miny").alias("miny"), F.max("e_maxx").alias("maxx"), F.max("e_maxy").alias("maxy"),
    )
    types = base.groupBy("_type").agg(count().alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("_type", F.lit("null")), "n"))), "|").alias("types"))
    # Repeats by column: the largest group of equal values, counted by hash aggregation with partial counts.
    long = base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])))
    most = long.groupBy("column", "v").agg(count().alias("n")).groupBy("column").agg(F.max("n").alias("most"), F.max(F.col("v").isNull()).alias("nulls"))
    ids = most.agg(F.array_join(F.array_sort(F.collect_list(F.when((F.col("most") == 1) & ~F.col("nulls"), F.col("column")))), "|").alias("candidate_ids"))
    middle = exact_median(base.select(F.lit(1).alias("one"), numeric), ["one"], numeric, "median_v").select(F.round("median_v", 4).alias("median_v"))
    both = one.join(F.broadcast(types)).join(F.broadcast(ids)).join(F.broadcast(middle))  # one row each
    both = both.withColumn("valid_ratio", F.round(F.col("valid") / F.col("rows"), 6))
    held = F.array_contains(F.split("candidate_ids", r"\|"), key)
    return both.withColumn("passed", F.col("crs_valid") & (F.col("valid_ratio") >= 0.99) & held)


def preference_patterns(favorites: DataFrame, features: list[str]) -> DataFrame:
    """Feature values shared by at least half of a user's favourites, with confidence min(n/5, 1)."""
    total = favorites.groupBy("user_id").agg(count().alias("total_favorites"))
    long = favorites.select("user_id", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features])))
    counts = long.filter(F.col("value").isNotNull()).groupBy("user_id", "feature", "value").agg(count().alias("n"))
    kept = counts.join(total, "user_id").filter(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("total_favorites") / 2)))
    return kept.withColumn("confidence", F.least(F.col("total_favorites") / 5, F.lit(1.0)))


def funnel_counts(states: DataFrame) -> DataFrame:
    return states.groupBy(F.get_json_object("state", "$.working.current_phase").alias("phase")).agg(count().alias("n"))


def diagnose(parcels: DataFrame, searches: DataFrame) -> DataFrame:
    """Per search: rows in its city (without one: all rows), matches of each active filter, the first filter without a match, and a relaxation.

    Every filter is counted in the same pass; the category distribution is a second grouped count.
    """
    from hectara.operators.search import with_searches

    s = searches.select(*[F.col(c).alias("c_" + c) for c in searches.columns])
    j = with_searches(parcels, s)
    cats = [("quiet_cats", "kategoria_ciszy"), ("nature_cats", "kategoria_natury"), ("density_cats", "gestosc_zabudowy"), ("access_cats", "kategoria_dostepu")]
    dists = [("forest_m", "dist_to_forest"), ("water_m", "dist_to_water"), ("school_m", "dist_to_school"), ("shop_m", "dist_to_supermarket")]
    area_on = (F.coalesce(F.col("c_min_area"), F.lit(0)) > 0) | (F.coalesce(F.col("c_max_area"), F.lit(0)) > 0)
    in_area = (F.col("area_m2") >= F.coalesce(F.col("c_min_area"), F.lit(0))) & (F.col("area_m2") <= F.coalesce(F.col("c_max_area"), F.lit(999999)))
    aggs = [count().alias("total")]
    # Only flags and numbers are kept a group: with an array among them Spark would sort all rows instead of hashing them.
    aggs += [F.when(F.bool_or(F.col("c_" + c).isNotNull()), F.count_if(F.array_contains("c_" + c, F.col(col)))).alias("n_" + c) for c, col in cats]
    aggs += [F.when(F.bool_or(area_on), F.count_if(in_area)).alias("n_area")]
    aggs += [F.when(F.first("c_" + c) > 0, F.count_if(F.col(col) <= F.col("c_" + c))).alias("n_" + c) for c, col in dists]
    counted = j.groupBy("c_search_id").agg(*aggs)
    order = [c for c, _ in cats] + ["area"] + [c for c, _ in dists]
    blocking = F.coalesce(*[F.when(F.col("n_" + c) == 0, c) for c in order], F.lit("combination"))
    long = j.select("c_search_id", F.inline(F.array(*[F.struct(F.lit(c).alias("filter"), F.col(col).alias("value")) for c, col in cats])))
    top = dominant(long, ["c_search_id", "filter"], "value", "dominant")
    out = counted.withColumn("filter", blocking).join(top, ["c_search_id", "filter"], "left").join(s.select("c_search_id", "c_min_area", "c_max_area", *["c_" + c for c, _ in dists]), "c_search_id")
    double = F.coalesce(*[F.when(F.col("filter") == c, F.col("c_" + c) * 2) for c, _ in dists])
    area = F.concat(F.floor(F.coalesce("c_min_area", F.lit(0)) * 0.5).cast("string"), F.lit("-"), F.floor(F.coalesce("c_max_area", F.lit(999999)) * 1.5).cast("string"))
    relax = F.coalesce("dominant", F.when(F.col("filter") == "area", area), double.cast("string"))
    return out.select(F.col("c_search_id").alias("search_id"), "total", *["n_" + c for c in order], F.col("filter").alias("blocking_filter"), relax.alias("relaxation"))
