"""Search predicates and searches over the wide parcel table."""
from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hectara.functions import constants as C
from hectara.functions.labels import lookup
from hectara.functions.scores import decay, half_even, shape_term


def in_district(column: Column, name: str) -> Column:
    """Exact name or the name followed by a space and more."""
    return (column == name) | column.startswith(name + " ")


def location_centres(parcels: DataFrame, by: list[str], district: bool) -> DataFrame:
    return parcels.groupBy(*by).agg(
        F.round(F.avg("centroid_lat"), 6).alias("lat"), F.round(F.avg("centroid_lon"), 6).alias("lon"),
        F.count(F.lit(1)).alias("parcels"), F.lit(3000 if district else 10000).alias("radius_m"),
    )


def clean_shape(include_infrastructure: bool = False) -> Column:
    """Always-on quality test; unknown values pass."""
    ratio, index, symbol = F.col("aspect_ratio"), F.col("shape_index"), F.col("pog_symbol")
    test = (ratio.isNull() | (ratio <= 6.0)) & (index.isNull() | (index >= 0.15))
    if not include_infrastructure:
        test = test & (symbol.isNull() | ~symbol.isin(C.INFRASTRUCTURE_SYMBOLS))
    return test


SORTABLE = ["quietness_score", "nature_score", "accessibility_score", "area_m2"]


def search_by_criteria(
    parcels: DataFrame,
    gmina: str | None = None,
    min_area: float | None = None,
    max_area: float | None = None,
    has_pog: bool | None = None,
    residential: bool | None = None,
    min_quietness: int | None = None,
    min_nature: int | None = None,
    min_accessibility: int | None = None,
    order_by: str = "quietness_score",
    descending: bool = True,
    limit: int = 50,
) -> DataFrame:
    """Optional filters, then a top-n by a whitelisted column with nulls last. 0 and '' mean no filter."""
    df = parcels
    for value, test in [
        (gmina, lambda v: F.col("gmina") == v),
        (min_area, lambda v: F.col("area_m2") >= v),
        (max_area, lambda v: F.col("area_m2") <= v),
        (min_quietness, lambda v: F.col("quietness_score") >= v),
        (min_nature, lambda v: F.col("nature_score") >= v),
        (min_accessibility, lambda v: F.col("accessibility_score") >= v),
    ]:
        if value:
            df = df.filter(test(value))
    if has_pog is not None:
        df = df.filter(F.col("has_pog") == has_pog)
    if residential is not None:
        df = df.filter(F.col("is_residential_zone") == residential)
    key = F.col(order_by if order_by in SORTABLE else "quietness_score")
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id_dzialki").limit(limit)


def by_water(parcels: DataFrame, water_type: str, max_distance: float, limit: int, area: tuple[int, int] | None = None, built: bool | None = None) -> DataFrame:
    column = F.col(C.WATER_DISTANCE_COLUMNS.get(water_type, "dist_to_water"))
    df = parcels.filter(column <= max_distance)
    if area:
        df = df.filter(F.col("area_m2").between(*area))
    if built is not None:
        df = df.filter(F.col("is_built") == built)
    return df.withColumn("water_distance", column).orderBy("water_distance", "id_dzialki").limit(limit)


@dataclass
class Criteria:
    """One search; every field is optional. Lists are category names, *_m are metres, w_* are weights."""

    gmina: str | None = None
    miejscowosc: str | None = None
    powiat: str | None = None
    min_area: float | None = None
    max_area: float | None = None
    ownership_type: str | None = None
    build_status: str | None = None
    pog_residential: bool | None = None
    has_pog: bool | None = None
    buildable: bool | None = None
    symbols: list[str] | None = None
    road_access: bool | None = None
    include_infrastructure: bool = False
    quiet_cats: list[str] | None = None
    nature_cats: list[str] | None = None
    access_cats: list[str] | None = None
    density_cats: list[str] | None = None
    size_cats: list[str] | None = None
    forest_m: int | None = None
    water_m: int | None = None
    water_type: str | None = None
    near_water: bool | None = None
    sea_m: int | None = None
    lake_m: int | None = None
    river_m: int | None = None
    school_m: int | None = None
    shop_m: int | None = None
    bus_m: int | None = None
    hospital_m: int | None = None
    min_forest_pct: float | None = None
    industrial_m: int | None = None
    w_quietness: float = 0.0
    w_nature: float = 0.0
    w_forest: float = 0.0
    w_water: float = 0.0
    w_school: float = 0.0
    w_shop: float = 0.0
    w_transport: float = 0.0
    w_accessibility: float = 0.0

    @classmethod
    def simple(cls, quiet=False, green=False, accessible=False, near_forest=False, **rest) -> "Criteria":
        """Yes/no wishes expand to category lists and a 300 m forest limit."""
        return cls(
            quiet_cats=["bardzo_cicha", "cicha"] if quiet else None,
            nature_cats=["bardzo_zielona", "zielona"] if green else None,
            access_cats=["doskonala", "dobra"] if accessible else None,
            forest_m=300 if near_forest else None,
            **rest,
        )

    def relaxed(self) -> "Criteria":
        """Distance limits doubled, given weights times 0.7."""
        changed = {n: getattr(self, n) * 2 for n in ("forest_m", "water_m", "school_m", "shop_m", "bus_m", "hospital_m") if getattr(self, n)}
        changed |= {f.name: getattr(self, f.name) * 0.7 for f in fields(self) if f.name.startswith("w_")}
        return replace(self, **changed)

    def hard_only(self) -> "Criteria":
        kept = ("gmina", "miejscowosc", "powiat", "min_area", "max_area", "ownership_type", "build_status", "size_cats", "pog_residential")
        return Criteria(**{n: getattr(self, n) for n in kept})

    def columns(self) -> dict[str, Column]:
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.endswith("cats") or f.name == "symbols":
                out[f.name] = F.array(*[F.lit(v) for v in value]) if value else F.lit(None).cast("array<string>")
            elif value is None:
                kind = "double" if f.name.endswith("_m") or f.name in ("min_area", "max_area", "min_forest_pct") else "boolean" if f.name in BOOLEANS else "string"
                out[f.name] = F.lit(None).cast(kind)
            else:
                out[f.name] = F.lit(value)
        return out


BOOLEANS = {"pog_residential", "has_pog", "buildable", "road_access", "include_infrastructure", "near_water"}
DIMENSIONS = ["quietness", "nature", "forest", "water", "school", "shop", "transport", "accessibility"]


def criteria_columns(df: DataFrame, prefix: str = "c_") -> dict[str, Column]:
    """Columns of a criteria table (one search per row); fields it lacks count as not given."""
    out = Criteria().columns()
    return {name: F.col(prefix + name) if prefix + name in df.columns else default for name, default in out.items()}


def _given(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def weights(c: dict[str, Column]) -> dict[str, Column]:
    """Explicit weights when any is above zero, else inferred from the active wishes and scaled to sum 1."""
    explicit = F.greatest(*[c[f"w_{d}"] for d in DIMENSIONS]) > 0
    has = {k: c[f"{k}_cats"].isNotNull() for k in ("quiet", "nature", "access")}
    inferred = {
        "quietness": F.when(has["quiet"], 0.25).otherwise(0.1),
        "nature": F.when(has["nature"], 0.2).otherwise(0.05),
        "forest": F.when(_given(c["forest_m"]), 0.2).otherwise(0.0),
        "water": F.when(c["water_type"].isNotNull() | _given(c["water_m"]) | F.coalesce(c["near_water"], F.lit(False)), 0.2).otherwise(0.0),
        "school": F.when(_given(c["school_m"]), 0.15).otherwise(0.0),
        "shop": F.when(_given(c["shop_m"]), 0.1).otherwise(0.0),
        "transport": F.when(_given(c["bus_m"]) | has["access"], 0.1).otherwise(0.0),
        "accessibility": F.when(has["access"], 0.15).otherwise(0.05),
    }
    total = sum(inferred.values(), F.lit(0.0))
    return {d: F.when(explicit, c[f"w_{d}"]).otherwise(half_even(inferred[d] / total, 3)) for d in DIMENSIONS}


def hard_filter(c: dict[str, Column]) -> Column:
    """All must-match conditions of a search."""

    def optional(value: Column, test: Column) -> Column:
        return value.isNull() | F.coalesce(test, F.lit(False))

    built = F.when(F.col("is_built"), "zabudowana").otherwise("niezabudowana")
    owner = lookup(C.OWNERSHIP_IDS, F.col("typ_wlasnosci"))
    road = F.col("dist_to_main_road")
    district = F.col("dzielnica")
    zoning_ok = F.col("pog_symbol").isNull() | ~F.col("pog_symbol").isin(C.INFRASTRUCTURE_SYMBOLS)
    return (
        optional(c["gmina"], F.col("gmina") == c["gmina"])
        & optional(c["miejscowosc"], (district == c["miejscowosc"]) | F.startswith(district, F.concat(c["miejscowosc"], F.lit(" "))))
        & optional(c["powiat"], F.col("powiat") == c["powiat"])
        & (~_given(c["min_area"]) | F.coalesce(F.col("area_m2") >= c["min_area"], F.lit(False)))
        & (~_given(c["max_area"]) | F.coalesce(F.col("area_m2") <= c["max_area"], F.lit(False)))
        & optional(c["ownership_type"], owner == c["ownership_type"])
        & optional(c["build_status"], built == c["build_status"])
        & (~F.coalesce(c["pog_residential"], F.lit(False)) | F.col("is_residential_zone"))
        & optional(c["has_pog"], F.col("pog_symbol").isNotNull() == c["has_pog"])
        & (~F.coalesce(c["buildable"], F.lit(False)) | F.col("is_residential_zone"))
        & optional(c["symbols"], F.array_contains(c["symbols"], F.col("pog_symbol")))
        & optional(c["road_access"], (road < 50) == c["road_access"])
        & clean_shape(include_infrastructure=True)
        & (c["include_infrastructure"] | zoning_ok)
    )


def total_score(c: dict[str, Column]) -> Column:
    """Weighted sum of the soft terms; distances fall off exponentially beyond half of their limit."""
    w = weights(c)

    def banded(score: str, band: str, cats: Column) -> Column:
        s = F.coalesce(F.col(score), F.lit(0)) / 100.0
        return F.when(F.coalesce(F.array_contains(cats, F.col(band)), F.lit(False)), s * 0.5 + 0.5).otherwise(s)

    def near(column: Column, limit: Column, ideal: int, scale: int, share: float = 0.5) -> Column:
        ideal_c = F.when(_given(limit), F.floor(limit * share)).otherwise(ideal)
        scale_c = F.when(_given(limit), limit).otherwise(scale)
        return decay(column, ideal_c.cast("double"), scale_c.cast("double"))

    def extra(active: Column, weight: float, term: Column) -> Column:
        return F.when(active, term * weight).otherwise(0.0)

    wanted = c["water_type"]
    threshold = F.coalesce(lookup({k: v[2] for k, v in C.WATER_TYPES.items()}, wanted), F.lit(500))
    typed = F.col("dist_to_water")
    for kind, column in C.WATER_DISTANCE_COLUMNS.items():
        typed = F.when(wanted == kind, F.col(column)).otherwise(typed)
    water = F.when(wanted.isNotNull(), decay(typed, F.floor(threshold * 0.3).cast("double"), threshold.cast("double"))).otherwise(
        near(F.col("dist_to_water"), c["water_m"], 200, 500)
    )
    pct, low = F.col("pct_forest_500m"), c["min_forest_pct"]
    forest_share = F.when(pct >= low, 1.0).when(pct >= low * 0.5, 0.5).otherwise(F.coalesce(pct, F.lit(0.0)) / F.greatest(low, F.lit(0.01)))
    ind, far = F.col("dist_to_industrial"), F.floor(c["industrial_m"])
    away = F.when(ind.isNull(), 0.5).when(ind >= far, 1.0).when(ind >= F.greatest(F.lit(1), F.floor(far / 2)), 0.5).otherwise(0.0)
    return (
        w["quietness"] * banded("quietness_score", "kategoria_ciszy", c["quiet_cats"])
        + w["nature"] * banded("nature_score", "kategoria_natury", c["nature_cats"])
        + w["accessibility"] * banded("accessibility_score", "kategoria_dostepu", c["access_cats"])
        + extra(F.coalesce(F.array_contains(c["density_cats"], F.col("gestosc_zabudowy")), F.lit(False)), 0.1, F.lit(1.0))
        + extra(F.coalesce(F.array_contains(c["size_cats"], F.col("size_category")), F.lit(False)), 0.1, F.lit(1.0))
        + w["forest"] * near(F.col("dist_to_forest"), c["forest_m"], 200, 500)
        + w["water"] * water
        + sum((extra(_given(c[k]), 0.15, near(F.col(d), c[k], 1, 1, 0.3)) for k, d in (("sea_m", "dist_to_sea"), ("lake_m", "dist_to_lake"), ("river_m", "dist_to_river"))), F.lit(0.0))
        + extra(F.coalesce(c["near_water"], F.lit(False)) & (w["water"] == 0), 0.15, decay(F.col("dist_to_water"), 150.0, 500.0))
        + w["school"] * near(F.col("dist_to_school"), c["school_m"], 400, 1000)
        + w["shop"] * near(F.col("dist_to_supermarket"), c["shop_m"], 300, 800)
        + w["transport"] * near(F.col("dist_to_bus_stop"), c["bus_m"], 250, 600)
        + extra(_given(c["hospital_m"]), 0.1, near(F.col("dist_to_doctors"), c["hospital_m"], 1, 1))
        + extra(_given(low), 0.1, forest_share)
        + extra(_given(c["industrial_m"]), 0.1, away)
        + shape_term(F.col("shape_index"), F.col("aspect_ratio"))
    )


def scored_search(parcels: DataFrame, criteria: Criteria, limit: int) -> DataFrame:
    """One search: hard filters, score rounded to 6 places, best first."""
    c = criteria.columns()
    return (
        parcels.filter(hard_filter(c)).withColumn("total_score", F.round(total_score(c), 6))
        .orderBy(F.col("total_score").desc(), F.col("quietness_score").desc_nulls_last(), "id_dzialki").limit(limit)
    )


SLICES = 64


def with_searches(parcels: DataFrame, asked: DataFrame) -> DataFrame:
    """Each search (columns c_...) beside the parcels it may choose, the hard filters aside.

    A search with a city meets that city's parcels by key. One without a city may choose any parcel: it is
    sent to every slice of the parcels and meets them slice by slice, so no task gathers them all.
    """
    there = parcels.join(asked.filter("c_gmina is not null"), F.col("gmina") == F.col("c_gmina"))
    anywhere = asked.filter("c_gmina is null").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    sliced = parcels.withColumn("_slice", F.pmod(F.xxhash64("id_dzialki"), F.lit(SLICES)).cast("int"))
    return there.unionByName(sliced.join(anywhere, "_slice").drop("_slice"))


def scored_search_many(parcels: DataFrame, searches: DataFrame, per_search: int) -> DataFrame:
    """Many searches in one job, with or without a city. The rank filter lets Spark keep only the best rows
    of each partition before the shuffle, so a popular city does not gather in one task."""
    joined = with_searches(parcels, searches.select(*[F.col(n).alias("c_" + n) for n in searches.columns]))
    c = criteria_columns(joined)
    scored = joined.filter(hard_filter(c)).withColumn("total_score", F.round(total_score(c), 6))
    order = Window.partitionBy("c_search_id").orderBy(F.col("total_score").desc(), F.col("quietness_score").desc_nulls_last(), "id_dzialki")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_search)
    return ranked.withColumnRenamed("c_search_id", "search_id")


def split_lists(searches: DataFrame) -> DataFrame:
    """Pipe-joined category lists to arrays."""
    return searches.select(*[F.split(n, "[|]").alias(n) if n.endswith("_cats") else F.col(n) for n in searches.columns])


def request_guard(lat: Column, lon: Column, radius: Column) -> tuple[Column, Column, Column]:
    """Error text of an out-of-area point, the radius held to 20 km, and whether it was held."""
    error = F.when(~lat.between(49, 55), "lat").when(~lon.between(14, 24), "lon")
    return error, F.least(radius, F.lit(20000)), F.coalesce(radius > 20000, F.lit(False))


def window_guard(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    return F.when((max_lat - min_lat > 0.5) | (max_lon - min_lon > 0.7), "window too large")


def parcel_card(parcels: DataFrame) -> DataFrame:
    """The card view with its public names."""
    renames = {
        "id_dzialki": "id", "dist_to_supermarket": "dist_to_shop", "dist_to_doctors": "dist_to_hospital",
        "centroid_lat": "lat", "centroid_lon": "lon", "pog_symbol": "mpzp_symbol", "has_pog": "has_mpzp",
    }
    kept = [
        "id_dzialki", "gmina", "dzielnica", "area_m2", "centroid_lat", "centroid_lon", "quietness_score", "nature_score", "accessibility_score",
        "dist_to_school", "dist_to_supermarket", "dist_to_doctors", "dist_to_bus_stop", "dist_to_forest", "dist_to_water", "pct_forest_500m",
        "count_buildings_500m", "has_pog", "pog_symbol", "is_residential_zone", "kategoria_ciszy", "kategoria_natury", "nearest_water_type",
    ]
    return parcels.select(*[F.col(c).alias(renames.get(c, c)) for c in kept])


# Names of waters on the cards, the column of each one's distance, and how near counts as near (m).
CARD_WATERS = {"morze": "Morze", "jezioro": "Jezioro", "rzeka": "Rzeka", "kanal": "Kanał", "staw": "Staw"}
CARD_WATER_LIMITS = [("dist_to_sea", "Morze", 5000), ("dist_to_lake", "Jezioro", 3000), ("dist_to_river", "Rzeka", 2000), ("dist_to_canal", "Kanał", 1000)]
NO_WATER = "Brak wody w pobliżu"

# The columns of the cards; a pair gives a column and its public name.
PLACE_AND_SCORES = ["area_m2", ("centroid_lat", "lat"), ("centroid_lon", "lon"), "kategoria_ciszy", "kategoria_natury", "kategoria_dostepu", "gestosc_zabudowy",
                    "quietness_score", "nature_score", "accessibility_score", "is_built", "building_count", "building_coverage_pct", "building_max_floors"]
HEIGHT_AND_COVER = [("pog_maks_wysokosc_m", "pog_max_wysokosc"), ("pog_maks_zabudowa_pct", "pog_max_zabudowa")]
WATERS = ["dist_to_sea", "dist_to_river", "dist_to_lake", "dist_to_canal", "dist_to_pond", "dist_to_water", "nearest_water_type"]
ZONING = [("pog_symbol", "mpzp_symbol"), ("pog_nazwa", "mpzp_nazwa"), ("is_residential_zone", "mpzp_budowlany")]
CARDS = {
    "context": [("id_dzialki", "id"), "area_m2", ("quietness_score", "quietness"), ("nature_score", "nature"), ("accessibility_score", "accessibility"), "gmina", ("dzielnica", "miejscowosc"), "powiat", *ZONING],
    "neighborhood": [("id_dzialki", "id"), "gmina", ("dzielnica", "miejscowosc"), "powiat", *PLACE_AND_SCORES, ("has_pog", "has_mpzp"), *ZONING, *HEIGHT_AND_COVER, "dist_to_school", ("dist_to_supermarket", "dist_to_shop"),
                     ("dist_to_doctors", "dist_to_hospital"), "dist_to_bus_stop", "dist_to_industrial", "dist_to_forest", *WATERS, "pct_forest_500m", "pct_water_500m", "count_buildings_500m"],
    "full_context": ["id_dzialki", "gmina", "dzielnica", *PLACE_AND_SCORES, "pog_symbol", "pog_nazwa", ("pog_profil_podstawowy", "pog_profil"), *HEIGHT_AND_COVER, "is_residential_zone", *WATERS,
                     "dist_to_school", "dist_to_bus_stop", "dist_to_forest", "dist_to_supermarket", "dist_to_main_road", "pct_forest_500m", "count_buildings_500m"],
    "water": ["id_dzialki", "dzielnica", *WATERS],
}


def card(parcels: DataFrame, name: str) -> DataFrame:
    """One of CARDS for every parcel; columns that the parcels lack are left out."""
    pairs = [c if isinstance(c, tuple) else (c, c) for c in CARDS[name]]
    return parcels.select(*[F.col(c).alias(alias) for c, alias in pairs if c in parcels.columns])


def whole(value: Column) -> Column:
    return F.floor(value).cast("long").cast("string")


def nearest_water_text() -> Column:
    """Name and distance of the nearest water; that of the sea by its own column, of others by the general one; none without a distance."""
    kind = F.col("nearest_water_type")
    meters = F.when(kind == "morze", F.col("dist_to_sea")).otherwise(F.col("dist_to_water"))
    return F.when(kind.isNotNull() & (meters != 0), F.concat(F.coalesce(lookup(CARD_WATERS, kind), kind), F.lit(" ("), whole(meters), F.lit("m)")))


def rated(label: str, score: str, category: str) -> Column:
    return F.when(F.col(score).isNotNull(), F.concat(F.lit(label + ": "), whole(F.col(score)), F.lit("/100 ("), F.coalesce(category, F.lit("")), F.lit(")")))


def square_meters(area: Column) -> Column:
    return F.concat(F.format_number(area, 0), F.lit(" m²"))


def context_card(parcels: DataFrame) -> DataFrame:
    return card(parcels, "context").withColumn("has_mpzp", F.col("mpzp_symbol").isNotNull())


def neighborhood_card(parcels: DataFrame) -> DataFrame:
    """The card and its summary in sentences; a sentence without its value is left out."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    place = F.when(F.coalesce("miejscowosc", F.lit("")) != "", F.concat(F.lit("Lokalizacja: "), "miejscowosc", F.lit(", "), F.coalesce("gmina", F.lit("")))).otherwise(F.concat(F.lit("Lokalizacja: "), "gmina"))
    built = F.when(F.col("is_built"), F.concat(F.lit("Zabudowana"), F.when(given("building_count"), F.concat(F.lit(" ("), F.col("building_count").cast("string"), F.lit(" bud.)"))).otherwise(""))).otherwise("Niezabudowana")
    area = F.when(given("area_m2"), F.concat(F.lit("Powierzchnia: "), square_meters(F.col("area_m2"))))
    scores = [rated("Cisza", "quietness_score", "kategoria_ciszy"), rated("Natura", "nature_score", "kategoria_natury"), rated("Dostępność", "accessibility_score", "kategoria_dostepu")]
    sentences = F.array(place, area, built, *scores, F.concat(F.lit("Woda: "), nearest_water_text()))
    return card(parcels, "neighborhood").withColumn("summary", F.array_compact(sentences))


def full_context_card(parcels: DataFrame) -> DataFrame:
    """The card and its summary as a struct; absent numbers read 0, absent words nothing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    yes = lambda c: F.when(F.col(c), "Tak").otherwise("Nie")
    score = lambda c, k: F.concat(F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("/100 ("), text(k), F.lit(")"))
    summary = F.struct(
        F.concat(text("dzielnica"), F.lit(", "), text("gmina")).alias("lokalizacja"), square_meters(F.coalesce("area_m2", F.lit(0))).alias("powierzchnia"), yes("is_built").alias("zabudowana"),
        yes("is_residential_zone").alias("strefa_mieszkaniowa"), score("quietness_score", "kategoria_ciszy").alias("cisza"), score("nature_score", "kategoria_natury").alias("natura"),
        score("accessibility_score", "kategoria_dostepu").alias("dostepnosc"), nearest_water_text().alias("najblizsa_woda"),
    )
    return card(parcels, "full_context").withColumn("summary", summary)


def water_card(parcels: DataFrame) -> DataFrame:
    """Distances to all waters, and those that count as near as sentences; a distance of 0 counts as absent."""
    near = [F.when((F.col(c) != 0) & (F.col(c) <= limit), F.concat(F.lit(label + ": "), F.col(c).cast("string"), F.lit("m"))) for c, label, limit in CARD_WATER_LIMITS]
    found = F.array_compact(F.array(*near))
    return card(parcels, "water").withColumn("water_summary", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_WATER)))).withColumn("has_water_nearby", F.size(found) > 0)


def compare(parcels: DataFrame, ids: list[str], attributes: list[str]) -> DataFrame:
    """Two to five parcels side by side: one row per attribute, one column per parcel."""
    chosen = parcels.filter(F.col("id_dzialki").isin(ids)).select("id_dzialki", *[F.col(a).cast("string").alias(a) for a in attributes])
    long = chosen.unpivot(["id_dzialki"], attributes, "attribute", "value")
    return long.groupBy("attribute").pivot("id_dzialki", ids).agg(F.first("value"))
