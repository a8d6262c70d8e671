"""Domain tables derived from the given star-schema tables.

Every table is a list of column expressions that read the same in Spark SQL and in
ANSI SQL, so the engine and the checking database see identical inputs.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hectara.functions.geometry import rectangle


def pick(expr: str, values: list[str | None]) -> str:
    """CASE expression choosing the value at position expr."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"(CASE {expr} {arms} END)"


def unless(test: str, expr: str) -> str:
    return f"(CASE WHEN {test} THEN NULL ELSE {expr} END)"


def _x(k: str) -> str:
    return f"CAST(({k} * 7919) % 10007 AS DOUBLE)"


def _y(k: str) -> str:
    return f"CAST(({k} * 104729) % 9973 AS DOUBLE)"


def _dist(k: str, factor: int, span: int, hole: int) -> str:
    return unless(f"{k} % {hole} = 0", f"CAST(({k} * {factor}) % {span} AS INT)")


def _band(score: str, cuts: list[tuple[int, str]], last: str) -> str:
    arms = " ".join(f"WHEN {score} >= {c} THEN '{label}'" for c, label in cuts)
    return f"(CASE WHEN {score} IS NULL THEN 'nieznana' {arms} ELSE '{last}' END)"


K = "c_custkey"
_AREA = unless(f"{K} % 41 = 0", "CAST(floor(abs(c_acctbal)) AS INT)")
_QUIET = unless(f"{K} % 43 = 0", f"CAST(({K} * 17) % 101 AS INT)")
_NATURE = unless(f"{K} % 47 = 0", f"CAST(({K} * 29) % 101 AS INT)")
_ACCESS = unless(f"{K} % 53 = 0", f"CAST(({K} * 59) % 101 AS INT)")
_COUNT500 = unless(f"{K} % 31 = 0", f"CAST(({K} * 11) % 260 AS INT)")
_SYMBOL = pick(f"({K} % 10)", ["SW", "SJ", "SN", "SU", "SM", "SK", "SI", "SP", None, None])
_W = f"CAST({K} % 60 AS DOUBLE)"
_H = f"CAST(5 + ({K} * 13) % 120 AS DOUBLE)"
_BUILT = f"({K} % 3 = 0)"

PARCELS = {
    "pk": K,
    "id_dzialki": f"concat('D', {K})",
    "wojewodztwo": "r_name",
    "powiat": "concat('POWIAT_', n_regionkey)",
    "gmina": "n_name",
    "miejscowosc": "n_name",
    "dzielnica": f"(CASE WHEN {K} % 29 = 0 THEN NULL WHEN {K} % 4 = 0 THEN concat(c_mktsegment, ' DOLNY') ELSE c_mktsegment END)",
    "centroid_x": _x(K),
    "centroid_y": _y(K),
    "centroid_lat": f"54.0e0 + {_y(K)} / 1e5",
    "centroid_lon": f"18.0e0 + {_x(K)} / 1e5",
    "bbox_width": _W,
    "bbox_height": _H,
    "aspect_ratio": f"(CASE WHEN {K} % 60 > 0 THEN greatest({_W}, {_H}) / least({_W}, {_H}) END)",
    "area_m2": _AREA,
    "shape_index": unless(f"{K} % 37 = 0", f"(({K} * 31) % 1000) / 1e3"),
    "size_category": f"(CASE WHEN {_AREA} < 500 THEN 'mala' WHEN {_AREA} < 1500 THEN 'pod_dom' WHEN {_AREA} < 5000 THEN 'duza' WHEN {_AREA} >= 5000 THEN 'bardzo_duza' END)",
    "grupa_rej": pick(f"({K} % 10)", ["7", "7", "7 - osoby", "3 - Jednoosobowe", "4", "", "8", None, "9", "16"]),
    "grupa_rej_nazwa": pick(f"({K} % 10)", ["Osoby fizyczne", "Osoby fizyczne", "Osoby fizyczne", "Spółki Skarbu Państwa", "Gminy (własność)", None, "Spółdzielnie", None, "Kościoły i związki wyznaniowe", "Inne"]),
    "typ_wlasnosci": pick(f"({K} % 10)", ["prywatna", "prywatna", "prywatna", "publiczna", "publiczna", None, "spółdzielcza", None, "kościelna", "inna"]),
    "is_built": _BUILT,
    "has_residential": f"({K} % 6 = 0)",
    "has_industrial": f"({K} % 15 = 0)",
    "building_count": f"CAST(CASE WHEN {_BUILT} THEN 1 + {K} % 4 ELSE 0 END AS INT)",
    "building_max_floors": f"CAST(CASE WHEN {_BUILT} THEN 1 + {K} % 9 END AS INT)",
    "under_construction": f"CAST(CASE WHEN {K} % 20 = 0 THEN 1 ELSE 0 END AS INT)",
    "building_coverage_pct": f"CAST(CASE WHEN {_BUILT} THEN ({K} * 3) % 100 ELSE 0 END AS DOUBLE)",
    "building_main_function": f"(CASE WHEN {_BUILT} THEN " + pick(f"({K} % 4)", ["mieszkalne", "gospodarcze", "biurowe", "inne"]) + " END)",
    "building_type": f"(CASE WHEN {_BUILT} THEN " + pick(f"({K} % 5)", ["budynek jednorodzinny", "budynek gospodarczy", "biurowiec", "dom-letniskowy", "garaż"]) + " END)",
    "has_pog": f"({K} % 10 < 8)",
    "is_residential_zone": f"({K} % 10 < 5)",
    "pog_symbol": _SYMBOL,
    "pog_oznaczenie": f"(CASE WHEN {K} % 10 < 8 THEN concat(CAST({K} % 50 AS STRING), {_SYMBOL}) END)",
    "pog_nazwa": f"(CASE WHEN {K} % 10 < 8 THEN concat('strefa ', {_SYMBOL}) END)",
    "pog_maks_wysokosc_m": unless(f"{K} % 10 >= 8", f"CAST(6 + ({K} * 3) % 15 AS DOUBLE)"),
    "dist_to_school": _dist(K, 37, 4000, 23),
    "dist_to_kindergarten": _dist(K, 41, 3500, 19),
    "dist_to_bus_stop": _dist(K, 43, 3300, 61),
    "dist_to_pharmacy": _dist(K, 47, 4100, 67),
    "dist_to_doctors": _dist(K, 53, 4500, 71),
    "dist_to_supermarket": _dist(K, 59, 2500, 73),
    "dist_to_restaurant": _dist(K, 61, 2700, 79),
    "dist_to_forest": _dist(K, 67, 5600, 83),
    "dist_to_water": _dist(K, 71, 5300, 89),
    "dist_to_industrial": _dist(K, 73, 6000, 97),
    "dist_to_main_road": _dist(K, 79, 3600, 101),
    "dist_to_sea": _dist(K, 83, 12000, 13),
    "dist_to_river": _dist(K, 89, 7000, 17),
    "dist_to_lake": _dist(K, 97, 6500, 11),
    "dist_to_canal": _dist(K, 101, 5500, 7),
    "dist_to_pond": _dist(K, 103, 4700, 5),
    "nearest_water_type": pick(f"({K} % 7)", ["morze", "rzeka", "jezioro", "kanal", "staw", "zatoka", None]),
    "pct_forest_500m": unless(f"{K} % 59 = 0", f"(({K} * 7) % 1000) / 1e1"),
    "pct_water_500m": f"(({K} * 3) % 400) / 1e1",
    "count_buildings_500m": _COUNT500,
    "quietness_score": _QUIET,
    "nature_score": _NATURE,
    "accessibility_score": _ACCESS,
    "kategoria_ciszy": _band(_QUIET, [(80, "bardzo_cicha"), (60, "cicha"), (40, "umiarkowana")], "glosna"),
    "kategoria_natury": _band(_NATURE, [(70, "bardzo_zielona"), (50, "zielona"), (30, "umiarkowana")], "zurbanizowana"),
    "kategoria_dostepu": _band(_ACCESS, [(70, "doskonala"), (50, "dobra"), (30, "umiarkowana")], "ograniczona"),
    "gestosc_zabudowy": _band(_COUNT500, [(50, "gesta"), (20, "umiarkowana"), (5, "rzadka")], "bardzo_rzadka"),
}

S = "s_suppkey"
POI_TYPES = ["school", "bus_stop", "shop", "forest", "water", "pharmacy", "doctors", "restaurant", "industrial", "main_road"]
POI = {
    "poi_id": S,
    "x": _x(f"({S} + 31)"),
    "y": _y(f"({S} + 31)"),
    "type": pick(f"({S} % 10)", POI_TYPES),
    "source": f"(CASE WHEN {S} % 3 = 0 THEN 'bdot10k' ELSE 'osm' END)",
    "source_id": f"concat('node/', {S})",
    "name": unless(f"{S} % 4 = 0", "s_name"),
    "network": unless(f"{S} % 3 = 0", f"concat('NET_', {S} % 6)"),
    "subtype": f"(CASE WHEN {S} % 8 = 1 THEN 'language_school' END)",
    "category": pick(f"({S} % 10)", ["education", "transport", "shop", "nature", "nature", "health", "health", "gastro", "industry", "road"]),
}

ZONES = {
    "zone_id": S,
    "gmina": "n_name",
    "oznaczenie": f"concat(CAST({S} % 50 AS STRING), {pick(f'({S} % 9)', ['SW', 'SJ', 'SN', 'SU', 'SM', 'SK', 'SI', 'SP', 'SZ'])})",
    "symbol": pick(f"({S} % 9)", ["SW", "SJ", "SN", "SU", "SM", "SK", "SI", "SP", "SZ"]),
    "nazwa": f"concat('strefa ', {S} % 9)",
    "profil_podstawowy": pick(f"({S} % 5)", ["MN|U", "MW|U|KD", "ZP", "P|U", None]),
    "profil_podstawowy_nazwy": pick(f"({S} % 5)", ["mieszkaniowa|usługi", "wielorodzinna|usługi|drogi", "zieleń", "produkcja|usługi", None]),
    "profil_dodatkowy": pick(f"({S} % 4)", ["U", "ZP|KD", None, "MN"]),
    "maks_intensywnosc": unless(f"{S} % 6 = 0", f"({S} % 30) / 1e1"),
    "maks_zabudowa_pct": f"CAST(10 + {S} % 60 AS DOUBLE)",
    "maks_wysokosc_m": f"CAST(6 + {S} % 30 AS DOUBLE)",
    "min_bio_pct": f"CAST(20 + {S} % 50 AS DOUBLE)",
    "x0": _x(f"({S} + 7)"),
    "y0": _y(f"({S} + 7)"),
    "x1": f"{_x(f'({S} + 7)')} + 200 + ({S} * 37) % 900",
    "y1": f"{_y(f'({S} + 7)')} + 150 + ({S} * 53) % 700",
}

P = "p_partkey"
BUILDINGS = {
    "building_id": P,
    "x": _x(f"({P} + 3)"),
    "y": _y(f"({P} + 3)"),
    "bld_area": f"CAST(20 + ({P} * 7) % 300 AS DOUBLE)",
    "funkcja": pick(f"({P} % 6)", ["budynki mieszkalne", "budynki przemysłowe", "budynki biurowe", "budynki mieszkalne", None, "kapliczki"]),
    "typ": "p_type",
    "kategoria": f"(CASE WHEN {P} % 9 = 0 THEN 'w budowie' ELSE 'eksploatowany' END)",
    "kondygnacje": unless(f"{P} % 13 = 0", f"CAST(1 + {P} % 12 AS INT)"),
}
# Rectangles of whole-number size, so that areas and overlaps have exact answers in SQL.
SHAPES = {
    "shape_id": P,
    "gmina_no": f"CAST({P} % 25 AS INT)",
    "name": "p_name",
    "x0": _x(P),
    "y0": _y(P),
    "x1": f"{_x(P)} + 10 + {P} % 70",
    "y1": f"{_y(P)} + 10 + ({P} * 3) % 90",
}
PLOTS = {
    "plot_id": K,
    "gmina": "n_name",
    "x0": f"{_x(K)} - 60",
    "y0": f"{_y(K)} - 40",
    "x1": f"{_x(K)} + 60",
    "y1": f"{_y(K)} + 40",
}
# A brick pattern: every second row is shifted by half a brick, so borders are 10, 5 or a single corner.
BRICKS = {
    "plot_id": P,
    "x0": f"CAST(({P} % 40) * 10 + (CAST(floor({P} / 40) AS BIGINT) % 2) * 5 AS DOUBLE)",
    "y0": f"CAST(floor({P} / 40) * 10 AS DOUBLE)",
    "x1": f"CAST(({P} % 40) * 10 + (CAST(floor({P} / 40) AS BIGINT) % 2) * 5 + 10 AS DOUBLE)",
    "y1": f"CAST(floor({P} / 40) * 10 + 10 AS DOUBLE)",
    "district": f"concat('Q', CAST(floor({P} / 120) AS BIGINT))",
}
EDGES = {
    "edge_id": "l_orderkey * 10 + l_linenumber",
    "src": "concat('D', l_partkey)",
    "dst": "l_suppkey",
    "rel": pick("(l_linenumber % 6)", ["NEAR_SCHOOL", "NEAR_BUS_STOP", "NEAR_SHOP", "NEAR_WATER", "NEAR_FOREST", "NEAR_ROAD"]),
    "distance_m": "l_quantity * 40",
}
FEEDBACK = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "action": "(CASE event_type WHEN 'purchase' THEN 'favorite' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'clear' WHEN 'click' THEN 'compare' ELSE event_type END)",
    "parcel_id": "concat('D', regexp_extract(props, '([0-9]+)', 1))",
    "value": "value",
}
STATES = {
    "user_id": "o_custkey",
    "updated_at": "o_orderdate",
    "order_no": "o_orderkey",
    "state": "concat('{\"working\":{\"current_phase\":\"', (CASE o_orderstatus WHEN 'O' THEN 'SEARCH' WHEN 'F' THEN 'EVALUATION' ELSE 'DISCOVERY' END), '\"},\"n\":', CAST(o_orderkey % 9 AS STRING), '}')",
}
MESSAGES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "text": "concat(text, ' ', " + pick("((conv_id * 7 + turn) % 16)", [
        "Szukaj działki, budżet 700 tys", "Mam dzieci i psa, cisza i las", "pracuję w gdańsk, pilne", "Porównaj obie, która lepsza",
        "kredyt na 900000 zł", "1200 m2 pod dom", "nie podoba mi się, za mał ogród", "ta druga, bo las i szkoła",
        "opisz okolicę, atmosfera", "zadzwoń, kontakt mail", "inwestycja i zwrot, MPZP", "dokładnie dane i liczby",
        "spokojna wieś, zieleń i komunikacja", "za drogie, hałas za oknem", "ok", "działka 2500 metrów, sklep i autobus",
    ]) + ")",
}
N = "n_nationkey"
SEARCHES = {
    "search_id": N,
    "gmina": unless(f"{N} % 9 = 4", "n_name"),
    "miejscowosc": unless(f"{N} % 8 <> 5", "'MACHINERY'"),
    "min_area": f"CAST(CASE WHEN {N} % 3 = 0 THEN 0 ELSE 300 END AS INT)",
    "max_area": unless(f"{N} % 4 = 3", "CAST(8000 AS INT)"),
    "ownership_type": unless(f"{N} % 5 <> 1", "'prywatna'"),
    "build_status": unless(f"{N} % 7 <> 2", "'niezabudowana'"),
    "quiet_cats": unless(f"{N} % 2 = 1", "'bardzo_cicha|cicha'"),
    "nature_cats": unless(f"{N} % 3 = 2", "'bardzo_zielona|zielona'"),
    "access_cats": unless(f"{N} % 4 <> 0", "'doskonala|dobra'"),
    "density_cats": unless(f"{N} % 5 <> 3", "'rzadka|bardzo_rzadka'"),
    "size_cats": unless(f"{N} % 6 <> 4", "'pod_dom|duza'"),
    "forest_m": unless(f"{N} % 4 <> 1", "CAST(800 AS INT)"),
    "water_m": unless(f"{N} % 5 <> 4", "CAST(900 AS INT)"),
    "water_type": unless(f"{N} % 6 <> 3", "'jezioro'"),
    "school_m": unless(f"{N} % 3 <> 1", "CAST(1001 AS INT)"),
    "shop_m": unless(f"{N} % 7 <> 6", "CAST(700 AS INT)"),
    "bus_m": unless(f"{N} % 5 <> 2", "CAST(500 AS INT)"),
    "hospital_m": unless(f"{N} % 9 <> 8", "CAST(1500 AS INT)"),
    "min_forest_pct": unless(f"{N} % 6 <> 5", "20e0"),
    "industrial_m": unless(f"{N} % 4 <> 2", "CAST(1001 AS INT)"),
    "w_quietness": f"CASE WHEN {N} % 6 = 5 THEN 4e-1 ELSE 0e0 END",
    "w_school": f"CASE WHEN {N} % 12 = 5 THEN 3e-1 ELSE 0e0 END",
}
_PRICE = "(150 + (c_nationkey * 397 + length(c_mktsegment) * 211) % 3900)"
PRICES = {
    "city": "n_name",
    "district": "c_mktsegment",
    "price_min": f"CAST({_PRICE} AS INT)",
    "price_max": f"CAST({_PRICE} + 100 + (c_nationkey * 37) % 400 AS INT)",
    "segment": f"(CASE WHEN {_PRICE} > 3000 THEN 'ULTRA_PREMIUM' WHEN {_PRICE} > 1500 THEN 'PREMIUM' WHEN {_PRICE} > 800 THEN 'HIGH' WHEN {_PRICE} > 500 THEN 'MEDIUM' WHEN {_PRICE} > 300 THEN 'BUDGET' ELSE 'ECONOMY' END)",
}
CITY_PRICES = {
    "city": "n_name",
    "price_min": "CAST(200 + n_nationkey * 31 AS INT)",
    "price_max": "CAST(500 + n_nationkey * 43 AS INT)",
    "segment": "(CASE WHEN n_nationkey < 10 THEN 'BUDGET' ELSE 'MEDIUM' END)",
}

_CUSTOMER = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_SUPPLIER = "supplier JOIN nation ON s_nationkey = n_nationkey"
_PRICED = (
    "(SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE (c_nationkey + length(c_mktsegment)) % 3 <> 0) c "
    "JOIN nation ON c_nationkey = n_nationkey"
)
TABLES: dict[str, tuple[dict[str, str], str]] = {
    "parcels": (PARCELS, _CUSTOMER),
    "poi": (POI, "supplier"),
    "zones": (ZONES, _SUPPLIER),
    "buildings": (BUILDINGS, "part"),
    "shapes": (SHAPES, "part"),
    "plots": (PLOTS, "customer JOIN nation ON c_nationkey = n_nationkey"),
    "bricks": (BRICKS, "part"),
    "edges": (EDGES, "lineitem"),
    "feedback": (FEEDBACK, "events"),
    "states": (STATES, "orders"),
    "messages": (MESSAGES, "conversations"),
    "searches": (SEARCHES, "nation"),
    "prices": (PRICES, _PRICED),
    "city_prices": (CITY_PRICES, "nation WHERE n_nationkey % 7 <> 3"),
}


def table_sql(name: str) -> str:
    columns, source = TABLES[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM " + source


def oracle(body: str) -> str:
    """Put the derived tables a checking query mentions in front of it."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]
    if not used:
        return body
    ctes = ", ".join(f"{t} AS ({table_sql(t)})" for t in used)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes} {body}"


# Checking SQL before the derived tables are put in front; lets one query build on another.
ORACLE_TEXT: dict[str, str] = {}

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; rectangles also carry their vertex rings."""
    columns, source = TABLES[name]
    head = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM "
    inputs = {t: raw(spark, sf_dir, t) for t in RAW if re.search(rf"\b{t}\b", source)}
    for t in inputs:
        source = re.sub(rf"\b{t}\b", "{" + t + "}", source)
    df = spark.sql(head.replace("{", "{{").replace("}", "}}") + source, **inputs)
    if "x0" in columns:
        df = df.withColumn("rings", rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return df
