"""Classification rules as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hectara.functions import constants as C


def lookup(values: dict, key: Column) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    return F.create_map([F.lit(v) for pair in values.items() for v in pair])[key]


def size_class(area: Column, scheme: str = "pipeline") -> Column:
    cuts, rest = C.SIZE_CLASSES[scheme]
    rule = F.when(area.isNull(), None)
    for limit, label in cuts:
        rule = rule.when(area < limit, label)
    return rule.otherwise(rest)


def band(score: Column, kind: str) -> Column:
    cuts, rest = C.BANDS[kind]
    rule = F.when(score.isNull(), C.UNKNOWN_BAND)
    for limit, label in cuts:
        rule = rule.when(score >= limit, label)
    return rule.otherwise(rest)


def residential(symbol: Column) -> Column:
    return F.coalesce(symbol.isin(C.RESIDENTIAL_SYMBOLS), F.lit(False))


def buildable_type(symbol: Column) -> Column:
    return F.coalesce(lookup(C.BUILDABLE_TYPES, symbol), F.lit("brak"))


def owner_group_code(raw: Column) -> Column:
    """Leading number of the register entry; other text passes, blank becomes null."""
    text = F.trim(raw)
    code = F.regexp_extract(text, r"^(\d[^\s-]*)", 1)
    return F.when(raw == "", None).when(code != "", code).otherwise(text)


def ownership_type(code: Column) -> Column:
    return lookup(C.OWNERSHIP_TYPES, code)


def water_class(name: Column, kind: Column, area: Column) -> Column:
    """Sea first, then ordered name lists, then flowing or standing water by size."""
    lowered = F.lower(name)
    rule = F.when((kind == "woda morska") & name.contains("Zatoka"), "zatoka").when(kind == "woda morska", "morze")
    for water, words in C.WATER_NAMES:
        rule = rule.when(contains_any(lowered, words), water)
    return (
        rule.when(kind == "woda płynąca", "rzeka")
        .when((kind == "woda stojąca") & (area >= C.LAKE_MIN_AREA), "jezioro")
        .otherwise("staw")
    )


def water_priority(water: Column) -> Column:
    return lookup({k: v[0] for k, v in C.WATER_TYPES.items()}, water)


def water_premium(water: Column) -> Column:
    return lookup({k: v[1] for k, v in C.WATER_TYPES.items()}, water)


def nearest_water(distances: dict[str, Column]) -> tuple[Column, Column]:
    """Smallest distance over water types and the first type in the fixed order that has it."""
    smallest = F.least(*[distances[w] for w in C.WATER_ORDER])
    return smallest, F.coalesce(*[F.when(distances[w] == smallest, w) for w in C.WATER_ORDER])


def water_band(distance: Column) -> Column:
    return (
        F.when(distance.isNull(), None).when(distance < 200, "very_close").when(distance < 500, "close").when(distance < 1000, "moderate").otherwise("far")
    )


def building_function(name: Column) -> Column:
    return F.coalesce(lookup(C.BUILDING_FUNCTIONS, name), name)


def education_type(amenity: Column) -> tuple[Column, Column]:
    kind = F.when(amenity == "kindergarten", "kindergarten").otherwise("school")
    subtype = F.when(amenity.isin("school", "kindergarten"), None).otherwise(amenity)
    return kind, subtype


def transport_mode(train: Column, railway: Column, tram: Column, bus: Column) -> Column:
    return (
        F.when((train == "yes") | railway.isin("station", "halt"), "train")
        .when(tram == "yes", "tram")
        .when(bus == "yes", "bus")
        .when(railway == "tram_stop", "tram")
        .otherwise("bus")
    )


def transport_type(public_transport: Column, mode: Column) -> Column:
    return F.when(public_transport == "station", "train_station").when(mode == "tram", "tram_stop").otherwise("bus_stop")


def character(pct_built: Column, buildings: Column) -> Column:
    share, count = F.coalesce(pct_built, F.lit(0.0)), F.coalesce(buildings, F.lit(0))
    return (
        F.when((share > 0.6) | (count > 200), "urban").when((share > 0.35) | (count > 80), "suburban").when((share > 0.15) | (count > 20), "transitional").otherwise("peripheral")
    )


def present(*items: Column) -> Column:
    """The non-null items in their order."""
    return F.array_compact(F.array(*items))


def strengths(quiet: Column, nature: Column, school: Column, stop: Column, shop: Column) -> Column:
    quiet, nature = F.coalesce(quiet, F.lit(50)), F.coalesce(nature, F.lit(50))
    return present(
        F.when(quiet > 80, "Bardzo cicha okolica"),
        F.when(nature > 70, "Blisko natury (las, woda)"),
        F.when(school < 1000, "Szkoła w pobliżu"),
        F.when(stop < 500, "Dobra komunikacja publiczna"),
        F.when(shop < 500, "Sklepy na miejscu"),
    )


def weaknesses(quiet: Column, nature: Column, school: Column, stop: Column, shop: Column) -> Column:
    quiet, nature = F.coalesce(quiet, F.lit(50)), F.coalesce(nature, F.lit(50))
    return present(
        F.when(quiet < 40, "Głośna okolica"),
        F.when(nature < 30, "Brak terenów zielonych w okolicy"),
        F.when(school.isNull() | (school > 2000), "Daleko do szkoły"),
        F.when(stop.isNull() | (stop > 1000), "Słaba komunikacja publiczna"),
        F.when(shop.isNull() | (shop > 1500), "Brak sklepów w okolicy"),
    )


def ideal_for(kind: Column, strong: Column) -> Column:
    """The nature line compares with a shorter label than is stored, so it never fires; kept as the rule states it."""
    uses = present(
        F.when(kind == "peripheral", "Miłośnicy ciszy i spokoju").when(kind == "suburban", "Rodziny z dziećmi"),
        F.when(F.array_contains(strong, "Szkoła w pobliżu"), "Rodziny z dziećmi w wieku szkolnym"),
        F.when(F.array_contains(strong, "Blisko natury"), "Miłośnicy natury i aktywnego wypoczynku"),
        F.when(F.array_contains(strong, "Dobra komunikacja publiczna"), "Osoby dojeżdżające do pracy"),
        F.when(F.array_contains(strong, "Bardzo cicha okolica"), "Osoby pracujące zdalnie"),
    )
    return F.when(F.size(uses) > 0, uses).otherwise(F.array(F.lit("Wszyscy szukający działki w tej okolicy")))


def funnel_stage(contact: Column, selected: Column, favorites: Column, results: Column, discovery: Column) -> Column:
    return (
        F.when(contact, "CONVERTED").when(selected, "NEGOTIATION").when(favorites > 0, "EVALUATION").when(results, "SEARCH").when(discovery, "DISCOVERY").otherwise("NEW")
    )


def confidence_band(similarity: Column) -> Column:
    return F.when(similarity > 0.9, "HIGH").when(similarity > 0.8, "MEDIUM").otherwise("LOW")


def contains_any(text: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


def key_moments(budget: Column, location: Column, schools: Column, quiet: Column, nature: Column, favorites: Column, contact: Column) -> Column:
    return present(
        F.when(budget > 0, F.format_string("Budżet: %dk zł", F.floor(budget / 1000).cast("bigint"))),
        F.when(location.isNotNull(), F.concat(F.lit("Preferowana lokalizacja: "), location)),
        F.when(schools, "Ma dzieci - ważne szkoły"),
        F.when(quiet > 0.7, "Priorytet: cisza"),
        F.when(nature > 0.7, "Priorytet: bliskość natury"),
        F.when(F.size(favorites) > 0, F.concat(F.lit("Polubione działki: "), F.array_join(F.slice(favorites, 1, 3), ", "))),
        F.when(contact, "Kontakt zostawiony"),
    )


def dominant_profile(quiet: Column, nature: Column, access: Column, area: Column) -> Column:
    """Largest of four scores; ties go to the first listed."""
    values = {
        "quiet": F.coalesce(quiet, F.lit(0)).cast("double"),
        "green": F.coalesce(nature, F.lit(0)).cast("double"),
        "accessible": F.coalesce(access, F.lit(0)).cast("double"),
        "spacious": F.least(F.lit(100.0), F.coalesce(area, F.lit(0)) / 20),
    }
    top = F.greatest(*values.values())
    return F.coalesce(*[F.when(v == top, name) for name, v in values.items()])
