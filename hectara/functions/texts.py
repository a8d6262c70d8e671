"""Text helpers as Column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hectara.functions import constants as C
from hectara.functions.labels import contains_any, present


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[ -]", "_")


def fold_city(text: Column) -> Column:
    return F.translate(F.lower(text), "ńó", "no")


def joined(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, "|"))


def profile_code(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"KPT-MPZP-(\w+)", 1), F.lit(""))


def clean_location(text: Column) -> Column:
    """Lower-case, trimmed, with the listed prefixes taken off one after the other."""
    out = F.trim(F.lower(text))
    for prefix in C.LOCATION_PREFIXES:
        out = F.trim(F.regexp_replace(out, "^" + re.escape(prefix), ""))
    return out


def declension_variants(text: Column) -> Column:
    """The text and its nominative guesses, in trying order."""
    n = F.length(text)
    return F.array_distinct(
        present(
            text,
            F.when(text.endswith("a"), F.substring(text, F.lit(1), n - 1)),
            F.when(text.endswith("i"), F.concat(F.substring(text, F.lit(1), n - 1), F.lit("a"))),
            F.when(text.endswith("u"), F.substring(text, F.lit(1), n - 1)),
            F.when(text.endswith("ej"), F.concat(F.substring(text, F.lit(1), n - 2), F.lit("a"))),
        )
    )


def metres(template: str, value: Column) -> Column:
    return F.format_string(template, value.cast("int"))


def description(with_spaces_between: str = " ") -> Column:
    """Sentence description of a parcel from its attributes."""
    c = F.col
    size_words = {"mala": "mała", "pod_dom": "idealna pod dom", "duza": "duża", "bardzo_duza": "bardzo duża"}
    owner_lines = {
        "prywatna": "Własność prywatna - można kupić.",
        "publiczna": "Własność publiczna.",
        "spoldzielcza": "Własność spółdzielcza.",
        "koscielna": "Własność kościelna.",
    }
    water_words = {"morze": "morza", "jezioro": "jeziora", "rzeka": "rzeki", "kanal": "kanału", "staw": "stawu"}
    density_lines = {
        "bardzo_rzadka": "Bardzo rzadka zabudowa w okolicy - dużo przestrzeni.",
        "rzadka": "Rzadka zabudowa - spokojna okolica.",
        "umiarkowana": "Umiarkowana gęstość zabudowy.",
        "gesta": "Gęsta zabudowa w okolicy.",
    }

    def word(values: dict, key: Column) -> Column:
        return F.create_map([F.lit(v) for pair in values.items() for v in pair])[key]

    quiet, nature, access = c("quietness_score"), c("nature_score"), c("accessibility_score")
    water = F.coalesce(word(water_words, c("nearest_water_type")), F.lit("wody"))
    near_water = F.when(c("nearest_water_type").isNotNull() & (c("dist_to_water") > 0), c("dist_to_water"))
    return F.array_join(
        present(
            F.concat(F.lit("Działka w "), F.coalesce(c("dzielnica"), F.lit("nieznana dzielnica")), F.lit(", "), F.coalesce(c("gmina"), F.lit("")), F.lit(".")),
            F.when(c("area_m2") > 0, F.format_string("Powierzchnia %d m² (%s).", c("area_m2"), F.coalesce(word(size_words, c("size_category")), F.lit("")))),
            word(owner_lines, c("typ_wlasnosci")),
            F.when(c("is_built"), F.concat(F.lit("Zabudowana - "), F.coalesce(c("building_type"), F.lit("budynek")), F.lit("."))).otherwise("Niezabudowana - wolna pod budowę."),
            F.when(quiet.isNull(), None)
            .when(c("kategoria_ciszy") == "bardzo_cicha", metres("Bardzo cicha okolica (cisza %d/100).", quiet))
            .when(c("kategoria_ciszy") == "cicha", metres("Cicha okolica (cisza %d/100).", quiet))
            .when(c("kategoria_ciszy") == "umiarkowana", "Umiarkowany poziom hałasu.")
            .otherwise("Głośna okolica - blisko drogi głównej."),
            F.when(nature.isNull(), None)
            .when(c("kategoria_natury") == "bardzo_zielona", metres("Bardzo zielona okolica, blisko natury (natura %d/100).", nature))
            .when(c("kategoria_natury") == "zielona", "Zielona okolica z dostępem do natury.")
            .when(c("kategoria_natury") == "umiarkowana", "Umiarkowanie zielona okolica.")
            .otherwise("Zurbanizowana okolica."),
            F.when(access.isNull(), None)
            .when(access >= 70, "Doskonała dostępność komunikacyjna i usług.")
            .when(access >= 50, "Dobra dostępność usług.")
            .when(access >= 30, "Umiarkowana dostępność.")
            .otherwise("Ograniczona dostępność - spokojne przedmieścia."),
            F.when(near_water < 500, F.format_string("Blisko %s (%dm).", water, near_water)).when(near_water < 1000, F.format_string("W pobliżu %s (%dm).", water, near_water)),
            F.when(c("dist_to_forest") < 200, metres("Bezpośrednio przy lesie (%dm).", c("dist_to_forest"))).when(c("dist_to_forest") < 500, metres("Blisko lasu (%dm).", c("dist_to_forest"))),
            F.when(c("dist_to_school") < 500, metres("Szkoła w zasięgu spaceru (%dm).", c("dist_to_school"))).when(c("dist_to_school") < 1000, metres("Szkoła w pobliżu (%dm).", c("dist_to_school"))),
            F.when(c("dist_to_bus_stop") < 300, metres("Przystanek autobusowy bardzo blisko (%dm).", c("dist_to_bus_stop"))).when(c("dist_to_bus_stop") < 500, metres("Dobry dostęp do komunikacji (%dm do przystanku).", c("dist_to_bus_stop"))),
            F.when(c("pog_symbol").isNull(), None)
            .when(c("is_residential_zone"), F.concat(F.lit("Strefa "), c("pog_symbol"), F.lit(" - przeznaczona pod zabudowę mieszkaniową.")))
            .otherwise(F.concat(F.lit("Strefa planistyczna "), c("pog_symbol"), F.lit("."))),
            word(density_lines, c("gestosc_zabudowy")),
        ),
        with_spaces_between,
    )


def thousands(n: Column) -> Column:
    return F.regexp_replace(F.format_number(n.cast("bigint"), 0), ",", " ")


def match_reason(priorities: list[str]) -> Column:
    """Why a parcel fits the wishes."""
    c = F.col

    def asked(*words: str) -> Column:
        return F.lit(any(w in priorities for w in words))

    quiet, nature, access = (F.coalesce(c(n), F.lit(0)) for n in ("quietness_score", "nature_score", "accessibility_score"))
    parts = present(
        F.when(~asked("quiet", "cicha"), None).when(quiet >= 85, metres("bardzo cicha okolica (%d/100)", quiet)).when(quiet >= 70, metres("cicha okolica (%d/100)", quiet)),
        F.when(~asked("nature", "las", "zielona"), None)
        .when((c("dist_to_forest") > 0) & (c("dist_to_forest") < 200), metres("las w %dm", c("dist_to_forest")))
        .when(nature >= 70, metres("zielona okolica (%d/100)", nature)),
        F.when(asked("accessible", "dojazd") & (access >= 70), metres("dobry dojazd (%d/100)", access)),
        F.when(asked("duza", "spacious") & (c("area_m2") >= 1500), metres("duża działka (%dm²)", c("area_m2"))),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("dopasowanie do kryteriów")


def surprise(priorities: list[str]) -> Column:
    """The first good thing nobody asked for."""
    c = F.col

    def unasked(*words: str) -> Column:
        return F.lit(not any(w in priorities for w in words))

    return F.coalesce(
        F.when(unasked("quiet", "cicha") & (c("quietness_score") >= 85), "wyjątkowo cicha okolica"),
        F.when(unasked("nature", "las") & (c("dist_to_forest") > 0) & (c("dist_to_forest") < 200), "las tuż obok"),
        F.when(c("pog_maks_wysokosc_m") > 12, F.format_string("można wybudować %d piętra", F.floor(c("pog_maks_wysokosc_m") / 3).cast("int"))),
        F.when(unasked("szkola", "school") & (c("dist_to_school") > 0) & (c("dist_to_school") < 500), metres("szkoła w %dm", c("dist_to_school"))),
        F.when(c("under_construction") > 0, "okolica się rozwija"),
        F.when(unasked("woda", "water") & (c("dist_to_water") > 0) & (c("dist_to_water") < 300), metres("woda w %dm", c("dist_to_water"))),
    )


PROFILE_WORDS = {"quiet": "cichsza", "green": "bardziej zielona", "accessible": "lepszy dojazd", "spacious": "większa"}


def difference(new: str, old: str) -> Column:
    """How a proposal differs from the reference; new and old are column prefixes."""
    c = lambda n: F.col(new + n)
    o = lambda n: F.col(old + n)
    gap = F.coalesce(c("area_m2"), F.lit(0)) - F.coalesce(o("area_m2"), F.lit(0))
    profile = F.create_map([F.lit(v) for pair in PROFILE_WORDS.items() for v in pair])[c("profile")]
    parts = present(
        F.when(~c("dzielnica").eqNullSafe(o("dzielnica")), F.concat(F.lit("inna dzielnica: "), F.coalesce(c("dzielnica"), F.lit("None"))))
        .when(~c("miejscowosc").eqNullSafe(o("miejscowosc")), F.concat(F.lit("inna miejscowość: "), F.coalesce(c("miejscowosc"), F.lit("None")))),
        F.when(c("profile") != o("profile"), profile),
        F.when(gap >= 200, metres("+%dm² większa", gap)).when(gap <= -200, metres("%dm² mniejsza", gap)),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("alternatywna opcja")


def display_line(index: Column, label: Column, reason: Column) -> Column:
    c = F.col
    metrics = present(
        F.when(c("area_m2") > 0, F.concat(F.lit("📐 "), thousands(c("area_m2")), F.lit(" m²"))),
        F.when(c("dist_to_forest") > 0, metres("🌲 Las: %dm", c("dist_to_forest"))),
        F.when(c("quietness_score") > 0, metres("🔇 Cisza: %d/100", c("quietness_score"))),
        F.when((c("dist_to_school") > 0) & (c("dist_to_school") < 1000), metres("🏫 Szkoła: %dm", c("dist_to_school"))),
    )
    place = F.coalesce(c("dzielnica"), c("miejscowosc"), c("gmina"), F.lit("Nieznana"))
    head = F.concat(F.lit("**"), index.cast("string"), F.lit(". "), place, F.lit("** ("), label, F.lit(")"))
    return F.array_join(present(head, F.when(F.size(metrics) > 0, F.array_join(metrics, " | ")), F.concat(F.lit("→ "), reason)), "\n")


def highlights(wants: set[str] = frozenset(), forest_m: int | None = None, water_m: int | None = None, school_m: int | None = None, shop_m: int | None = None) -> Column:
    """At most two short lines on why a result fits. wants: quiet, nature, access, road."""
    c = F.col
    quiet, nature, access = c("quietness_score"), c("nature_score"), c("accessibility_score")
    road = F.lit("road" in wants) & (c("dist_to_main_road") < 50)

    def within(column: str, limit: int | None, text: str) -> Column:
        return F.when((c(column) > 0) & (c(column) <= limit), metres(text, c(column))) if limit else F.lit(None).cast("string")

    forest = F.when(c("dist_to_forest") < 300, metres("Las: %dm", c("dist_to_forest")))
    lines = present(
        F.when(quiet >= (75 if "quiet" in wants else 85), metres("Cisza: %d/100", quiet)),
        F.when(nature >= (60 if "nature" in wants else 70), metres("Natura: %d/100", nature)),
        F.coalesce(forest, within("dist_to_forest", forest_m, "Las: %dm")),
        within("dist_to_water", water_m, "Woda: %dm"),
        F.when(access >= (70 if "access" in wants else 80), metres("Dostępność: %d/100", access)),
        within("dist_to_school", school_m, "Szkoła: %dm"),
        within("dist_to_supermarket", shop_m, "Sklep: %dm"),
        F.when(road, "Dostęp do drogi"),
        F.when(c("has_pog"), F.coalesce(F.concat(F.lit("MPZP: "), c("pog_symbol")), F.lit("Ma MPZP"))),
    )
    return F.slice(lines, 1, 2)


def short_label() -> Column:
    c = F.col
    return F.array_join(present(F.coalesce(c("miejscowosc"), c("gmina")), F.when(c("area_m2") > 0, F.concat(thousands(c("area_m2")), F.lit(" m²")))), ", ")


def card_summary() -> Column:
    c = F.col
    names = {"morze": "Morze", "zatoka": "Zatoka", "rzeka": "Rzeka", "jezioro": "Jezioro", "kanal": "Kanał", "staw": "Staw"}
    water = F.create_map([F.lit(v) for pair in names.items() for v in pair])[c("nearest_water_type")]
    distance = F.when(c("nearest_water_type") == "morze", c("dist_to_sea")).otherwise(c("dist_to_water"))
    return present(
        F.concat(F.lit("Lokalizacja: "), c("miejscowosc"), F.lit(", "), c("gmina")),
        F.when(c("area_m2") > 0, F.concat(F.lit("Powierzchnia: "), F.format_number(c("area_m2").cast("bigint"), 0), F.lit(" m²"))),
        F.when(~c("is_built"), "Niezabudowana").when(c("building_count") > 0, F.format_string("Zabudowana (%d bud.)", c("building_count"))).otherwise("Zabudowana"),
        F.when(c("quietness_score").isNotNull(), F.format_string("Cisza: %d/100 (%s)", c("quietness_score"), c("kategoria_ciszy"))),
        F.when(c("nature_score").isNotNull(), F.format_string("Natura: %d/100 (%s)", c("nature_score"), c("kategoria_natury"))),
        F.when(c("accessibility_score").isNotNull(), F.format_string("Dostępność: %d/100 (%s)", c("accessibility_score"), c("kategoria_dostepu"))),
        F.when(water.isNotNull() & (distance > 0), F.format_string("Woda: %s (%dm)", water, distance)),
    )


def search_text(miejscowosc: Column, gmina: Column, quiet_cats: Column, nature_cats: Column, build_status: Column, ownership: Column) -> Column:
    """Query sentence from wishes when no text is given."""
    parts = present(
        F.concat(F.lit("Działka w "), F.coalesce(miejscowosc, gmina)),
        F.when(F.arrays_overlap(quiet_cats, F.array(F.lit("bardzo_cicha"), F.lit("cicha"))), "cicha spokojna okolica"),
        F.when(F.arrays_overlap(nature_cats, F.array(F.lit("bardzo_zielona"), F.lit("zielona"))), "blisko natury lasu zieleni"),
        F.when(build_status == "niezabudowana", "niezabudowana pod budowę domu"),
        F.when(ownership == "prywatna", "prywatna do kupienia"),
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, ". ")).otherwise("działka budowlana pod dom")


def budget(text: Column) -> Column:
    """First matching pattern wins; small numbers are thousands."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in C.BUDGET_PATTERNS]).try_cast("bigint")
    return F.when(found < 10000, found * 1000).otherwise(found)


def plot_size(text: Column) -> Column:
    """First pattern whose number lies in 100..10000."""

    def hit(p):
        n = F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("bigint")
        return F.when(n.between(100, 10000), n)

    return F.coalesce(*[hit(p) for p in C.SIZE_PATTERNS])


def preference(text: Column, dimension: str) -> Column:
    """Largest weight among the words of one dimension found in the text."""
    return F.greatest(*[F.when(text.contains(w), v) for w, d, v in C.PREFERENCE_WORDS if d == dimension], F.lit(None).cast("double"))


def hints(text: Column) -> Column:
    return F.array_distinct(present(*[F.when(text.contains(w), m) for w, m in C.HINT_WORDS]))


def rule_facts(text: Column) -> Column:
    """array<struct<kind, value>> of the rules that fire on a lower-cased message."""
    return present(*[F.when(contains_any(text, words), F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"))) for kind, value, words in C.FACT_RULES])


def intent(text: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(text, words), name) for name, words in C.INTENT_RULES], F.lit("general"))


def feedback_choice(text: Column) -> Column:
    return F.coalesce(*[F.when(contains_any(text, words), i) for i, words in C.CHOICE_WORDS])


def liked_features(text: Column) -> Column:
    return F.array_distinct(present(*[F.when(text.contains(w), f) for w, f in C.LIKED_WORDS]))


def listed(text: Column, rules) -> Column:
    return present(*[F.when(contains_any(text, words), name) for name, words in rules])
