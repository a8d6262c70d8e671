"""Scores and normalisers as Column expressions. Rounding is half-even."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, places: int = 0) -> Column:
    """Round half to even the way the table stages do: scaled, rounded and scaled back."""
    return F.rint(c) if places == 0 else F.rint(c * 10**places) / 10**places


def capped(distance: Column, cap: float, missing: float | None = None) -> Column:
    return F.least(F.greatest(F.coalesce(distance, F.lit(cap if missing is None else missing)).cast("double"), F.lit(0.0)), F.lit(float(cap)))


def closeness(distance: Column, cap: float) -> Column:
    return 1 - capped(distance, cap) / cap


def quietness(industrial: Column, main_road: Column) -> Column:
    return half_even(capped(industrial, 5000) / 5000 * 50 + capped(main_road, 3000) / 3000 * 50).cast("int")


def nature(forest: Column, water: Column, pct_forest: Column) -> Column:
    return half_even(closeness(forest, 5000) * 40 + closeness(water, 5000) * 30 + capped(pct_forest, 50, 0) / 50 * 30).cast("int")


def accessibility(bus: Column, school: Column, shop: Column, pharmacy: Column) -> Column:
    return half_even(
        closeness(bus, 3000) * 30 + closeness(school, 3000) * 25 + closeness(shop, 2000) * 25 + closeness(pharmacy, 3000) * 20
    ).cast("int")


def unit_distance(d: Column, cap: float = 5000) -> Column:
    return F.when(d.isNull() | (d < 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.least(d, F.lit(cap)) / cap))


def unit_score(s: Column) -> Column:
    return F.when(s.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / 100.0)))


def unit_percent(p: Column) -> Column:
    return F.when(p.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / 100.0)))


def unit_area(a: Column, low: float = 100, high: float = 10000) -> Column:
    log = F.log10(F.greatest(F.lit(low), F.least(a, F.lit(high))))
    return F.when(a.isNull() | (a <= 0), 0.5).otherwise((log - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))))


def unit_count(n: Column, cap: float = 500) -> Column:
    return F.when(n.isNull() | (n < 0), 0.0).otherwise(F.least(F.lit(1.0), n / cap))


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def feature_vector() -> Column:
    """The 32 numbers that describe a parcel, in their fixed order."""
    c = F.col
    water = F.coalesce(c("nearest_water_type"), F.lit(""))
    return F.array(
        unit_score(c("quietness_score")),
        unit_score(c("nature_score")),
        unit_score(c("accessibility_score")),
        *[
            unit_distance(c(f"dist_to_{name}"), cap)
            for name, cap in [
                ("school", 3000), ("bus_stop", 1000), ("forest", 2000), ("water", 2000),
                ("sea", 10000), ("river", 3000), ("lake", 5000), ("main_road", 2000),
            ]
        ],
        unit_percent(c("pct_forest_500m")),
        unit_percent(c("pct_water_500m")),
        unit_count(c("count_buildings_500m"), 500),
        unit_area(c("area_m2")),
        F.least(F.lit(1.0), F.coalesce(F.when(c("shape_index") != 0, c("shape_index")), F.lit(1.0)) / 3.0),
        flag(c("is_residential_zone")),
        flag(c("has_pog")),
        flag(c("is_built")),
        unit_percent(c("building_coverage_pct")),
        *[flag(water == w) for w in ("morze", "jezioro", "rzeka", "kanal", "staw", "zatoka")],
        *[
            unit_distance(c(f"dist_to_{name}"), cap)
            for name, cap in [("supermarket", 2000), ("pharmacy", 3000), ("kindergarten", 2000), ("restaurant", 2000), ("industrial", 1000)]
        ],
        (unit_distance(c("dist_to_sea"), 1000) + unit_percent(c("pct_forest_500m")) + unit_score(c("quietness_score"))) / 3.0,
    )


def preference_vector(quiet: Column, nature_: Column, access: Column, size: Column) -> Column:
    """Four blocks of eight, alternating sign, falling 1, .9, .8, .7, scaled to unit length."""
    items = [
        F.coalesce(w.cast("double"), F.lit(0.0)) * ((1 if i % 2 == 0 else -1) * (1.0 - 0.1 * (i % 4)))
        for w in (quiet, nature_, access, size)
        for i in range(8)
    ]
    raw = F.array(*items)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(raw, lambda v: v / norm)).otherwise(raw)


def decay(distance: Column, ideal: Column | float, scale: Column | float) -> Column:
    """0 when unknown, 1 up to the ideal distance, then exponential fall."""
    ideal = ideal if isinstance(ideal, Column) else F.lit(ideal)
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return F.when(distance.isNull(), 0.0).when(distance <= ideal, 1.0).otherwise(F.exp(-(distance - ideal) / scale))


def shape_term(shape_index: Column, aspect_ratio: Column) -> Column:
    compact = F.when(shape_index.isNull(), 0.3).when(shape_index >= 0.7, 1.0).when(shape_index >= 0.4, 0.6).otherwise(0.2)
    slim = F.when(aspect_ratio.isNull(), 0.3).when(aspect_ratio <= 2.0, 1.0).when(aspect_ratio <= 4.0, 0.6).otherwise(0.2)
    return (compact * 0.5 + slim * 0.5) * 0.08


def transport_score(nearest_stop: Column, fallback: Column) -> Column:
    d = F.coalesce(nearest_stop, fallback, F.lit(1000))
    return F.when(d < 200, 95).when(d < 500, 80).when(d < 800, 60).when(d < 1200, 40).otherwise(20)


def amenities_score(shop: Column, school: Column) -> Column:
    shops = F.when(shop < 500, 20).when(shop < 1000, 10).otherwise(0)
    schools = F.when(school < 1000, 20).when(school < 2000, 10).otherwise(0)
    return F.least(F.lit(50) + shops + schools, F.lit(100))


def engagement(sessions: Column, searches: Column, intents: Column) -> Column:
    return F.least(
        F.least(sessions * 0.1, F.lit(0.3)) + F.least(searches * 0.05, F.lit(0.2)) + F.least(intents * 0.1, F.lit(0.5)), F.lit(1.0)
    )


# Weight of each funnel signal.
FUNNEL_SIGNALS = [
    ("discovery_started", 0.1),
    ("location_collected", 0.1),
    ("budget_collected", 0.15),
    ("results_shown", 0.1),
    ("many_shown", 0.1),
    ("has_favorites", 0.15),
    ("details_requested", 0.1),
    ("map_viewed", 0.05),
    ("property_selected", 0.2),
    ("price_discussed", 0.1),
]


def funnel_score(flags: dict[str, Column]) -> Column:
    """Weights are added in hundredths so that band limits are met exactly."""
    total = sum((F.when(flags[name], int(round(w * 100))).otherwise(0) for name, w in FUNNEL_SIGNALS), F.lit(0))
    return F.least(total, F.lit(100)) / 100


def engagement_level(score: Column) -> Column:
    return F.when(score >= 0.7, "hot").when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")


def price_text(p: Column) -> Column:
    return F.when(p >= 1_000_000, F.concat(F.call_function("format_number", p / 1_000_000, F.lit("0.00")), F.lit(" mln zł"))).otherwise(F.format_string("%dk zł", F.floor(p / 1000).cast("bigint")))
