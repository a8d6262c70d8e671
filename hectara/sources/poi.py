"""Points of interest: one schema for all sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hectara.functions.labels import education_type, transport_mode, transport_type

POI_COLUMNS = [
    "source", "source_id", "category", "type", "subtype", "name", "brand", "address_street", "address_number", "address_city",
    "phone", "website", "opening_hours", "network", "operator", "transport_mode",
]
# Open-map tag behind each unified column.
TAG_COLUMNS = {
    "name": "name", "brand": "brand", "address_street": "addr:street", "address_number": "addr:housenumber", "address_city": "addr:city",
    "phone": "phone", "website": "website", "opening_hours": "opening_hours", "operator": "operator",
}
SINGLE_SOURCE = {"health": ("amenity", "healthcare:speciality"), "shop": ("shop", None), "gastro": ("amenity", "cuisine")}


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def unified(df: DataFrame, category: str, source: str = "osm", **given: Column) -> DataFrame:
    """Project any tagged table to the common columns; missing ones become null. x and y are kept when present."""
    values = {c: _optional(df, tag) for c, tag in TAG_COLUMNS.items()}
    values |= {"source": F.lit(source), "category": F.lit(category), "source_id": _optional(df, "osm_id")} | given
    coordinates = [F.col(c) for c in ("x", "y") if c in df.columns]
    return df.select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in POI_COLUMNS], *coordinates)


def single_source(df: DataFrame, category: str) -> DataFrame:
    """Health, shop and food points."""
    kind, subtype = SINGLE_SOURCE[category]
    return unified(df, category, type=_optional(df, kind), subtype=_optional(df, subtype) if subtype else F.lit(None).cast("string"))


def education(df: DataFrame) -> DataFrame:
    kind, subtype = education_type(_optional(df, "amenity"))
    return unified(df, "education", type=kind, subtype=subtype)


def transport(df: DataFrame) -> DataFrame:
    """Platforms and stations only."""
    place = _optional(df, "public_transport")
    mode = transport_mode(_optional(df, "train"), _optional(df, "railway"), _optional(df, "tram"), _optional(df, "bus"))
    kept = df.filter(place.isin("platform", "station"))
    return unified(kept, "transport", type=transport_type(place, mode), transport_mode=mode, network=_optional(df, "network"))
