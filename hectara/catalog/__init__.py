"""All registered queries, one module per section of the operator inventory."""
from importlib import import_module

SECTIONS = [
    "sources_and_sinks",
    "filters",
    "geometry",
    "spatial_joins",
    "key_joins",
    "aggregates",
    "ranking",
    "scoring",
    "labels",
    "texts",
    "graphs",
    "vectors",
    "matching",
    "streams",
]


def load():
    for section in SECTIONS:
        import_module(f"hectara.catalog.{section}")
    return import_module("hectara.catalog.registry")
