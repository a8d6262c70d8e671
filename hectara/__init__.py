"""Spatial feature building, scoring and search over land parcels, as PySpark DataFrame operators."""
