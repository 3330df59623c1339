"""Spatial expression analytics on Spark DataFrames."""

from tessera.model import SpatialData

__all__ = ["SpatialData"]
