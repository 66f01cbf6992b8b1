"""A PySpark-native engine for querying gridded ocean and seabed data."""

from seagrid.operators.raster import GridSpec
from seagrid.sources.config import SourceOption
from seagrid.sources.field import Field, Layout
from seagrid.sources.registry import OceanGrids, SourceState

__all__ = ["Field", "GridSpec", "Layout", "OceanGrids", "SourceOption", "SourceState"]
