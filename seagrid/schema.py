"""Schemas and value sets of the data model."""

from __future__ import annotations

#: Kinds of environment data, formats, source states and sampling modes.
ENVIRONMENT_TYPES = ("Bathymetry", "Temperature", "Salinity", "Current", "Turbidity", "Seabed", "BurialRate", "ContactDensity", "SeabedRoughness", "Unknown")
FORMATS = ("NetCdf",)
STATUSES = ("NotInitialized", "Ready", "Disabled", "FileNotFound", "InvalidConfiguration", "NativeLibraryUnavailable", "Error")
SAMPLINGS = ("Nearest",)

SOURCE_OPTION = (
    "id string, type string, format string, enabled boolean, path string, file_pattern string, variable string, latitude_variable string, "
    "longitude_variable string, depth_variable string, time_variable string, unit string, dimension_map map<string,string>, metadata map<string,string>"
)
SOURCE_STATE = "id string, type string, status string, message string"
POINT_QUERY = "query_id long, latitude double, longitude double, depth double, date_time timestamp_ntz, sampling string"
#: Raw values along longitude for one latitude and depth, in blocks of longitudes.
CELLS = "month int, depth_i int, lat_i int, lon_block int, values array<double>"
#: Longitudes in one row of CELLS.
LON_BLOCK = 4096
