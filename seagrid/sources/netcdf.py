"""A Spark data source for classic NetCDF grids.

``spark.read.format("ncgrid")`` with the options ``path``, ``variable``,
``latitude``, ``longitude``, ``depth`` and ``pattern`` yields the raw cells in rows
of one latitude. With a pattern there is a file a month; comparisons of ``month``,
``depth_i``, ``lat_i`` and ``lon_block`` with constants leave out files, depths,
latitudes and blocks, which are then never read. Files must be visible to the
executors under their path; every task opens them itself.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from seagrid.functions.timefile import resolve_file
from seagrid.schema import CELLS, LON_BLOCK
from seagrid.sources.field import cell_rows, grid_view

#: A task reads about so many values.
PARTITION_VALUES = 8 << 20


class Slab(InputPartition):
    def __init__(self, path: str, month: int, depth_i: int, lats: list[int], blocks: list[int]):
        self.path, self.month, self.depth_i, self.lats, self.blocks = path, month, depth_i, lats, blocks


#: Comparisons that leave out files, depths, latitudes and blocks.
TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
}


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k: options.get(k) for k in ("path", "variable", "latitude", "longitude", "depth", "pattern")}
        self.options["latitude"] = self.options["latitude"] or "lat"
        self.options["longitude"] = self.options["longitude"] or "lon"
        self.wanted: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute[0] in ("month", "depth_i", "lat_i", "lon_block"):
                self.wanted.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _asked(self, column: str, values) -> list[int]:
        return [x for x in values if all(TESTS[kind](x, value) for name, kind, value in self.wanted if name == column)]

    def _view(self, path: str):
        return grid_view(path, self.options["variable"], self.options["latitude"], self.options["longitude"], self.options["depth"])

    def partitions(self):
        out = []
        for month in self._asked("month", range(1, 13) if (self.options["pattern"] or "").strip() else [0]):
            path = resolve_file(self.options["path"], self.options["pattern"], month)
            if month and not os.path.isfile(path):
                continue
            depths, lats, lons = self._view(path).shape
            blocks = self._asked("lon_block", range(-(-lons // LON_BLOCK)))
            asked = self._asked("lat_i", range(lats))
            step = max(1, PARTITION_VALUES // (max(1, len(blocks)) * min(LON_BLOCK, max(1, lons))))
            out += [Slab(path, month, d, asked[a : a + step], blocks) for d in self._asked("depth_i", range(depths)) for a in range(0, len(asked), step) if blocks]
        return out

    def read(self, partition: Slab):
        if partition is not None:
            yield from cell_rows(self._view(partition.path), partition.month, partition.depth_i, partition.lats, partition.blocks)


class GridDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ncgrid"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return GridReader(dict(self.options))


def read_cells(spark: SparkSession, path: str, variable: str, *, latitude: str = "lat", longitude: str = "lon", depth: str | None = None, pattern: str | None = None) -> DataFrame:
    """The cells of a grid file, or of a folder of monthly files; month 0 stands for any month."""
    spark.dataSource.register(GridDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"path": path, "variable": variable, "latitude": latitude, "longitude": longitude, "depth": depth, "pattern": pattern}
    return spark.read.format("ncgrid").options(**{k: v for k, v in options.items() if v is not None}).load()
