"""The source registry and query API.

Sources are keyed without regard to case. The registry is small driver state; only
queries build plans. A source is probed once, when it is registered.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seagrid.errors import EngineClosed, SourceNotReady, SourceNotRegistered
from seagrid.operators import points as point_ops
from seagrid.operators import raster as raster_ops
from seagrid.schema import SOURCE_OPTION, SOURCE_STATE
from seagrid.functions.timefile import month_or_now, resolve_file
from seagrid.sources.classic import ClassicFile, UnsupportedFlavour
from seagrid.sources.config import SourceOption, load_catalog, resolve_source_path
from seagrid.sources.field import Field, read_layout, same_layout
from seagrid.sources.netcdf import read_cells


@dataclass(frozen=True)
class SourceState:
    id: str
    type: str
    status: str
    message: str | None = None


def probe(option: SourceOption, path: str, now: datetime) -> SourceState:
    """The state of a source: its file of the current month must open and hold all its variables."""
    state = lambda status, message=None: SourceState(option.id, option.type, status, message)
    if not option.enabled:
        return state("Disabled")
    try:
        file = resolve_file(path, option.file_pattern, now.month)
        if not os.path.isfile(file):
            return state("FileNotFound", file)
        opened = ClassicFile(file)
        for name in (option.variable, option.latitude_variable, option.longitude_variable, option.depth_variable):
            if (name or "").strip():
                opened.variable(name)
        return state("Ready")
    except UnsupportedFlavour as e:
        return state("NativeLibraryUnavailable", str(e))
    except Exception as e:  # any failure of a probe is the source's state
        return state("Error", str(e))


def successful(states: DataFrame) -> DataFrame:
    """One row: whether all sources are ready or disabled (true without sources)."""
    return states.agg(F.coalesce(F.bool_and(F.col("status").isin("Ready", "Disabled")), F.lit(True)).alias("success"))


def last_definitions(options: DataFrame, position: str = "position") -> DataFrame:
    """Of definitions whose ids differ in case only, the last one."""
    order = Window.partitionBy(F.lower("id")).orderBy(F.desc(position))
    return options.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def default_source(states: DataFrame) -> DataFrame:
    """The first ready source by id, or else the first of all."""
    return states.orderBy((F.col("status") != "Ready").cast("int"), "id").limit(1)


class OceanGrids:
    """Registered grids and the queries over them; a context manager."""

    def __init__(self, spark: SparkSession, clock: Callable[[], datetime] = datetime.now):
        self.spark, self.clock = spark, clock
        self._lock = threading.RLock()
        self._sources: dict[str, tuple[SourceOption, str, SourceState]] = {}
        self._closed = False

    def __enter__(self) -> OceanGrids:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        with self._lock:
            self._sources.clear()
            self._closed = True

    def _open(self) -> None:
        if self._closed:
            raise EngineClosed("the engine is closed")

    @staticmethod
    def _named(source_id: str | None) -> str:
        if not (source_id or "").strip():
            raise ValueError("a source id is required")
        return source_id.lower()

    # Registry

    def initialize(self, catalog_path: str | None = None) -> tuple[list[SourceState], bool]:
        """Replace all sources by those of a catalog document; returns their states and success.

        Without a path, ``seagrid.json`` in the working directory is read. A document
        that can't be read leaves the registry as it was.
        """
        self._open()
        path = "seagrid.json" if catalog_path is None else catalog_path
        document = load_catalog(path)
        with self._lock:
            self._sources.clear()
            for option in document.sources:
                self._put(option, resolve_source_path(option.path, path))
            states = self.states()
        return states, all(s.status in ("Ready", "Disabled") for s in states)

    def load_source(self, option: SourceOption) -> SourceState:
        """Register or replace a source; a relative path starts from the working directory."""
        if option is None:
            raise ValueError("a source definition is required")
        self._open()
        with self._lock:
            return self._put(option, os.path.abspath(option.path))

    reload_source = load_source

    def _put(self, option: SourceOption, path: str) -> SourceState:
        if not (option.id or "").strip():
            raise ValueError("A data source id is required.")
        if not (option.variable or "").strip():
            raise ValueError(f"Data source '{option.id}' requires a variable name.")
        self._sources.pop(option.id.lower(), None)
        if option.format != "NetCdf":
            raise NotImplementedError(f"Data format '{option.format}' is not supported.")
        state = probe(option, path, self.clock())
        self._sources[option.id.lower()] = option, path, state
        return state

    def unload_source(self, source_id: str) -> bool:
        key = self._named(source_id)
        self._open()
        with self._lock:
            return self._sources.pop(key, None) is not None

    def states(self) -> list[SourceState]:
        """States in the order of ids (by code points)."""
        self._open()
        with self._lock:
            return sorted((s for _, _, s in self._sources.values()), key=lambda s: s.id)

    def states_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(s.id, s.type, s.status, s.message) for s in self.states()], SOURCE_STATE)

    def options_frame(self) -> DataFrame:
        self._open()
        with self._lock:
            rows = [o.row() for o, _, _ in self._sources.values()]
        names = [c.split()[0] for c in SOURCE_OPTION.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SOURCE_OPTION)

    def status(self, source_id: str) -> SourceState | None:
        key = self._named(source_id)
        self._open()
        with self._lock:
            found = self._sources.get(key)
        return found and found[2]

    # Queries

    def field(self, source_id: str, months: list[int] | None = None) -> Field:
        """The field of a ready source; its layout is that of the file of the first month asked for."""
        key = self._named(source_id)
        self._open()
        with self._lock:
            found = self._sources.get(key)
        if found is None:
            raise SourceNotRegistered(f"source '{source_id}' is not registered")
        option, path, state = found
        if state.status != "Ready":
            raise SourceNotReady(f"source '{source_id}' is not ready: {state.status} - {state.message}")
        monthly = bool((option.file_pattern or "").strip())
        asked = months or [self.clock().month]
        for month in asked:
            file = resolve_file(path, option.file_pattern, month)
            if not os.path.isfile(file):
                raise FileNotFoundError(f"the file of source '{option.id}' was not found: {file}")
        layout = read_layout(resolve_file(path, option.file_pattern, asked[0]), option.variable, option.latitude_variable, option.longitude_variable, option.depth_variable)
        cells = read_cells(self.spark, path, option.variable, latitude=option.latitude_variable, longitude=option.longitude_variable, depth=option.depth_variable, pattern=option.file_pattern)
        return Field(option.id, option.type, option.variable, layout, cells, option.unit, option.metadata, monthly, path, option.file_pattern)

    def _months(self, field: Field, points: DataFrame) -> list[int]:
        """Which months the points ask for, twelve at most; a stream may ask for every month that has a file."""
        if points.isStreaming:
            return [m for m in range(1, 13) if os.path.isfile(resolve_file(field.file, field.file_pattern, m))]
        found = points.select(month_or_now(F.col("date_time"), self.clock()).alias("m")).distinct().collect()
        return sorted(r["m"] for r in found)

    def _fields(self, source_id: str, points: DataFrame) -> list[tuple[Field, list[int] | None]]:
        """A field for each layout among the monthly files that the points ask for, with its months."""
        field = self.field(source_id)
        months = self._months(field, points) if field.monthly else []
        out: list[tuple[Field, list[int]]] = []
        for month in months:
            of_month = self.field(source_id, [month])
            for known, its in out:
                if same_layout(known.layout, of_month.layout):
                    its.append(month)
                    break
            else:
                out.append((of_month, [month]))
        return out or [(field, None)]

    def _near(self, points: DataFrame, field: Field, now: datetime) -> Field:
        """The field with only the cells between the least and the largest keys of the points."""
        keys = point_ops.point_indexes(points, field, now)
        ends = keys.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("depth_i", "lat_i"))).first()
        cells = field.cells
        for column, axis in (("depth_i", "depth"), ("lat_i", "lat")):
            if axis in field.layout.uses and ends[f"min_{column}"] is not None:
                cells = cells.filter((F.col(column) >= ends[f"min_{column}"]) & (F.col(column) <= ends[f"max_{column}"]))
        return field.with_cells(cells)

    def query_points(self, source_id: str, points: DataFrame) -> DataFrame:
        """One row per point: the nearest value of one source, null where it is missing.

        Monthly files that differ in axes or packing are read apart. Of a table of points
        (not of a stream) the months and the range of depths and latitudes are found
        first, so that nothing else is read from the files.
        """
        now = self.clock()
        parts = []
        for field, months in self._fields(source_id, points):
            its = points if months is None else points.filter(month_or_now(F.col("date_time"), now).isin(months))
            if months is not None:
                field = field.with_cells(field.cells.filter(F.col("month").isin(months)))
            if not points.isStreaming:
                field = self._near(its, field, now)
            parts.append(point_ops.nearest_points(its, field, now=now))
        return reduce(DataFrame.unionByName, parts)

    def query_all(self, points: DataFrame) -> DataFrame:
        """The values of every ready source; missing ones are left out."""
        self._open()
        ready = [s.id for s in self.states() if s.status == "Ready"]
        if not ready:
            empty = "query_id long, source_id string, type string, value double, unit string, latitude double, longitude double, depth double, date_time timestamp_ntz, variable string, metadata map<string,string>"
            return self.spark.createDataFrame([], empty)
        parts = [self.query_points(i, points) for i in ready]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.filter(F.col("value").isNotNull())

    def query_grid(self, source_id: str, spec: raster_ops.GridSpec) -> DataFrame:
        """The cells of a raster; see ``query_grid_summary`` for its extremes and metadata."""
        raster_ops.check_bounds(spec)
        return raster_ops.raster_cells(self._grid_field(source_id, spec), spec, now=self.clock())

    def query_grid_summary(self, source_id: str, spec: raster_ops.GridSpec) -> DataFrame:
        raster_ops.check_bounds(spec)
        return raster_ops.raster_summary(self._grid_field(source_id, spec), spec, now=self.clock())

    def query_grid_result(self, source_id: str, spec: raster_ops.GridSpec) -> DataFrame:
        """One row: the summary with all latitudes, longitudes and values."""
        raster_ops.check_bounds(spec)
        return raster_ops.raster_result(self._grid_field(source_id, spec), spec, now=self.clock())

    def _grid_field(self, source_id: str, spec: raster_ops.GridSpec) -> Field:
        return self.field(source_id, [(spec.date_time or self.clock()).month])
