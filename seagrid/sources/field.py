"""A gridded field: axes and packing on the driver, cells as a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seagrid.functions.decode import Packing
from seagrid.schema import CELLS, LON_BLOCK
from seagrid.sources.classic import ClassicFile

AXES = ("lat", "lon", "depth")


@dataclass(frozen=True)
class Layout:
    """Axes of a variable, which of them its cells depend on, and its packing."""

    lat: np.ndarray
    lon: np.ndarray
    depth: np.ndarray | None = None
    packing: Packing = Packing()
    uses: tuple[str, ...] = AXES

    def axis(self, name: str) -> np.ndarray | None:
        return getattr(self, name)


@dataclass(frozen=True)
class Field:
    """A source that can be queried: its layout, and cells of the months it holds."""

    source_id: str
    type: str
    variable: str
    layout: Layout
    cells: DataFrame
    unit: str | None = None
    metadata: dict[str, str] | None = None
    monthly: bool = False
    file: str | None = None
    file_pattern: str | None = None

    def with_cells(self, cells: DataFrame) -> Field:
        return replace(self, cells=cells)


def same_layout(a: Layout, b: Layout) -> bool:
    """Whether cells of both are found and decoded alike."""
    axes = all(np.array_equal(x, y) if x is not None and y is not None else x is y for x, y in ((a.axis(n), b.axis(n)) for n in AXES))
    return axes and a.uses == b.uses and repr(a.packing) == repr(b.packing)  # a mark may be NaN


def axis_owners(dims: list[int], axis_dims: dict[str, int]) -> dict[int, str]:
    """Which axis moves each dimension: the first place of its dimension, the last axis if several share it."""
    owner: dict[int, str] = {}
    for name in AXES:
        if name in axis_dims and axis_dims[name] in dims:
            owner[dims.index(axis_dims[name])] = name
    return owner


def read_layout(path: str, variable: str, latitude: str, longitude: str, depth: str | None) -> Layout:
    f = ClassicFile(path)
    axes = {"lat": f.axis(latitude), "lon": f.axis(longitude)}
    if (depth or "").strip():
        axes["depth"] = f.axis(depth)
    owner = axis_owners(f.variable(variable).dims, {n: d for n, (d, _) in axes.items()})
    uses = tuple(n for n in AXES if n in owner.values())
    return Layout(axes["lat"][1], axes["lon"][1], axes["depth"][1] if "depth" in axes else None, f.packing(variable), uses)


def grid_view(path: str, variable: str, latitude: str, longitude: str, depth: str | None) -> np.ndarray:
    """The variable as (depth, lat, lon); an axis that doesn't move it has length 1, other dimensions stand at 0."""
    f = ClassicFile(path)
    names = {"lat": latitude, "lon": longitude} | ({"depth": depth} if (depth or "").strip() else {})
    owner = axis_owners(f.variable(variable).dims, {n: f.variable(v).dims[0] for n, v in names.items()})
    view = f.view(variable)
    view = view[tuple(slice(None) if i in owner else 0 for i in range(view.ndim))]
    kept = [owner[i] for i in sorted(owner)]
    for name in AXES:
        if name not in kept:
            view, kept = view[..., None], [*kept, name]
    return view.transpose([kept.index(n) for n in ("depth", "lat", "lon")])


def cell_rows(view: np.ndarray, month: int, depth_i: int, lats: list[int], blocks: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches of CELLS for some latitudes and blocks of longitudes."""
    at_once = max(1, (1 << 20) // LON_BLOCK // max(1, len(blocks)))
    for start in range(0, len(lats), at_once):
        some = lats[start : start + at_once]
        lines = [np.asarray(view[depth_i, lat_i, b * LON_BLOCK : (b + 1) * LON_BLOCK], np.float64) for lat_i in some for b in blocks]
        offsets = np.cumsum([0, *map(len, lines)]).astype(np.int32)
        n = len(lines)
        ints = (np.full(n, month), np.full(n, depth_i), np.repeat(some, len(blocks)), np.tile(blocks, len(some)))
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lines)))
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in ints), values], names=["month", "depth_i", "lat_i", "lon_block", "values"])


def stored_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells from a Parquet folder that ``write_cells`` made."""
    return spark.read.schema(CELLS).parquet(path)


def write_cells(cells: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cells by month, sorted so that row groups can be skipped by depth and latitude."""
    cells.repartitionByRange("month", "depth_i", "lat_i").sortWithinPartitions("month", "depth_i", "lat_i", "lon_block").write.mode(mode).partitionBy("month").parquet(path)
