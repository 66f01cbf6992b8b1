"""Catalog, files, registry, point and raster queries on synthetic NetCDF files."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException

import nc
from seagrid import GridSpec, OceanGrids, SourceOption
from seagrid.errors import EngineClosed, GridDataError, SourceNotReady, SourceNotRegistered
from seagrid.schema import POINT_QUERY
from seagrid.sources.classic import ClassicFile
from seagrid.sources.config import lenient_json, load_catalog
from seagrid.sources.field import stored_cells, write_cells
from seagrid.sources.netcdf import read_cells

CLOCK = datetime(2024, 8, 15, 12)
LAT, LON, DEPTH = np.array([10.0, 20.0, 30.0]), np.array([0.0, 90.0, 180.0, 270.0]), np.array([0.0, 10.0, 100.0])
BASE = np.arange(12, dtype="i2").reshape(3, 4)
PACK = {"_FillValue": 5.0, "scale_factor": 2.0, "add_offset": 1.0, "units": "m"}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("nc")
    axes = {"lat": (["lat"], LAT, {}), "lon": (["lon"], LON, {})}
    nc.write(d / "plain.nc", {"lat": 3, "lon": 4}, {"lat": (["lat"], LAT, {}), "z": (["lat", "lon"], BASE, PACK), "lon": (["lon"], LON, {})})
    nc.write(d / "turned.nc", {"lon": 4, "lat": 3}, axes | {"z": (["lon", "lat"], BASE.T.copy(), PACK)}, 2)
    cube = (np.arange(36, dtype="f4").reshape(1, 3, 3, 4)).copy()
    nc.write(d / "cube.nc", {"time": None, "depth": 3, "lat": 3, "lon": 4}, axes | {"depth": (["depth"], DEPTH, {}), "t": (["time", "depth", "lat", "lon"], cube, {"missing_value": 7.0})})
    nc.write(d / "flat.nc", {"depth": 3, "lat": 3, "lon": 4}, axes | {"depth": (["depth"], DEPTH, {}), "z": (["lat", "lon"], BASE, {})})
    nc.write(d / "square.nc", {"n": 3}, {"lat": (["n"], LAT, {}), "lon": (["n"], np.array([0.0, 1.0, 2.0]), {}), "z": (["n"], np.array([1.0, 2.0, 3.0]), {})})
    for m in (1, 8):
        nc.write(d / f"s{m:02d}.nc", {"lat": 3, "lon": 4}, axes | {"s": (["lat", "lon"], BASE + np.int16(100 * m), {})})
    (d / "hdf.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    (d / "junk.nc").write_bytes(b"nothing")
    return d


@pytest.fixture()
def engine(spark, files):
    with OceanGrids(spark, lambda: CLOCK) as e:
        yield e


def source(files, name="plain.nc", **more):
    return SourceOption(**({"id": "A", "type": "Bathymetry", "path": str(files / name), "variable": "z"} | more))


def points(spark, *rows):
    return spark.createDataFrame([(i, *r, *([None] * (4 - len(r))), "Nearest")[:6] for i, r in enumerate(rows)], POINT_QUERY)


def values(df):
    return [r.value for r in df.orderBy("query_id").collect()]


def test_classic_reader(files):
    f = ClassicFile(str(files / "plain.nc"))
    assert f.view("z").tolist() == BASE.tolist()
    assert (f.packing("z").fill, f.packing("z").scale, f.packing("z").offset, f.packing("z").missing) == (5.0, 2.0, 1.0, None)
    assert ClassicFile(str(files / "cube.nc")).view("t").shape == (1, 3, 3, 4)
    with pytest.raises(GridDataError):
        f.variable("nope")
    with pytest.raises(GridDataError):
        f.axis("z")


def test_points(spark, files, engine):
    assert engine.load_source(source(files, unit="m", metadata={"k": "v", "file": "x"})).status == "Ready"
    got = engine.query_points("a", points(spark, (14.0, -91.0), (15.0, 45.0), (90.0, 359.0), (10.0, 90.0), (math.nan, 0.0), (20.0, 90.0))).orderBy("query_id").collect()
    assert [r.value for r in got] == [7.0, 1.0, 23.0, 3.0, 1.0, None]  # raw 5 is the fill mark
    assert (got[0].latitude, got[0].longitude, got[0].unit, got[0].source_id) == (10.0, 270.0, "m", "A")
    assert got[0].metadata == {"k": "v", "file": str(files / "plain.nc"), "sampling": "Nearest"}
    engine.load_source(source(files, "turned.nc", id="B"))
    both = engine.query_all(points(spark, (14.0, -91.0), (20.0, 90.0))).collect()
    assert sorted((r.query_id, r.source_id, r.value) for r in both) == [(0, "A", 7.0), (0, "B", 7.0)]


@pytest.mark.parametrize("bad", [(90.1, 0.0), (-91.0, 0.0), (0.0, 361.0), (0.0, -360.5)])
def test_points_out_of_range_fail(spark, files, engine, bad):
    engine.load_source(source(files))
    with pytest.raises(PySparkException):
        engine.query_points("A", points(spark, bad)).collect()


def test_depth_and_extra_dimensions(spark, files, engine):
    engine.load_source(source(files, "cube.nc", variable="t", depth_variable="depth"))
    got = engine.query_points("A", points(spark, (10.0, 0.0), (10.0, 0.0, 54.0), (10.0, 0.0, 1e20), (10.0, 0.0, -5.0), (20.0, 270.0, 0.0)))
    rows = got.orderBy("query_id").collect()
    assert [r.value for r in rows] == [0.0, 12.0, 24.0, 0.0, None]
    assert [r.depth for r in rows] == [0.0, 10.0, 100.0, 0.0, 0.0]
    engine.load_source(source(files, "flat.nc", depth_variable="depth"))
    row = engine.query_points("A", points(spark, (10.0, 90.0, 80.0))).first()
    assert (row.value, row.depth) == (1.0, 100.0)
    engine.load_source(source(files, "square.nc"))  # one dimension, moved by the longitude
    assert values(engine.query_points("A", points(spark, (10.0, 2.0), (30.0, 0.0)))) == [3.0, 1.0]


def test_months(spark, files, engine):
    state = engine.load_source(source(files, "", path=str(files), file_pattern="s{MM}.nc", variable="s", id="S"))
    assert state.status == "Ready"
    asked = points(spark, (10.0, 0.0, None, datetime(2020, 1, 9)), (10.0, 0.0, None, None))
    assert values(engine.query_points("S", asked)) == [100.0, 800.0]
    with pytest.raises(FileNotFoundError):
        engine.query_points("S", points(spark, (10.0, 0.0, None, datetime(2020, 2, 9))))
    plan = read_cells(spark, str(files), "s", pattern="s{MM}.nc").filter("month = 1")
    assert plan.rdd.getNumPartitions() == 1 and plan.count() == 3


def test_raster_matches_points(spark, files, engine):
    engine.load_source(source(files))
    spec = GridSpec(5.0, 35.0, -100.0, 300.0, width=9, height=5)
    cells = engine.query_grid("A", spec).orderBy("row", "col").collect()
    assert len(cells) == 45 and (cells[0].row, cells[0].latitude) == (0, 30.0)
    again = engine.query_points("A", points(spark, *((c.latitude, c.longitude) for c in cells)))
    assert values(again) == [c.value for c in cells]
    summary = engine.query_grid_summary("A", spec).first()
    known = [c.value for c in cells if c.value is not None]
    assert None in [c.value for c in cells]
    assert (summary.minimum, summary.maximum, summary.requested_bounds) == (min(known), max(known), [5.0, 35.0, -100.0, 300.0])


@pytest.mark.parametrize("change", [{"width": 1}, {"height": 2049}, {"min_latitude": 35.0}, {"max_longitude": 361.0}, {"max_latitude": 91.0}])
def test_raster_bounds(files, engine, change):
    engine.load_source(source(files))
    with pytest.raises(ValueError):
        engine.query_grid("A", GridSpec(**({"min_latitude": 5.0, "max_latitude": 35.0, "min_longitude": 0.0, "max_longitude": 300.0} | change)))


def test_states(files, engine):
    for name, more, status in (
        ("plain.nc", {}, "Ready"),
        ("plain.nc", {"enabled": False, "path": "/nowhere"}, "Disabled"),
        ("none.nc", {}, "FileNotFound"),
        ("plain.nc", {"variable": "q"}, "Error"),
        ("plain.nc", {"latitude_variable": "q"}, "Error"),
        ("junk.nc", {}, "Error"),
        ("hdf.nc", {}, "NativeLibraryUnavailable"),
        ("", {}, "FileNotFound"),
    ):
        assert engine.load_source(source(files, name, **more)).status == status, (name, more)
    with pytest.raises(SourceNotReady):
        engine.query_grid("a", GridSpec(0, 1, 0, 1))
    with pytest.raises(SourceNotRegistered):
        engine.query_grid("zz", GridSpec(0, 1, 0, 1))
    assert engine.status("nope") is None and not engine.unload_source("nope") and engine.unload_source("a")
    with pytest.raises(ValueError):
        engine.status(" ")
    engine.close()
    with pytest.raises(EngineClosed):
        engine.states()


def test_catalog(tmp_path, files, engine):
    text = """{ // a comment, with "quotes"
      "Version": "2", "sources": [
        {"ID": "b", "type": "bathymetry", "Path": "plain.nc", "variable": "z", "metadata": {"u": "http://x//y",},},
        {"id": "a", "type": "Salinity", "path": "none.nc", "variable": "s", "enabled": false},
        /* the last one wins */ {"id": "B", "type": "Temperature", "path": "plain.nc", "variable": "z"},
      ],
    }"""
    path = files / "catalog.json"
    path.write_text(text)
    states, good = engine.initialize(str(path))
    assert [(s.id, s.type, s.status) for s in states] == [("B", "Temperature", "Ready"), ("a", "Salinity", "Disabled")] and good
    assert load_catalog(str(path)).version == "2" and engine.states_frame().count() == 2 and engine.options_frame().count() == 2
    for bad in ('{"sources": [{"id": "x", "type": "Bathymetry", "path": "p"}]}', '{"sources": [{"id": "x", "type": "Moon", "path": "p", "variable": "z"}]}', "null", "{"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            engine.initialize(str(tmp_path / "bad.json"))
    assert len(engine.states()) == 2  # a bad document leaves the registry
    with pytest.raises(FileNotFoundError):
        engine.initialize(str(tmp_path / "none.json"))
    assert lenient_json('["a // b", "/* c */",]') == ["a // b", "/* c */"]


def test_stored_cells(spark, files, tmp_path, engine):
    engine.load_source(source(files))
    field = engine.field("A")
    write_cells(field.cells, str(tmp_path / "cells"))
    stored = field.with_cells(stored_cells(spark, str(tmp_path / "cells")))
    from seagrid.operators.points import nearest_points

    assert values(nearest_points(points(spark, (14.0, -91.0)), stored, now=CLOCK)) == [7.0]


def test_stream(spark, files, tmp_path, engine):
    from seagrid.streaming.points import stream_points

    engine.load_source(source(files))
    points(spark, (14.0, -91.0), (15.0, 45.0)).write.parquet(str(tmp_path / "in"))
    incoming = spark.readStream.schema(POINT_QUERY).parquet(str(tmp_path / "in"))
    run = stream_points(incoming, engine.field("A"), CLOCK).writeStream.format("memory").queryName("nearest").start()
    run.processAllAvailable()
    run.stop()
    assert values(spark.table("nearest")) == [7.0, 1.0]
    with pytest.raises(ValueError):
        stream_points(points(spark, (1.0, 1.0)), engine.field("A"), CLOCK)


def test_monthly_files_of_different_layouts(spark, tmp_path, engine):
    import nc

    lat, lon = np.arange(3.0), np.arange(4.0)
    for month, scale, shift in ((1, 1.0, 0.0), (3, 1.0, 0.0), (8, 10.0, 1.0)):
        z = np.arange(12, dtype="f4").reshape(3, 4)
        variables = {"lat": (["lat"], lat + shift, {}), "lon": (["lon"], lon, {}), "z": (["lat", "lon"], z, {"scale_factor": scale})}
        nc.write(str(tmp_path / f"s{month:02d}.nc"), {"lat": 3, "lon": 4}, variables)
    engine.clock = lambda: datetime(2024, 1, 15)
    option = SourceOption(id="M", type="Salinity", path=str(tmp_path), variable="z", file_pattern="s{MM}.nc", metadata={"requestedBounds": "x"})
    assert engine.load_source(option).status == "Ready"
    asked = [(1, 2.0, 1.0, None, None, "Nearest"), (2, 2.0, 1.0, None, datetime(2024, 8, 1), "Nearest"), (3, 2.0, 1.0, None, datetime(2024, 3, 1), "Nearest")]
    rows = {r.query_id: r for r in engine.query_points("m", spark.createDataFrame(asked, POINT_QUERY)).collect()}
    assert [rows[i].value for i in (1, 2, 3)] == [9.0, 50.0, 9.0]
    assert rows[2].metadata["file"] == str(tmp_path / "s08.nc")
    spec = GridSpec(0.0, 2.0, 0.0, 3.0, width=4, height=3, date_time=datetime(2024, 8, 1))
    result = engine.query_grid_result("M", spec).first()
    assert result.metadata["file"] == str(tmp_path / "s08.nc") and "requestedBounds" not in result.metadata
    assert result.latitudes == [2.0, 1.0, 1.0] and result.longitudes == [0.0, 1.0, 2.0, 3.0]
    assert result["values"] == [40.0, 50.0, 60.0, 70.0, *[0.0, 10.0, 20.0, 30.0] * 2] and (result.minimum, result.maximum) == (0.0, 70.0)
    with pytest.raises(FileNotFoundError):
        engine.query_points("m", spark.createDataFrame([(1, 2.0, 1.0, None, datetime(2024, 2, 1), "Nearest")], POINT_QUERY))


def test_filters_reach_the_source(spark, tmp_path):
    import nc
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThanOrEqual

    from seagrid.sources.netcdf import GridReader, read_cells

    z = np.arange(60, dtype="f4").reshape(2, 5, 6)
    variables = {"depth": (["depth"], np.arange(2.0), {}), "lat": (["lat"], np.arange(5.0), {}), "lon": (["lon"], np.arange(6.0), {}), "z": (["depth", "lat", "lon"], z, {})}
    path = str(tmp_path / "z.nc")
    nc.write(path, {"depth": 2, "lat": 5, "lon": 6}, variables)
    reader = GridReader({"path": path, "variable": "z", "depth": "depth"})
    assert list(reader.pushFilters([EqualTo(("depth_i",), 1), GreaterThanOrEqual(("lat_i",), 2), LessThanOrEqual(("lat_i",), 3), In(("lon_block",), (0, 7))])) == []
    (slab,) = reader.partitions()
    assert (slab.depth_i, slab.lats, slab.blocks) == (1, [2, 3], [0])
    rows = read_cells(spark, path, "z", depth="depth").filter("depth_i = 1 AND lat_i BETWEEN 2 AND 3").orderBy("lat_i").collect()
    assert [r["values"] for r in rows] == [z[1, 2].tolist(), z[1, 3].tolist()]
