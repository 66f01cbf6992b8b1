"""The classic NetCDF formats (CDF-1, CDF-2 and CDF-5), by their published layout."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from seagrid.errors import GridDataError
from seagrid.functions.decode import Packing

#: External types by their number in the file.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


class UnsupportedFlavour(GridDataError):
    """A file that this reader can't open, such as one in an HDF5 container."""


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict[str, np.ndarray | bytes]
    dtype: np.dtype
    begin: int


class ClassicFile:
    """The header of a file, and views of its variables."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3:] not in (b"\1", b"\2", b"\5"):
            if magic == b"\x89HDF":
                raise UnsupportedFlavour(f"no reader for the HDF5 container {path}")
            raise GridDataError(f"not a NetCDF file: {path}")
        self.data = np.memmap(path, np.uint8, "r")
        self._at, self._wide, self._far = 4, magic[3] == 5, magic[3] != 1
        records = self._count()
        self.dims = [(self._name(), self._count()) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables: dict[str, Variable] = {}
        sizes = []
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._count() for _ in range(self._count())]
            attributes = self._attributes()
            dtype = np.dtype(TYPES[self._int()])
            sizes.append((name, self._count()))
            begin = self._number(">q" if self._far else ">i")
            self.variables[name] = Variable(name, dims, attributes, dtype, begin)
        record = [v for v in self.variables.values() if self._is_record(v)]
        slab = [int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * v.dtype.itemsize for v in record]
        # A single record variable is not padded.
        self.record_size = slab[0] if len(slab) == 1 else sum(-(-s // 4) * 4 for s in slab)
        endless = (1 << 64) - 1 if self._wide else (1 << 32) - 1
        if records == endless:
            first = min((v.begin for v in record), default=0)
            records = (len(self.data) - first) // self.record_size if record and self.record_size else 0
        self.records = records

    def _is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def _number(self, kind: str) -> int:
        (value,) = struct.unpack_from(kind, self.data, self._at)
        self._at += struct.calcsize(kind)
        return value

    def _int(self) -> int:
        return self._number(">i")

    def _count(self) -> int:
        return self._number(">Q" if self._wide else ">I")

    def _name(self) -> str:
        n = self._count()
        text = bytes(self.data[self._at : self._at + n]).decode()
        self._at += -(-n // 4) * 4
        return text

    def _list(self, tag: int) -> int:
        got, n = self._int(), self._count()
        if got not in (0, tag) or (got == 0 and n):
            raise GridDataError(f"bad header in {self.path}")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), self._int(), self._count()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = bytes(self.data[self._at : self._at + size])
            out[name] = raw if kind == 2 else np.frombuffer(raw, TYPES[kind])
            self._at += -(-size // 4) * 4
        return out

    def variable(self, name: str) -> Variable:
        if name not in self.variables:
            raise GridDataError(f"Find variable '{name}': variable not found ({self.path})")
        return self.variables[name]

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.records if i == 0 and self._is_record(v) else self.dims[d][1] for i, d in enumerate(v.dims))

    def view(self, name: str) -> np.ndarray:
        """All values of a variable, mapped and not read."""
        v = self.variable(name)
        shape = self.shape(v)
        strides = [v.dtype.itemsize] * len(shape)
        for i in range(len(shape) - 2, -1, -1):
            strides[i] = strides[i + 1] * shape[i + 1]
        if self._is_record(v):
            strides[0] = self.record_size
        return np.ndarray(shape, v.dtype, self.data, v.begin, strides)

    def axis(self, name: str) -> tuple[int, np.ndarray]:
        """(dimension number, values) of a coordinate; values are taken as stored."""
        v = self.variable(name)
        if len(v.dims) != 1:
            raise GridDataError(f"Axis '{name}' must be one-dimensional.")
        return v.dims[0], np.array(self.view(name), np.float64)

    def packing(self, name: str) -> Packing:
        """Fill, missing, scale and offset; of an attribute with several values the first counts."""
        found = {}
        for ours, theirs in (("fill", "_FillValue"), ("missing", "missing_value"), ("scale", "scale_factor"), ("offset", "add_offset")):
            value = self.variable(name).attributes.get(theirs)
            if isinstance(value, np.ndarray) and len(value):
                found[ours] = float(value[0])
        return Packing(**found)
