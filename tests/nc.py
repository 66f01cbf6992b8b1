"""A writer of small classic NetCDF files."""

import struct

import numpy as np

CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


def _pad(b):
    return b + b"\0" * (-len(b) % 4)


def _name(s):
    return struct.pack(">I", len(s)) + _pad(s.encode())


def _attributes(attributes):
    if not attributes:
        return struct.pack(">II", 0, 0)
    out = struct.pack(">II", 12, len(attributes))
    for name, value in attributes.items():
        if isinstance(value, str):
            out += _name(name) + struct.pack(">II", 2, len(value)) + _pad(value.encode())
        else:
            a = np.atleast_1d(np.asarray(value, ">f8"))
            out += _name(name) + struct.pack(">II", 6, len(a)) + _pad(a.tobytes())
    return out


def write(path, dims, variables, version=1):
    """dims: {name: length or None for records}; variables: {name: (dim names, array, attributes)}."""
    names = list(dims)
    records = max([len(a) for d, a, _ in variables.values() if d and dims[d[0]] is None], default=0)
    body = struct.pack(">II", 10, len(dims)) + b"".join(_name(n) + struct.pack(">I", dims[n] or 0) for n in names) + struct.pack(">II", 0, 0)

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">I", records) + body + struct.pack(">II", 11, len(variables))
        for (name, (d, a, attributes)), begin in zip(variables.items(), begins):
            kind = a.dtype.str[1:]
            per = a[0].size if d and dims[d[0]] is None and len(a) else a.size
            size = -(-per * a.dtype.itemsize // 4) * 4
            out += _name(name) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", names.index(x)) for x in d)
            out += _attributes(attributes) + struct.pack(">II", CODES[kind], size) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    at = len(header([0] * len(variables)))
    begins, data = [], b""
    fixed = {n: v for n, v in variables.items() if not (v[0] and dims[v[0][0]] is None)}
    record = {n: v for n, v in variables.items() if n not in fixed}
    place = {}
    for n, (_, a, _) in fixed.items():
        place[n] = at + len(data)
        data += _pad(a.astype(">" + a.dtype.str[1:]).tobytes())
    for r in range(records):
        for n, (_, a, _) in record.items():
            place.setdefault(n, at + len(data))
            raw = a[r].astype(">" + a.dtype.str[1:]).tobytes()
            data += raw if len(record) == 1 else _pad(raw)
    begins = [place[n] for n in variables]
    with open(path, "wb") as f:
        f.write(header(begins) + data)
