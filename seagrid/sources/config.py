"""Catalog documents: lenient JSON with a list of source definitions."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from seagrid.errors import GridDataError
from seagrid.schema import ENVIRONMENT_TYPES, FORMATS


@dataclass(frozen=True)
class SourceOption:
    """One source: a variable in one file, or in one file a month."""

    id: str
    type: str
    path: str
    variable: str
    format: str = "NetCdf"
    enabled: bool = True
    file_pattern: str | None = None
    latitude_variable: str = "lat"
    longitude_variable: str = "lon"
    depth_variable: str | None = None
    time_variable: str | None = None
    unit: str | None = None
    dimension_map: dict[str, str] | None = None
    metadata: dict[str, str] | None = None

    def row(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class CatalogDocument:
    version: str = "1.0"
    sources: list[SourceOption] = field(default_factory=list)


def lenient_json(text: str):
    """JSON that may hold // and /* */ comments and trailing commas, outside of strings."""
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("//", i):
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise GridDataError("a comment in the catalog is not closed")
            i = end + 2
        elif c in "]}":
            k = len(out) - 1
            while k >= 0 and not out[k].strip():
                k -= 1
            if k >= 0 and out[k] == ",":
                out[k] = ""
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    return json.loads("".join(out))


def _member(text: str, allowed: tuple[str, ...], what: str) -> str:
    for name in allowed:
        if str(text).lower() == name.lower():
            return name
    raise GridDataError(f"unknown {what}: {text}")


#: Property names of the document, without case, and the fields that they fill.
_NAMES = {name.replace("_", ""): name for name in SourceOption.__dataclass_fields__}


def source_option(properties: dict) -> SourceOption:
    known = {_NAMES[k.lower()]: v for k, v in properties.items() if k.lower() in _NAMES}
    for name in ("id", "type", "path", "variable"):
        if known.get(name) is None:
            raise GridDataError(f"a source lacks the required property '{name}'")
    known["type"] = _member(known["type"], ENVIRONMENT_TYPES, "environment type")
    if "format" in known:
        known["format"] = _member(known["format"], FORMATS, "data format")
    return SourceOption(**known)


def load_catalog(path: str) -> CatalogDocument:
    if not (path or "").strip():
        raise ValueError("a catalog path is required")
    full = os.path.abspath(path)
    if not os.path.isfile(full):
        raise FileNotFoundError(full)
    with open(full, encoding="utf-8-sig") as f:
        document = lenient_json(f.read())
    if document is None:
        raise GridDataError("the catalog is empty")
    low = {k.lower(): v for k, v in document.items()}
    return CatalogDocument(str(low.get("version", "1.0")), [source_option(s) for s in low.get("sources") or []])


def resolve_source_path(path: str, catalog_path: str) -> str:
    """An absolute path as it is, a relative one from the catalog's folder."""
    return os.path.abspath(path if os.path.isabs(path) else os.path.join(os.path.dirname(os.path.abspath(catalog_path)), path))
