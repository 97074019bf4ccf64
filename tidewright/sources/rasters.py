"""Grids and layers from files that Spark has no reader for, decoded in the tasks from ``binaryFile`` rows."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d"}


def decode_tiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float], float | None]:
    """(values, (left, top, cell size), missing value) of a one-band GeoTIFF: strips or tiles, plain or deflated."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind in _TYPES:
            size = struct.calcsize(_TYPES[kind]) * n
            where = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            raw = data[where : where + size]
            tags[tag] = raw if kind == 2 else struct.unpack(f"{order}{n}{_TYPES[kind]}", raw)
    cols, rows = tags[256][0], tags[257][0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags[258][0] // 8}")
    offsets, sizes = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
    width, height = (tags[322][0], tags[323][0]) if 324 in tags else (cols, tags.get(278, (rows,))[0])
    across = -(-cols // width)
    out = np.zeros((-(-len(offsets) // across) * height, across * width))
    for k, (o, n) in enumerate(zip(offsets, sizes, strict=True)):
        part = data[o : o + n]
        if tags.get(259, (1,))[0] in (8, 32946):
            part = zlib.decompress(part)
        values = np.frombuffer(part, dtype)
        values = values[: len(values) // width * width].reshape(-1, width)
        r, c = divmod(k, across)
        out[r * height : r * height + len(values), c * width : (c + 1) * width] = values
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    text = tags.get(42113)
    missing = float(text.split(b"\0")[0]) if text else None
    return out[:rows, :cols], (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0]), missing


def encode_tiff(values: np.ndarray, left: float, top: float, size: float, missing: float = -9999.0) -> bytes:
    """A one-band deflated float32 GeoTIFF of one strip."""
    body = zlib.compress(np.where(np.isfinite(values), values, missing).astype("<f4").tobytes())
    text = f"{missing:g}".encode() + b"\0"
    extra = struct.pack("<3d", size, size, 0.0) + struct.pack("<6d", 0, 0, 0, left, top, 0) + text
    entries = [(256, 4, 1, values.shape[1]), (257, 4, 1, values.shape[0]), (258, 3, 1, 32), (259, 3, 1, 8), (262, 3, 1, 1), (277, 3, 1, 1), (278, 4, 1, values.shape[0]), (339, 3, 1, 3)]
    start = 8 + 2 + 12 * (len(entries) + 5) + 4
    after = start + len(extra)
    entries += [(273, 4, 1, after), (279, 4, 1, len(body)), (33550, 12, 3, start), (33922, 12, 6, start + 24)]
    inline = struct.unpack("<I", text.ljust(4, b"\0"))[0] if len(text) <= 4 else start + 72
    entries.append((42113, 2, len(text), inline))
    table = b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + table + b"\0" * 4 + extra + body


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """(path, r, c, x, y, v) of every cell of GeoTIFF files; x and y are cell centres, a missing value is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                values, (left, top, size), missing = decode_tiff(data)
                for r in range(0, len(values), 256):  # some rows at a time
                    part = values[r : r + 256]
                    y, x = np.indices(part.shape)
                    v = pd.Series(part.reshape(-1)).where(np.isfinite(part.reshape(-1)) & (part.reshape(-1) != missing))
                    yield pd.DataFrame({"path": name, "r": (y + r).reshape(-1), "c": x.reshape(-1), "x": left + (x.reshape(-1) + 0.5) * size, "y": top - (y.reshape(-1) + r + 0.5) * size, "v": v.to_numpy(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, r long, c long, x double, y double, v double")


def decode_wkb(data: bytes, at: int = 0) -> tuple[str, list, int]:
    """(kind, parts, end) of well-known binary: a part is a list of (x, y)."""
    order = "<" if data[at] == 1 else ">"
    kind = struct.unpack(order + "I", data[at + 1 : at + 5])[0] % 1000
    at += 5

    def points(n: int) -> list[tuple[float, float]]:
        nonlocal at
        flat = struct.unpack(f"{order}{2 * n}d", data[at : at + 16 * n])
        at += 16 * n
        return list(zip(flat[::2], flat[1::2], strict=True))

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack(order + "I", data[at - 4 : at])[0]

    if kind == 1:
        return "Point", [points(1)], at
    if kind == 2:
        return "LineString", [points(number())], at
    if kind == 3:
        return "Polygon", [points(number()) for _ in range(number())], at
    parts, name = [], {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}[kind]
    for _ in range(number()):
        _, more, at = decode_wkb(data, at)
        parts += more
    return name, parts, at


def _features(data: bytes, layer: str, columns: list[str]) -> Iterator[tuple]:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    geometry = con.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()[0]
    quoted = ", ".join('"' + c.replace('"', '""') + '"' for c in [geometry, *columns])
    for shape, *rest in con.execute(f'select {quoted} from "{layer.replace(chr(34), chr(34) * 2)}"'):
        envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(shape[3] >> 1) & 7] if shape else 0
        kind, parts, _ = decode_wkb(shape, 8 + envelope) if shape else (None, [], 0)
        yield kind, parts, *[None if v is None else str(v) for v in rest]
    con.close()


def read_layer(spark: SparkSession, path: str, layer: str, columns: list[str]) -> DataFrame:
    """(kind, parts, columns as text) of a GeoPackage layer; a file is decoded in memory by the task that reads it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                some = []
                for kind, parts, *rest in _features(bytes(data), layer, columns):
                    some.append((kind, [[{"x": x, "y": y} for x, y in p] for p in parts], *rest))
                    if len(some) == 1000:
                        yield pd.DataFrame(some, columns=["kind", "parts", *columns])
                        some = []
                if some:
                    yield pd.DataFrame(some, columns=["kind", "parts", *columns])

    schema = "kind string, parts array<array<struct<x:double,y:double>>>" + "".join(f", `{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
