"""Vector tiles: polygons simplified for each zoom, clipped to their tiles and encoded as protocol buffers.

A polygon is sent to the tiles whose buffered boxes it touches at each zoom; shape work is done row by row in
Arrow batches before any shuffle, so that what meets in a tile are finished, small messages. A tile is one value in the
end and so is put together in one task.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENT = 4096
BUFFER = 0.05
MERCATOR = 85.05112878


def world(lon: float, lat: float) -> tuple[float, float]:
    """A place on the unit square of the projection, y down."""
    s = math.radians(max(-MERCATOR, min(MERCATOR, lat)))
    return (lon + 180) / 360, (1 - math.log(math.tan(s) + 1 / math.cos(s)) / math.pi) / 2


def weights(ring: list[tuple[float, float]], tolerance: float) -> list[float]:
    """For each corner of an open ring the squared tolerance at which it goes; those that go at ``tolerance`` have none.

    The two corners farthest apart from the first one cut the ring in two lines; of each the farthest corner stays, again and
    again, while it is farther than the tolerance. The cuts are the same for every tolerance, only their depth is not.
    """
    n, least = len(ring), tolerance * tolerance
    x0, y0 = ring[0]
    away = [(x - x0) ** 2 + (y - y0) ** 2 for x, y in ring]
    far = away.index(max(away))
    out = [-1.0] * n
    out[0] = out[far] = math.inf
    stack = [(0, far, math.inf), (far, n, math.inf)]
    while stack:
        a, b, above = stack.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = ring[a], ring[b % n]
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        worst, at = least, None
        for i in range(a + 1, b):
            px, py = ring[i][0] - ax, ring[i][1] - ay
            t = (px * dx + py * dy) / length if length else 0.0
            t = 0.0 if t < 0.0 else 1.0 if t > 1.0 else t
            d = (px - t * dx) ** 2 + (py - t * dy) ** 2
            if d > worst:
                worst, at = d, i
        if at is not None:
            out[at] = above = min(above, worst)
            stack += [(a, at, above), (at, b, above)]
    return out


def simplified(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """An open ring without the corners that lie within ``tolerance`` of the line that stays; as it was if under three would be left."""
    if len(ring) <= 3:
        return ring
    kept = [p for p, w in zip(ring, weights(ring, tolerance), strict=True) if w >= 0]
    return kept if len(kept) >= 3 else ring


def clipped(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """An open ring cut to a box (west, south, east, north), one side after the other."""
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for i, p in enumerate(ring):
            q = ring[i - 1]
            d, e = (p[axis] - bound) * sign, (q[axis] - bound) * sign
            if (d >= 0) != (e >= 0):
                t = e / (e - d)
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if d >= 0:
                out.append(p)
        ring = out
        if not ring:
            break
    return ring


def on_grid(ring: list[tuple[float, float]], z: int, x: int, y: int) -> list[tuple[int, int]]:
    """Tile coordinates from 0 to EXTENT, y down; places that fall together and the repeated end are dropped."""
    return _gridded([world(*p) for p in ring], 2**z, x, y)


def _gridded(places: list[tuple[float, float]], n: int, x: int, y: int) -> list[tuple[int, int]]:
    """``on_grid`` of places on the unit square."""
    out: list[tuple[int, int]] = []
    last = None
    for u, v in places:
        p = (round((u * n - x) * EXTENT), round((v * n - y) * EXTENT))
        if p != last:
            out.append(p)
            last = p
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def turned(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ring clockwise on the screen, as outer rings are; none without an area."""
    twice = sum(ring[i - 1][0] * p[1] - p[0] * ring[i - 1][1] for i, p in enumerate(ring))
    return [] if len(ring) < 3 or not twice else ring if twice > 0 else ring[::-1]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


SMALL = [varint(n) for n in range(16384)]


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else -n * 2 - 1


def field(number: int, payload: bytes) -> bytes:
    """A length-delimited protocol buffer field."""
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def geometry(ring: list[tuple[int, int]]) -> bytes:
    """Commands of one ring: move to the first corner, lines to the others, close."""
    words, x, y = [9], 0, 0
    for i, (u, v) in enumerate(ring):
        if i == 1:
            words.append((len(ring) - 1) << 3 | 2)
        words += [zigzag(u - x), zigzag(v - y)]
        x, y = u, v
    words.append(15)
    return b"".join([SMALL[w] if w < 16384 else varint(w) for w in words])


def value(v: object) -> bytes:
    """A property's value message: text, whole number, or double."""
    if isinstance(v, str):
        return field(1, v.encode())
    if isinstance(v, (bool, int)):
        return varint(6 << 3) + varint(zigzag(int(v)))
    return varint(3 << 3 | 1) + struct.pack("<d", v)


class Layer:
    """A tile with one layer, to which features are added one by one: encoded bytes are all it holds."""

    def __init__(self, name: str, keys: list[str]):
        self.keys, self.known, self.count = [varint(k) for k in range(len(keys))], {}, 0
        self.body = bytearray(field(1, name.encode()))
        self.tail = b"".join(field(3, k.encode()) for k in keys)

    def add(self, shape: bytes, values: list[bytes | None]) -> None:
        """A feature of its geometry and its value messages in the order of the keys, None where it has none."""
        known = self.known
        tags = b"".join([k + varint(known.setdefault(v, len(known))) for k, v in zip(self.keys, values, strict=True) if v is not None])
        self.body += field(2, (field(2, tags) if tags else b"") + POLYGON + field(4, shape))
        self.count += 1

    def encoded(self) -> bytes:
        self.body += self.tail + b"".join(field(4, v) for v in self.known) + varint(5 << 3) + varint(EXTENT) + varint(15 << 3) + varint(2)
        return varint(3 << 3 | 2) + varint(len(self.body)) + bytes(self.body)


POLYGON = varint(3 << 3) + varint(3)


def _shapes(points: list[tuple[float, float]], zooms: range) -> Iterator[tuple[int, int, int, bytes]]:
    """``z, x, y, geometry`` of an open ring of three corners or more in every tile that it touches.

    Corners are projected and weighed once for all zooms; only a ring that leaves its tile is clipped.
    """
    top = max(zooms)
    places = [world(*p) for p in points]
    fine = [720 / (2**z * EXTENT) for z in zooms if z != top]
    weight = weights(points, min(fine)) if fine and len(points) > 3 else None
    for z in zooms:
        n = 2**z
        own, at = points, places
        if z != top and weight is not None:
            bound = (720 / (n * EXTENT)) ** 2
            kept = [i for i, w in enumerate(weight) if w > bound]
            if 3 <= len(kept) < len(points):
                own, at = [points[i] for i in kept], [places[i] for i in kept]
        us, vs = [p[0] for p in at], [p[1] for p in at]
        west, east, low, high = min(us) * n, max(us) * n, min(vs) * n, max(vs) * n
        for x in range(max(0, math.floor(west - BUFFER)), min(n - 1, math.floor(east + BUFFER)) + 1):
            for y in range(max(0, math.floor(low - BUFFER)), min(n - 1, math.floor(high + BUFFER)) + 1):
                # A hair's breadth from the tile's side rounding decides, and that is clipping's to do.
                if x + 1e-6 < west and east < x + 1 - 1e-6 and y + 1e-6 < low and high < y + 1 - 1e-6:
                    part = turned(_gridded(at, n, x, y))
                else:
                    north, south = (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * e / n)))) for e in (y, y + 1))
                    part = turned(on_grid(clipped(own, (x / n * 360 - 180, south, (x + 1) / n * 360 - 180, north)), z, x, y))
                if part:
                    yield z, x, y, geometry(part)


def tiles(polygons: DataFrame, properties: list[str], zooms: range = range(10, 15), name: str = "building") -> DataFrame:
    """``z, x, y, features, tile`` of polygons ``k, ring array<struct<x, y>>`` (lon, lat) with property columns.

    Rings may be closed or not, and turn either way. Below the greatest zoom corners go that lie within two units of the tile's grid.
    A shape that has no area left on the grid is left out, as are null rings and those of fewer than three corners. Within a tile features
    are ordered by k. Null properties are not written. Polygons are spread over all tasks, and a tile is put together feature by feature
    from rows that Spark has sorted.
    """
    if properties and not set(properties) <= set(polygons.columns):
        raise ValueError(f"no such columns: {sorted(set(properties) - set(polygons.columns))}")
    spark = polygons.sparkSession
    shared = len(properties)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings, given = b.column("ring"), [b.column(p).to_pylist() for p in properties]
            starts, xy = rings.offsets.to_pylist(), rings.values
            pairs = list(zip(xy.field("x").to_pylist(), xy.field("y").to_pylist(), strict=True))
            rows, zs, xs, ys, found = [], [], [], [], []
            for at in range(len(rings)):
                points = pairs[starts[at] : starts[at + 1]]
                points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
                for z, x, y, shape in _shapes(points, zooms) if len(points) >= 3 else ():
                    rows.append(at)
                    zs.append(z)
                    xs.append(x)
                    ys.append(y)
                    found.append(shape)
            known: dict[object, bytes | None] = {}
            # True, 1 and 1.0 are one key of a dictionary but not one value.
            coded = [[None if v is None or v != v else known[type(v), v] if (type(v), v) in known else known.setdefault((type(v), v), value(v)) for v in own] for own in given]
            taken = b.column("k").take(pa.array(rows, pa.int64()))
            columns = [pa.array(zs, pa.int32()), pa.array(xs, pa.int32()), pa.array(ys, pa.int32()), pa.array(found, pa.binary()), taken, *[pa.array([c[i] for i in rows], pa.binary()) for c in coded]]
            yield pa.RecordBatch.from_arrays(columns, names=["z", "x", "y", "shape", "k", *[f"p{i}" for i in range(shared)]])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, made = None, None

        def done() -> pa.RecordBatch:
            z, x, y = ([v] for v in here)
            return pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array([made.count], pa.int32()), pa.array([made.encoded()], pa.binary())], names=["z", "x", "y", "features", "tile"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(4 + shared)]
            for z, x, y, shape, *values in zip(*columns, strict=True):
                if (z, x, y) != here:
                    if here is not None:
                        yield done()
                    here, made = (z, x, y), Layer(name, properties)
                made.add(shape, values)
        if here is not None:
            yield done()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    kinds = "".join(f", p{i} binary" for i in range(shared))
    own = polygons.filter("ring is not null").select("k", plain.alias("ring"), *properties).repartition(tasks, "k")
    cut = own.mapInArrow(shapes, f"z int, x int, y int, shape binary, k {polygons.schema['k'].dataType.simpleString()}{kinds}")
    ordered = cut.repartition(tasks, "z", "x", "y").sortWithinPartitions("z", "x", "y", "k")
    ordered = ordered.select("z", "x", "y", "shape", *[f"p{i}" for i in range(shared)])
    return ordered.mapInArrow(whole, "z int, x int, y int, features int, tile binary")


def decoded(tile: bytes) -> list[dict]:
    """Layers of a tile: name, extent, and features with their properties and rings, for checks and readers of single tiles."""

    def fields(raw: bytes) -> Iterator[tuple[int, object]]:
        at = 0
        while at < len(raw):
            key, at = _read(raw, at)
            if key & 7 == 2:
                n, at = _read(raw, at)
                yield key >> 3, raw[at : at + n]
                at += n
            elif key & 7 == 1:
                yield key >> 3, struct.unpack("<d", raw[at : at + 8])[0]
                at += 8
            else:
                n, at = _read(raw, at)
                yield key >> 3, n

    def words(raw: bytes) -> list[int]:
        out, at = [], 0
        while at < len(raw):
            n, at = _read(raw, at)
            out.append(n)
        return out

    back = lambda n: n >> 1 ^ -(n & 1)
    layers = []
    for _, raw in fields(tile):
        parts = list(fields(raw))
        keys = [v.decode() for k, v in parts if k == 3]
        values = [next(v.decode() if k == 1 else back(v) if k == 6 else v for k, v in fields(m)) for n, m in parts if n == 4]
        features = []
        for _, f in (p for p in parts if p[0] == 2):
            own = dict(fields(f))
            tags, code = words(own.get(2, b"")), words(own[4])
            ring, x, y, at = [], 0, 0, 0
            while at < len(code):
                op, n = code[at] & 7, code[at] >> 3
                at += 1
                for _ in range(n if op != 7 else 0):
                    x, y, at = x + back(code[at]), y + back(code[at + 1]), at + 2
                    ring.append((x, y))
            features.append({"properties": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, "ring": ring})
        layers.append({"name": next(v.decode() for k, v in parts if k == 1), "extent": next(v for k, v in parts if k == 5), "features": features})
    return layers


def _read(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if not raw[at - 1] & 128:
            return n, at
