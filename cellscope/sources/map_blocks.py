"""Map extracts in binary blocks (PBF) as a Spark data source: a partition for each range of blocks.

A file is a row of blobs, each behind a header with its type and size. The driver reads headers only and
deals the blobs into ranges of about ``split_mb``; tasks read a range blob by blob, unpack it and give one
Arrow batch for each, so a task holds one blob (32 MB at most by the format). Files may lie wherever pyarrow
can read: a local path or a URI that driver and executors both reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, k long, lat double, lon double, refs array<long>, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
ARROW = pa.schema(
    [
        ("kind", pa.string()), ("k", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())),
        ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string())),
    ]
)
KINDS = ("node", "way", "relation")  # fixed values: a member's type by its number
# Fixed values of the format: numbers of fields.
STRINGS, GROUP, GRANULARITY, LAT_OFFSET, LON_OFFSET = 1, 2, 17, 19, 20
SINGLE, DENSE, WAYS, RELATIONS = 1, 2, 3, 4


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: an unsigned integer, or the bytes of anything longer."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        form = key & 7
        if form == 0:
            yield key >> 3, varint()
            continue
        size = varint() if form == 2 else {1: 8, 5: 4}[form]
        if at + size > end:
            raise ValueError("a field runs past the end of its message")
        yield key >> 3, data[at : at + size]
        at += size


def packed(data: bytes) -> np.ndarray:
    """All integers of a packed field, unsigned."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    starts = np.concatenate([[0], np.flatnonzero(b < 128)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed integers whose sign is the lowest bit."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def steps(data: bytes) -> np.ndarray:
    """Signed integers that are kept as differences."""
    return np.cumsum(zigzag(packed(data)))


def unpacked(blob: bytes) -> bytes:
    """What a blob holds: as it is, or compressed by zlib."""
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
    raise ValueError("only blobs without compression or with zlib can be read")


def rows_of(block: bytes, kinds: frozenset[str]) -> Iterator[tuple]:
    """The elements of a block, as rows of ``SCHEMA``."""
    strings, groups, scale, offset = [], [], 100, {LAT_OFFSET: 0, LON_OFFSET: 0}
    for number, value in fields(block):
        if number == STRINGS:
            strings = [s.decode("utf-8", "replace") for n, s in fields(value) if n == 1]
        elif number == GROUP:
            groups.append(value)
        elif number == GRANULARITY:
            scale = value
        elif number in offset:
            offset[number] = signed(value)
    degrees = lambda values, which: (offset[which] + scale * values) / 1e9
    for group in groups:
        for number, value in fields(group):
            if number == DENSE and "node" in kinds:
                own = dict(fields(value))
                lat, lon = (degrees(steps(own.get(f, b"")), which).tolist() for f, which in ((8, LAT_OFFSET), (9, LON_OFFSET)))
                texts, at = packed(own.get(10, b"")).tolist(), 0
                for k, y, x in zip(steps(own.get(1, b"")).tolist(), lat, lon, strict=True):
                    tags = []
                    # A zero ends each node's keys and values; without any the field is empty.
                    while at < len(texts) and texts[at]:
                        tags.append((strings[texts[at]], strings[texts[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", k, y, x, None, None, tags
            elif number in (SINGLE, WAYS, RELATIONS) and (kind := {SINGLE: "node", WAYS: "way", RELATIONS: "relation"}[number]) in kinds:
                own = dict(fields(value))
                tags = [(strings[a], strings[b]) for a, b in zip(packed(own.get(2, b"")).tolist(), packed(own.get(3, b"")).tolist(), strict=True)]
                if kind == "node":
                    k, y, x = zigzag(np.array([own[1], own[8], own[9]], np.uint64)).tolist()
                    yield kind, k, degrees(y, LAT_OFFSET), degrees(x, LON_OFFSET), None, None, tags
                elif kind == "way":
                    yield kind, signed(own[1]), None, None, steps(own.get(8, b"")).tolist(), None, tags
                else:
                    parts = zip(packed(own.get(10, b"")).tolist(), steps(own.get(9, b"")).tolist(), packed(own.get(8, b"")).tolist(), strict=True)
                    yield kind, signed(own[1]), None, None, None, [{"type": KINDS[t], "ref": r, "role": strings[s]} for t, r, s in parts], tags


def blobs(stream, end: int) -> Iterator[tuple[str, int, int]]:
    """Type, place and size of the blobs from where ``stream`` stands up to ``end``; only headers are read."""
    while stream.tell() < end:
        (size,) = struct.unpack(">I", stream.read(4))
        header = dict(fields(stream.read(size)))
        start = stream.tell()
        yield header[1].decode(), start, header[3]
        stream.seek(start + header[3])


class BlockRange(InputPartition):
    """Blobs of one file: place and size of each."""

    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


class MapBlocksReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kinds = options["path"], frozenset(options.get("kinds", ",".join(KINDS)).split(","))
        self.split = float(options.get("split_mb", 32)) * 2**20

    def partitions(self) -> list[BlockRange]:
        system, inner = _open(self.path)
        found = system.get_file_info(inner)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".pbf")]
        out = []
        for file in sorted(files, key=lambda f: f.path):
            with system.open_input_file(file.path) as stream:
                places, held = [], 0
                for kind, start, size in blobs(stream, file.size):
                    if kind != "OSMData":
                        continue
                    places.append((start, size))
                    held += size
                    if held >= self.split:
                        out.append(BlockRange(file.path, places))
                        places, held = [], 0
                if places:
                    out.append(BlockRange(file.path, places))
        return out or [BlockRange(inner, [])]

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        if not partition.places:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as stream:
            for start, size in partition.places:
                stream.seek(start)
                rows = list(rows_of(unpacked(stream.read(size)), self.kinds))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class MapBlocks(DataSource):
    """``spark.read.format("map_blocks").option("kinds", "node,way").load(path)`` after registration."""

    @classmethod
    def name(cls) -> str:
        return "map_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MapBlocksReader:
        return MapBlocksReader(self.options)


def map_blocks(spark: SparkSession, path: str, kind: str, split_mb: float = 32) -> DataFrame:
    """Nodes, ways or relations of a file or a folder of ``.pbf`` files, in the columns of ``map_xml``.

    ``k, lat, lon, tags``, ``k, refs, tags`` or ``k, members, tags``; a relation's members are its ways with
    their roles. Groups of other kinds are passed over unread. A file without elements gives an empty table;
    a broken one, or a compression other than zlib, raises an error.
    """
    spark.dataSource.register(MapBlocks)
    raw = spark.read.format("map_blocks").option("kinds", kind).option("split_mb", str(split_mb)).load(path)
    ways = F.transform(F.filter("members", lambda m: m["type"] == "way"), lambda m: F.struct(m["ref"].alias("way"), m["role"].alias("role")))
    own = {"node": ["lat", "lon"], "way": ["refs"], "relation": [ways.alias("members")]}[kind]
    return raw.select("k", *own, "tags")
