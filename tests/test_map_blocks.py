"""Binary map extracts: an encoder in plain Python writes what the reader has to give back."""

import random
import struct
import zlib

import pytest

from cellscope.operators import areas
from cellscope.sources import map_blocks, readers


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zz(n):
    return varint(2 * n if n >= 0 else -2 * n - 1)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zz(b - a) for a, b in zip([0, *values], values, strict=False))


def block(nodes=(), single=(), ways=(), relations=(), scale=100, shift=(0, 0)):
    texts = [""]

    def s(text):
        if text not in texts[1:]:
            texts.append(text)
        return texts.index(text, 1)

    def tagged(tags):
        return field(2, b"".join(varint(s(k)) for k in tags)) + field(3, b"".join(varint(s(v)) for v in tags.values())) if tags else b""

    units = lambda v, i: round((v * 1e9 - shift[i]) / scale)
    groups = []
    if nodes:
        texts_of = b"".join(b"".join(varint(s(k)) + varint(s(v)) for k, v in n[3].items()) + b"\0" for n in nodes) if any(n[3] for n in nodes) else b""
        dense = field(1, deltas([n[0] for n in nodes])) + field(8, deltas([units(n[1], 0) for n in nodes])) + field(9, deltas([units(n[2], 1) for n in nodes]))
        groups.append(field(2, dense + (field(10, texts_of) if texts_of else b"")))
    if single:
        plain = lambda f, v: varint(f << 3) + zz(v)
        groups.append(b"".join(field(1, plain(1, n[0]) + tagged(n[3]) + plain(8, units(n[1], 0)) + plain(9, units(n[2], 1))) for n in single))
    if ways:
        groups.append(b"".join(field(3, field(1, k) + tagged(tags) + field(4, b"\x08\x01") + (field(8, deltas(refs)) if refs else b"")) for k, refs, tags in ways))
    if relations:
        groups.append(b"".join(field(4, field(1, k) + tagged(tags) + field(8, b"".join(varint(s(role)) for _, _, role in members)) + field(9, deltas([r for _, r, _ in members])) + field(10, bytes(t for t, _, _ in members))) for k, members, tags in relations))
    return field(1, b"".join(field(1, t.encode()) for t in texts)) + b"".join(field(2, g) for g in groups) + field(17, scale) + field(19, shift[0]) + field(20, shift[1])


def blob(data, kind=b"OSMData", packed=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if packed else field(1, data)
    header = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(header)) + header + body


def test_map_blocks_round_trip(spark, tmp_path):
    r = random.Random(5)
    place = lambda: (round(r.uniform(-90, 90), 7), round(r.uniform(-180, 180), 7))
    nodes = [(r.randrange(1, 2**40), *place(), {"name": f"Ünï {i}", "a": ""} if i % 3 == 0 else {}) for i in range(3000)]
    ways = [(2**33 + i, [r.choice(nodes)[0] for _ in range(r.randrange(9))], {"highway": "primary"} if i % 2 else {}) for i in range(500)]
    relations = [(i, [(r.randrange(3), r.randrange(2**40), r.choice(["outer", "inner", ""])) for _ in range(r.randrange(6))], {"type": "multipolygon"}) for i in range(50)]
    parts = [blob(b"", b"OSMHeader"), *(blob(block(nodes=nodes[i : i + 250]), packed=i % 500 == 0) for i in range(0, 2500, 250))]
    parts += [blob(block(single=nodes[2500:2700], scale=10, shift=(10**9, -(10**9)))), blob(block(nodes=nodes[2700:], ways=ways[:100])), blob(block(ways=ways[100:], relations=relations)), blob(block())]
    folder = tmp_path / "extract"
    folder.mkdir()
    (folder / "a.pbf").write_bytes(b"".join(parts[:7]))
    (folder / "b.pbf").write_bytes(b"".join(parts[7:]))
    (folder / "c.pbf").write_bytes(blob(b"", b"OSMHeader"))
    for path in (str(folder), f"file://{folder}"):
        found = map_blocks.map_blocks(spark, path, "node", split_mb=0.005)
        assert found.rdd.getNumPartitions() > 4
        assert sorted((x["k"], round(x["lat"], 7), round(x["lon"], 7), x["tags"]) for x in found.collect()) == sorted((*n[:3], n[3]) for n in nodes)
    key = lambda x: x[0]
    assert sorted(((x["k"], x["refs"], x["tags"]) for x in map_blocks.map_blocks(spark, str(folder), "way").collect()), key=key) == ways
    got = sorted(((x["k"], [(m["way"], m["role"]) for m in x["members"]], x["tags"]) for x in map_blocks.map_blocks(spark, str(folder), "relation").collect()), key=key)
    assert got == [(k, [(ref, role) for t, ref, role in members if t == 1], tags) for k, members, tags in relations]
    assert map_blocks.map_blocks(spark, str(folder / "c.pbf"), "node").count() == 0


def test_map_blocks_feed_areas(spark, tmp_path):
    """Centres of ways and of areas from relations, read from blocks alone."""
    nodes = [(1, 1.0, 1.0, {}), (2, 1.0, 3.0, {}), (3, 5.0, 3.0, {}), (-4, 5.0, 1.0, {})]
    path = tmp_path / "m.pbf"
    path.write_bytes(blob(block(nodes=nodes, ways=[(7, [1, 2, 3], {}), (8, [3, -4, 1], {"x": "y"})], relations=[(9, [(1, 7, "outer"), (1, 8, "outer"), (0, 1, "label")], {"type": "multipolygon", "natural": "water"})])))
    n, w, rel = (map_blocks.map_blocks(spark, str(path), kind) for kind in ("node", "way", "relation"))
    assert [tuple(x)[:3] for x in areas.area_centres(n, w, rel).collect()] == [(9, 3.0, 2.0)]
    assert sorted(tuple(x)[:3] for x in readers.way_centres(n, w).collect()) == [(7, 3.0, 2.0), (8, 3.0, 2.0)]


def test_map_blocks_broken(spark, tmp_path):
    (tmp_path / "x.pbf").write_bytes(struct.pack(">I", 5) + b"\xff" * 3)
    with pytest.raises(Exception, match="(?i)error|range|end"):
        map_blocks.map_blocks(spark, str(tmp_path / "x.pbf"), "node").collect()
    body = field(2, 10) + field(4, b"compressed")
    header = field(1, b"OSMData") + field(3, len(body))
    (tmp_path / "y.pbf").write_bytes(struct.pack(">I", len(header)) + header + body)
    with pytest.raises(Exception, match="zlib"):
        map_blocks.map_blocks(spark, str(tmp_path / "y.pbf"), "node").collect()


@pytest.mark.parametrize("values", [[], [0], [127, 128, 2**32, 2**63 - 1, 2**64 - 1, 1]])
def test_packed_integers(values):
    assert map_blocks.packed(b"".join(map(varint, values))).tolist() == values
    assert map_blocks.zigzag(map_blocks.packed(b"".join(map(zz, [0, -1, 5, -(2**62)])))).tolist() == [0, -1, 5, -(2**62)]
