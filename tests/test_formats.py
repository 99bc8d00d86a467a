"""Binary formats, encoded by helpers here and decoded by the sources."""

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cartolyte.sources import formats, tables

VERSIONS = (825, 829, 831, 834, 836, 846, 847, 854, 855, 858, 875, 884, 891)


def head(code: int, uid: int, x: float = 1.5, z: float = -2.5) -> bytes:
    return struct.pack("<IQf4xf", code, uid, x, z).ljust(52, b"\0")


def body(kind: str, version: int, values: dict) -> bytes:
    """A body by the layout table: lists hold one row, kept lists the given ids."""
    out, flags = b"", values.get("flags", bytes(5))
    for skip, name, code, kept, width, each, of, call in formats.layout_steps(kind, version):
        if skip:
            out += bytes(int(skip))
        elif name:
            out += struct.pack("<" + ("q" if code == "Q" else code), values.get(name, 7))
        elif kept:
            ids = values.get(kept, [11, 12])
            out += struct.pack(f"<i{len(ids)}q", len(ids), *ids)
        elif width:
            out += struct.pack("<i", 1) + bytes(int(width))
        elif each:
            out += bytes(int(each) * len(values.get(of, [11, 12])))
        elif call.startswith("actions"):
            out += struct.pack("<i", 0) + (bytes(24) if call != "actions_c" else b"")
        elif call == "templates":
            out += b"\1" + bytes(24)
        elif call.startswith("signs"):
            out += struct.pack("<ii", 0, 0)
        elif call == "scene":
            out += struct.pack("<i", 0)
    return flags + out[len(flags) :]


def sector(version: int, items: list[bytes], nodes: list[tuple]) -> bytes:
    data = struct.pack("<i12xI", version, len(items)) + b"".join(items) + struct.pack("<i", len(nodes))
    for uid, x, z in nodes:
        data += struct.pack("<qiiifff", uid, int(x * 256), 0, int(z * 256), 1.0, 0.0, 0.0).ljust(56, b"\0")
    return data + (struct.pack("<iq", 1, 5) if version >= 891 else b"")


def every_item(version: int) -> list[bytes]:
    items = []
    for code, kind in formats.TYPES.items():
        if min(formats.LAYOUTS[kind]) <= version:
            items.append(head(code - (version <= 825), 100 + code) + body(kind, version, {}))
    return items


@pytest.mark.parametrize("version", VERSIONS)
def test_all_item_types_of_a_version(version):
    items, nodes = formats.read_sector(sector(version, every_item(version), [(1, 10.0, -20.0), (2, 0.5, 0.25)]))
    assert {k for k, _ in items} == {k for k in formats.KEPT if min(formats.LAYOUTS[k]) <= version}
    road = dict(items)["road"]
    assert (road["uid"], road["x"], road["z"], road["look"], road["start"]) == (103, 1.5, -2.5, 7, 7)
    assert dict(items)["prefab"]["nodes"] == [11, 12]
    assert [(n["uid"], n["x"], n["z"]) for n in nodes] == [(1, 10.0, -20.0), (2, 0.5, 0.25)]


def test_sector_errors():
    with pytest.raises(formats.FormatError):
        formats.read_sector(sector(824, [], []))
    with pytest.raises(formats.FormatError):
        formats.read_sector(sector(858, [head(99, 1)], []))
    good = sector(858, every_item(858), [])
    with pytest.raises(formats.FormatError):
        formats.read_sector(good + b"x")
    assert len(formats.read_sector(good + b"x", strict=False)[0]) == len(formats.read_sector(good)[0])
    assert formats.read_sector(sector(858, [], [])) == ([], [])


def test_hidden_flags():
    hidden = head(12, 1) + body("city", 858, {"flags": b"\1\0\0\0\0"})
    guarded = head(18, 2) + body("overlay", 858, {"flags": b"\x03\x0d\0\0\0"})
    shown = head(18, 3) + body("overlay", 858, {"flags": b"\x03\x0c\0\0\0"})
    items, _ = formats.read_sector(sector(858, [hidden, guarded, shown], []))
    assert [i["hidden"] for _, i in items] == [True, True, False]


def archive(files: dict[str, bytes]) -> bytes:
    listing: dict[str, list[str]] = {"": []}
    for path in files:
        parts = path.split("/")
        for i in range(len(parts)):
            folder, name = "/".join(parts[:i]), parts[i] if i == len(parts) - 1 else "*" + parts[i]
            if name not in listing.setdefault(folder, []):
                listing[folder].append(name)
    blobs = {p: "\n".join(names).encode() for p, names in listing.items()} | files
    rows, data = b"", b""
    for path, content in blobs.items():
        packed = zlib.compress(content)
        rows += struct.pack("<QqIIii", formats.path_hash(path), 20 + 32 * len(blobs) + len(data), 3 if path in listing else 2, 0, len(content), len(packed))
        data += packed
    return struct.pack("<4sHH4sii", b"SCS#", 1, 0, b"CITY", len(blobs), 20) + rows + data


def test_path_hash_of_nothing():
    assert formats.path_hash("") == 11160318154034397263


@pytest.mark.parametrize(
    ("text", "value"),
    [("test", 17703940110308125106), ("hello", 2578220239953316063), ("Moscow", 12507901496292878638), ("How can you write a big system without C++?  -Paul Glick", 6237945311650045625)],
)
def test_path_hash_of_published_strings(text, value):
    """Values that other programs publish for the same hash (version 1.0)."""
    assert formats.path_hash(text) == value


def test_archives_and_layers(spark, tmp_path):
    long_path = "def/world/" + "x" * 70 + "/a.sii"
    base = {"def/city.sii": b"old", "map/m.mbd": b"", "map/m/s.base": b"s", "map/other/s.base": b"t", long_path: b"long", "def/ab/cdefghijklmnopqrstuv.sii": b"mid"}
    (tmp_path / "base.scs").write_bytes(archive(base))
    with zipfile.ZipFile(tmp_path / "mod.scs", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("def/city.sii", b"new")
    files = tables.layered(tables.archive_files(spark, str(tmp_path), {"base.scs": 1, "mod.scs": 2}))
    got = {r["path"]: bytes(r["content"]) for r in files.collect()}
    assert got == base | {"def/city.sii": b"new"}
    assert [r["path"] for r in tables.map_sectors(files).collect()] == ["map/m/s.base"]


def test_sector_tables(spark):
    data = [("map/m/a.base", sector(858, every_item(858), [(1, 1.0, 1.0), (9, 2.0, 2.0)])), ("map/m/b.base", sector(891, every_item(891), [(1, 5.0, 5.0)]))]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in data], "path string, content binary")
    items = tables.sector_items(files, types=frozenset(("road", "city")))
    assert items.groupBy("type").count().orderBy("type").collect() == [(3, 2), (12, 2)]
    assert items.select("load_seq").distinct().count() == 4
    nodes = {r["uid"]: r["x"] for r in tables.sector_nodes(files).collect()}
    assert nodes == {1: 1.0, 9: 2.0}


def test_prefab_descriptor(spark):
    at = 0x60
    table = struct.pack("<iii8xi8xii4x", 22, 1, 1, 1, 1, 1)
    node = bytearray(0x68)
    struct.pack_into("<fxxxxfff", node, 0x10, 1.0, 2.0, 0.0, 0.0)
    struct.pack_into("<16i", node, 0x28, 3, *[-1] * 14, 4)
    spawn = struct.pack("<ff f16xI", 5.0, 0.0, 6.0, 13).ljust(0x20, b"\0")[:0x20]
    point = bytearray(0x30)
    point[1], point[4], point[5] = 0x2E, 8, 2
    struct.pack_into("<ff f", point, 8, 7.0, 0.0, 8.0)
    struct.pack_into("<6ii", point, 0x14, 4, 5, 0, 0, 0, 0, 2)
    trigger = bytearray(0x30)
    struct.pack_into("<Iq", trigger, 0, 77, 99)
    header = bytearray(at)
    struct.pack_into("<iii", header, 0, 22, 1, 1)
    for k, v in ((0x14, 1), (0x20, 1), (0x24, 1), (0x30, at), (0x40, at + 0x68), (0x50, at + 0x88), (0x54, at + 0xB8)):
        struct.pack_into("<i", header, k, v)
    data = bytes(header) + bytes(node) + spawn + bytes(point) + bytes(trigger)
    row = tables.prefabs(spark.createDataFrame([("p.ppd", bytearray(data))], "path string, content binary")).first()
    assert row["valid_road"] and row["nodes"][0]["lane_count"] == 2
    assert row["spawn_points"][0]["type"] == 13
    p = row["map_points"][0]
    assert (p["lane_count"], p["lane_offset"], p["hidden"], p["control_node"], p["neighbours"]) == (-2, 2, True, 3, [4, 5])
    assert (row["trigger_points"][0]["trigger_id"], row["trigger_points"][0]["action"]) == (77, 99)
    assert len(table) > 0


def test_obfuscated_text():
    plain, key = "key[]: \"a\"\nval[]: \"ä\"".encode(), 250
    hidden = bytearray(b"3nK\1\0" + bytes([key]))
    for b in plain:
        hidden.append(b ^ ((((key << 2) ^ (key ^ 0xFF)) << 3) ^ key) & 0xFF)
        key = key + 1 & 0xFF
    assert formats.reveal(bytes(hidden)).encode() == plain
    assert formats.reveal(b"plain") == "plain"


def test_textures():
    head_ = bytearray(0x80)
    head_[:8] = b"DDS \x7c\0\0\0"
    struct.pack_into("<II", head_, 0x0C, 4, 4)
    raw = bytes(range(64))
    assert formats.read_texture(bytes(head_) + raw) == (4, 4, raw)
    head_[0x54:0x58] = b"DXT3"
    block = b"\xff" * 8 + struct.pack("<HH", 0xF800, 0x001F) + bytes([0b11100100] * 4)
    w, h, pixels = formats.read_texture(bytes(head_) + block)
    assert (w, h) == (4, 4) and pixels[:8] == bytes((0, 0, 255, 255, 255, 0, 0, 255)) and pixels[8:12] == bytes((85, 0, 170, 255))
    head_[0x54:0x58] = b"DXT5"
    block = bytes((255, 0)) + bytes(6) + struct.pack("<HH", 0xFFFF, 0) + bytes(4)
    assert formats.read_texture(bytes(head_) + block)[2] == b"\xff" * 64


def test_definition_text(spark):
    files = {
        "def/city.sii": '@include "city/a.sui"\n# note: x\n',
        "def/city/a.sui": 'city_data : city.alpha {\n city_name: "Alpha"\n}\ncity_data : city.beta {\n city_name: "Beta"\n}\n',
        "locale/en_us/local.sii": 'key[]: "alpha"\nval[]: "Alpha EN"\nkey[]: "beta"\nval[]: "Beta EN"\nval[]: "again"\n',
    }
    df = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files.items()], "path string, content binary")
    text = tables.expand_includes(df, F.col("path") == "def/city.sii")
    rows = tables.key_values(text, ["path"], ["line_no", "inner_no"])
    got = {(r["block"], r["key"]): r["value"] for r in rows.collect()}
    assert got[(0, "city_name")] == '"Alpha"' and got[(1, "city_name")] == '"Beta"'
    names = {(r["locale"], r["key"]): r["name"] for r in tables.locale_names(df).collect()}
    assert names == {("en_us", "alpha"): "Alpha EN", ("en_us", "beta"): "Beta EN"}
