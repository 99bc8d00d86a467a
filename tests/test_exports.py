"""From an archive to the exports: definitions, sectors, prefabs and textures in, JSON rows and images out."""

import json
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cartolyte.functions.tokens import token
from cartolyte.plans import exports
from cartolyte.sources import definitions, formats, tables
from tests.test_formats import archive, body, head, sector


def code(name: str) -> int:
    """The token of a name, by hand."""
    total = sum((" 0123456789abcdefghijklmnopqrstuvwxyz_".index(c)) * 38**i for i, c in enumerate(name)) % (1 << 64)
    return total - (1 << 64) if total >> 63 else total


def texture(width: int, height: int) -> bytes:
    data = bytearray(0x80)
    data[:8] = b"DDS \x7c\0\0\0"
    struct.pack_into("<II", data, 0x0C, height, width)
    return bytes(data) + bytes(range(4 * width)) * height


def descriptor() -> bytes:
    at, node, spawns, triggers = 0x60, bytearray(0x68), b"", b""
    struct.pack_into("<fxxxxfff", node, 0x10, 1.0, 2.0, 1.0, 0.0)
    struct.pack_into("<16i", node, 0x28, *[-1] * 16)
    for x, z, kind in ((3.0, 2.0, 13), (1.0, 4.0, 3), (9.0, 9.0, 1)):
        spawns += struct.pack("<ff f16xI", x, 0.0, z, kind)[:0x20]
    for number, action, x in ((5, 0, 1.0), (5, code("hud_parking"), 2.0), (6, code("hud_parking"), 3.0), (6, code("hud_parking"), 4.0)):
        row = bytearray(0x30)
        struct.pack_into("<Iq", row, 0, number, action)
        struct.pack_into("<f", row, 0x1C, x)
        triggers += bytes(row)
    header = bytearray(at)
    struct.pack_into("<iii", header, 0, 22, 1, 1)
    for k, v in ((0x14, 3), (0x20, 0), (0x24, 4), (0x30, at), (0x40, at + 0x68), (0x50, at + 0xC8), (0x54, at + 0xC8)):
        struct.pack_into("<i", header, k, v)
    return bytes(header) + bytes(node) + spawns + triggers


CITY = 'city_data : city.alpha {\n city_name: "Alpha"\n city_name_localized: "@@alpha@@"\n country: beta // land\n' + "".join(f" map_x_offsets[]: {i}\n" for i in range(8)) + "}\n"
LOOK = "road_look : road.look1 {\n lanes_left[]: a\n lanes_right[]: b\n lanes_right[]: c\n road_offset: 1.5\n}\nroad_look : road.look1 {\n road_offset: 9\n}\n"


@pytest.fixture
def files(spark, tmp_path):
    items = [
        head(12, 1, 0.0, 0.0) + body("city", 858, {"look": code("alpha"), "width": 50.0, "height": 50.0, "node": 7}),
        head(12, 2, 500.0, 0.0) + body("city", 858, {"look": code("none"), "width": 50.0, "height": 50.0}),
        head(18, 3, 10.0, 10.0) + body("overlay", 858, {"look": code("sign"), "flags": b"\x05\0\0\0\0"}),
        head(18, 4, 99.0, 99.0) + body("overlay", 858, {"look": 0, "flags": b"\0\0\x01\0\0"}),
        head(18, 5, 10.0, 10.0) + body("overlay", 858, {"look": code("sign"), "flags": b"\xff\0\0\0\0"}),
        head(18, 6, 10.0, 10.0) + body("overlay", 858, {"look": code("lost")}),
        head(4, 20, 20.0, 20.0) + body("prefab", 858, {"look": code("pre"), "nodes": [7], "origin": 0}),
        head(6, 21, 90.0, 90.0) + body("company", 858, {"look": code("firm"), "prefab": 20}),
        head(6, 22, 91.0, 91.0) + body("company", 858, {"look": code("firm"), "prefab": 999}),
        head(19, 23, 30.0, 30.0) + body("ferry", 858, {"look": code("p1"), "flags": b"\x01\0\0\0\0"}),
        head(37, 24, 40.0, 40.0) + body("bus_stop", 858, {}),
        head(37, 25, 400.0, 40.0) + body("bus_stop", 858, {}),
        head(3, 26, 0.0, 0.0) + body("road", 858, {"look": code("look1"), "start": 7, "end": 8}),
    ]
    icons = {f"material/ui/map/{n}.mat": f'material : "ui" {{\n texture : "{n}.tobj"\n}}'.encode() for n in ("sign", "parking_ico", "train_ico", "gas_ico")}
    icons["material/ui/company/small/firm.mat"] = b'texture : "/material/ui/map/sign.tobj"'
    icons |= {f"material/ui/map/{n}.tobj": bytes(0x30) + f"/tex/{n}.dds".encode() for n in ("sign", "parking_ico", "train_ico", "gas_ico")}
    icons |= {f"tex/{n}.dds": texture(w, 4) for n, w in (("sign", 8), ("parking_ico", 4), ("train_ico", 4), ("gas_ico", 4))}
    base = {
        "def/city.sii": b'# x\n@include "city/alpha.sui"\n@include "city/again.sui"\n', "def/city/alpha.sui": CITY.encode(), "def/city/again.sui": CITY.replace("Alpha", "Later").encode(),
        "def/country.sii": b'@include "country/beta.sui"\n', "def/country/beta.sui": b'country_data : country.data.beta {\n country_id: 3\n name: "Beta"\n name_localized: "@@beta@@"\n country_code: "B"\n pos: (1.5, 2, -3)\n}\n',
        "def/world/prefab.sii": b'prefab_model : prefab.pre {\n prefab_desc: "/prefab/pre.ppd"\n category: "x"\n}\n', "def/world/road_look.sii": LOOK.encode(), "prefab/pre.ppd": descriptor(),
        "locale/en_us/local.sii": 'key[]: "alpha"\nval[]: "Alpha EN"\nkey[]: "beta"\nval[]: "Beta EN"\n'.encode(), "map/m.mbd": b"", "map/m/a.base": sector(858, items, [(7, 10.0, 20.0), (8, 110.0, 20.0)]),
    } | icons
    (tmp_path / "base.scs").write_bytes(archive(base))
    return tables.layered(tables.archive_files(spark, str(tmp_path), {"base.scs": 1})).cache()


def test_from_archive_to_exports(spark, files, tmp_path):
    names = tables.locale_names(files)
    sectors = tables.map_sectors(files).select("path", "content")
    t = {
        "items": tables.sector_items(sectors).cache(), "nodes": tables.sector_nodes(sectors), "cities": definitions.with_names(definitions.cities(files), names), "countries": definitions.with_names(definitions.countries(files), names, first_only=True),
        "prefab_definitions": definitions.prefabs(files), "prefabs": tables.prefabs(files.where("path LIKE 'prefab/%'")), "bitmaps": tables.overlay_bitmaps(files),
    }
    assert {r["name"]: (r["token"], r["width"], r["height"]) for r in t["bitmaps"].collect()} == {n: (code(n), w, 4) for n, w in (("sign", 8), ("parking_ico", 4), ("train_ico", 4), ("gas_ico", 4), ("firm", 8))}
    looks = definitions.road_looks(files).collect()
    assert [(r["token"], r["offset"], r["lanes_left"], r["lanes_right"]) for r in looks] == [(code("look1"), 1.5, ["a"], ["b", "c"])]
    exports.write_exports(255, str(tmp_path / "out"), t)
    read = lambda name: json.loads((tmp_path / f"out/{name}.json").read_text())
    assert read("Cities") == [{"Name": "Alpha", "LocalizationToken": "alpha", "Country": "beta", "X": 0.0, "Y": 0.0, "CountryId": 3, "LocalizedNames": {"en_us": "Alpha EN"}}]
    assert read("Countries") == [{"CountryId": 3, "Name": "Beta", "CountryCode": "B", "X": 1.5, "Y": -3.0, "LocalizedNames": {"en_us": "Beta EN"}}]
    city = {"Name": "Alpha EN", "InGameID": "alpha", "Country": "beta"}
    assert sorted(read("BusStop"), key=lambda r: r["X"]) == [{"X": 40.0, "Y": 40.0, "Type": "BusStop", "City": city}, {"X": 400.0, "Y": 40.0, "Type": "BusStop"}]

    turn = math.fmod(math.pi - math.atan2(0.0, 1.0), math.pi) * 2 - math.pi - math.atan2(0.0, 1.0) + math.pi / 2

    def at(x: float, z: float) -> tuple[float, float]:
        dx, dz = x - 1.0, z - 2.0
        return round(10 + dx * math.cos(turn) - dz * math.sin(turn), 3), round(20 + dx * math.sin(turn) + dz * math.cos(turn), 3)

    got = sorted((r["Type"], r["Name"], round(r["X"], 3), round(r["Y"], 3), r.get("ZoomLevelVisibility"), r["Width"], "City" in r) for r in read("Overlays"))
    assert got == sorted(
        [
            ("Overlay", "sign", 10.0, 10.0, 5, 8, True), ("Overlay", "parking_ico", 99.0, 99.0, 0, 4, False), ("Company", "firm", *at(3.0, 2.0), None, 8, False), ("Company", "firm", 91.0, 91.0, None, 8, False),
            ("Train", "train_ico", 30.0, 30.0, None, 4, True), ("Fuel", "gas_ico", *at(1.0, 4.0), None, 4, True), ("Parking", "parking_ico", *at(3.0, 0.0), None, 4, True),
        ]
    )
    image = (tmp_path / "out/Overlays/sign.png").read_bytes()
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (8, 4)
    size = struct.unpack(">I", image[33:37])[0]
    rows = zlib.decompress(image[41 : 41 + size])
    assert len(rows) == 4 * (1 + 32) and rows[:5] == bytes((0, 2, 1, 0, 3))
    road = exports.road_points(t["items"], t["nodes"]).orderBy("pos").collect()
    assert [r["pos"] for r in road] == list(range(8)) and (road[0]["x"], road[0]["y"]) == (10.0, 20.0) and road[-1]["x"] == pytest.approx(110.0)


def test_flags():
    assert exports.wants(255, "cities", "overlay_pngs") and exports.wants(2, "cities") and not exports.wants(2, "cities", "city_names")


def test_places_number_all_rows(spark):
    from cartolyte.operators import runs

    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("o"))
    got = runs.places(rows, ["k"], ["o"], "id", 64).collect()
    for k in range(3):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1)) and [(r["o"], r["id"]) for r in own] == sorted((r["o"], r["id"]) for r in own)


def test_ferry_definitions(spark):
    text = "ferry_connection : conn.aa.bb {\n connection_positions[0]: (256, 0, 512)\n connection_positions[1]: (512, 0, 0)\n connection_directions[0]: (1, 0, 1)\n}\nferry_connection : conn.bb.aa {\n}\nferry_connection : conn.cc.dd{\n}\n"
    out = definitions.ferry_connections(spark.createDataFrame([("def/ferry/connection/a.sii", bytearray(text.encode()))], "path string, content binary"))
    got = {(r["start_token"], r["end_token"]): [tuple(p) for p in r["points"]] for r in out.collect()}
    assert got == {(code("aa"), code("bb")): [(1.0, 2.0, math.atan2(1, 1)), (2.0, 0.0, 0.0)], (code("cc"), code("dd")): []}
    assert spark.range(1).select(token(F.lit("parking_ico"))).first()[0] == code("parking_ico") == tables.PARKING
    assert formats.TYPES[exports.BUS_STOP] == "bus_stop"
