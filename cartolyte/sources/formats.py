"""Decoders of the binary formats: sectors, prefab descriptors, archives, obfuscated text and textures.

Plain functions over bytes; the Spark sources call them for the file that a task holds.
"""

from __future__ import annotations

import math
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import numpy as np

# Fixed values of the formats. --------------------------------------------------------------------------------------
ARCHIVE_MAGIC, ARCHIVE_METHOD, TEXT_MAGIC = b"SCS#", b"CITY", b"3nK"
ROOTS = ("def", "def/world", "map", "material", "prefab", "prefab2", "model", "model2", "locale")
TYPES = {
    3: "road", 4: "prefab", 6: "company", 7: "service", 8: "cut_plane", 12: "city", 18: "overlay", 19: "ferry", 22: "garage", 34: "trigger", 35: "fuel_pump",
    36: "road_side", 37: "bus_stop", 38: "traffic_rule", 41: "trajectory", 42: "map_area", 46: "cutscene", 48: "visibility_area",
}
KEPT = frozenset(("road", "prefab", "company", "city", "overlay", "ferry", "trigger", "bus_stop", "map_area", "cutscene"))
GUARDS = {"ets2": 12, "ats": 19}

#: Item bodies by first version. ``+n`` skips bytes; ``name=c`` reads a value (Q u64, I u32, f f32, B u8); ``[n]`` is a
#: counted list of rows that is skipped, ``name[Q]`` one of ids that is kept, ``name[q]`` the same with a u8 count in
#: four bytes; ``(n*name)`` skips n bytes for each id of a kept list. Names in ``CALLS`` are functions below.
LAYOUTS: dict[str, dict[int, str]] = {
    "road": {
        0: "+9 look=Q +72 start=Q end=Q +304 [24] [16]",
        829: "+9 look=Q +72 start=Q end=Q +304 [24] [20]",
        846: "+9 look=Q +80 start=Q end=Q +308 [24] [20]",
        854: "+9 look=Q +164 start=Q end=Q +4",
    },
    "prefab": {
        0: "+5 look=Q +16 nodes[Q] [8] +8 origin=B +1 (56*nodes) [32] +4 [16]",
        829: "+5 look=Q +16 [8] nodes[q] [8] +8 origin=B +1 (56*nodes) [32] +4 [20]",
        831: "+5 look=Q +16 [8] nodes[q] [8] +8 origin=B +1 (56*nodes) [32] +4 [20] (24*nodes)",
        846: "+5 look=Q +16 [8] nodes[q] [8] +8 origin=B +1 (58*nodes) [32] +4 [20] (24*nodes)",
        854: "+5 look=Q +8 [8] nodes[Q] [8] +8 origin=B +1 (12*nodes)",
        855: "+5 look=Q +8 [8] nodes[Q] [8] +8 origin=B +1 (12*nodes) +8",
    },
    "company": {0: "+5 look=Q +8 prefab=Q +8 [8] [8] [8] [8] [8]", 858: "+5 look=Q +8 prefab=Q +8 [8] [8] [8] [8] [8] [8]"},
    "service": {0: "+21", 855: "+21 [8]"},
    "cut_plane": {0: "+5 [8]"},
    "city": {0: "+5 look=Q width=f height=f node=Q"},
    "overlay": {0: "+5 look=Q +8"},
    "ferry": {0: "+5 look=Q +28"},
    "garage": {0: "+33", 855: "+33 [8]"},
    "trigger": {0: "+5 nodes[Q] [8] actions_a", 829: "+5 [8] nodes[Q] actions_b", 875: "+5 [8] nodes[Q] actions_c"},
    "fuel_pump": {0: "+21", 855: "+21 [8]"},
    "road_side": {0: "+93 signs_a", 846: "+93 signs_b", 855: "+93 signs_c", 875: "+37 templates signs_c"},
    "bus_stop": {0: "+29", 836: "+33", 847: "+29"},
    "traffic_rule": {0: "+5 [8] +12", 834: "+5 [8] [8] +12"},
    "trajectory": {0: "+5 [8] +8 [8] [20] [16] +4", 846: "+5 [8] +12 [28] [16] +4"},
    "map_area": {0: "+5 nodes[Q] color=I"},
    "cutscene": {884: "+5 [8] +8 scene"},
    "visibility_area": {891: "+21 [8]"},
}
_STEP = re.compile(r"\+(\d+)|(\w+)=(\w)|(\w*)\[(\w+)\]|\((\d+)\*(\w+)\)|(\w+)")


class FormatError(ValueError):
    """A file that doesn't follow its format."""


class Cursor:
    """A position in little-endian bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, code: str):
        (value,) = struct.unpack_from("<" + code, self.data, self.at)
        self.at += struct.calcsize(code)
        return value

    def skip(self, n: int) -> None:
        self.at += n

    def rows(self, width: int) -> None:
        self.skip(width * self.read("i"))

    def ids(self, code: str) -> list[int]:
        n = self.read("i")
        n = n & 0xFF if code == "q" else n
        out = list(struct.unpack_from(f"<{n}q", self.data, self.at))
        self.at += 8 * n
        return out


def _text(c: Cursor) -> None:
    c.skip(4 + c.read("i"))


def _signs(c: Cursor, before: int, counted: bool) -> None:
    if length := c.read("i"):
        c.at += 4 + length
    for _ in range(c.read("i")):
        c.at += before
        for _ in range(c.read("i")):
            kind, count = c.read("h"), c.read("i")
            if kind == 5:
                _text(c)
            elif kind == 6 and counted:
                c.at += 8 * count
            else:
                c.at += 1 if kind == 1 else 4


def _templates(c: Cursor, item: dict) -> None:
    c.skip(24 * c.read("b"))


def _actions(c: Cursor, item: dict, version: str) -> None:
    for _ in range(c.read("i")):
        item["actions"].append(c.read("q"))
        if version != "a":
            overrides = c.read("i")
            if version == "c" and overrides < 0:
                continue
            c.at += 4 * max(overrides, 0)
        given = c.read("i")
        if version == "c":
            for _ in range(given):
                _text(c)
            c.rows(8)
            c.at += 8
            continue
        if given == 1:
            _text(c)
        elif given == 3:
            c.at += 8
        c.at += 8 if version == "b" else 0
        c.rows(8)
    c.at += (4 if len(item["nodes"]) == 1 else 0) if version == "c" else 24


def _scene(c: Cursor, item: dict) -> None:
    for _ in range(c.read("i")):
        c.rows(4)
        for _ in range(c.read("i")):
            _text(c)
        c.rows(8)
        c.at += 8


CALLS = {
    "actions_a": lambda c, i: _actions(c, i, "a"),
    "actions_b": lambda c, i: _actions(c, i, "b"),
    "actions_c": lambda c, i: _actions(c, i, "c"),
    "signs_a": lambda c, i: _signs(c, 4, False),
    "signs_b": lambda c, i: _signs(c, 12, False),
    "signs_c": lambda c, i: _signs(c, 12, True),
    "templates": _templates,
    "scene": _scene,
}


def _layout(kind: str, version: int) -> str:
    fitting = [v for v in LAYOUTS[kind] if v <= version]
    if not fitting:
        raise FormatError(f"{kind} has no layout for version {version}")
    return LAYOUTS[kind][max(fitting)]


def layout_steps(kind: str, version: int) -> list[tuple[str, ...]]:
    """The steps of an item's body: (skip, name, code, kept list, its row width, bytes for each, of which list, call)."""
    return _STEP.findall(_layout(kind, version))


def _hidden(kind: str, data: bytes, body: int, guard: int) -> bool:
    signed = lambda k: struct.unpack_from("<b", data, body + k)[0]
    if kind == "road":
        return signed(6) > guard or bool(data[body + 3] & 2)
    if kind == "prefab":
        return signed(1) > guard or bool(data[body + 2] & 2)
    if kind == "city":
        return bool(data[body] & 1)
    if kind == "overlay":
        return signed(1) > guard or data[body] == 255
    return signed(1) > guard if kind in ("company", "trigger", "map_area") else False


def read_item(data: bytes, at: int, version: int, guard: int) -> tuple[str, dict, int]:
    """(kind, item, end) of the item that starts at ``at``."""
    code, uid = struct.unpack_from("<IQ", data, at)
    kind = TYPES.get(code + (version <= 825))
    if kind is None:
        raise FormatError(f"unknown item type {code} at {at}")
    body = at + 52
    x, z = struct.unpack_from("<f", data, at + 12)[0], struct.unpack_from("<f", data, at + 20)[0]
    item = {"type": code + (version <= 825), "uid": uid - (1 << 64) if uid >> 63 else uid, "x": x, "z": z, "hidden": _hidden(kind, data, body, guard), "nodes": [], "actions": [], "flags": data[body : body + 5]}
    c = Cursor(data, body)
    for skip, name, code_, list_, width, each, of, call in layout_steps(kind, version):
        if skip:
            c.at += int(skip)
        elif name:
            item[name] = c.read("q" if code_ == "Q" else code_)
        elif width:
            if list_:
                item[list_] = c.ids(width)
            else:
                c.rows(int(width))
        elif each:
            c.at += int(each) * len(item[of])
        else:
            CALLS[call](c, item)
    return kind, item, c.at


def read_sector(data: bytes, game: str = "ets2", types: frozenset[str] = KEPT, strict: bool = True) -> tuple[list[tuple[str, dict]], list[dict]]:
    """(items, nodes) of a sector file; only items of the asked types are kept, the others are measured.

    A sector of no items has no nodes. ``strict`` raises if the file has other bytes at its end or an unknown item;
    else reading stops there.
    """
    version = struct.unpack_from("<i", data, 0)[0]
    if version < 825:
        raise FormatError(f"version {version} is below 825")
    count, at, items, nodes = struct.unpack_from("<I", data, 16)[0], 20, [], []
    if not count:
        return items, nodes
    try:
        for _ in range(count):
            kind, item, at = read_item(data, at, version, GUARDS[game])
            viewpoint = kind != "cutscene" or item["flags"][3] == 0
            if kind in types and viewpoint:
                items.append((kind, item))
        c = Cursor(data, at)
        for _ in range(c.read("i")):
            uid, x, _, z, rx, _, rz = struct.unpack_from("<qiiifff", data, c.at)
            turn = math.fmod(math.pi - math.atan2(rz, rx), math.pi) * 2
            nodes.append({"uid": uid, "x": x / 256, "z": z / 256, "rotation": turn})
            c.at += 56
        if version >= 891:
            c.rows(8)
        if c.at != len(data):
            raise FormatError(f"read up to {c.at} of {len(data)} bytes")
    except (FormatError, struct.error) as e:
        if strict:
            raise FormatError(str(e)) from e
    return items, nodes


def read_prefab(data: bytes) -> dict:
    """The four record arrays of a prefab descriptor."""
    from cartolyte.operators.flags import CONTROL_NODES, LANE_OFFSETS, LANES

    version, nodes, curves = struct.unpack_from("<iii", data, 0)
    if version < 21:
        raise FormatError(f"prefab version {version} is below 21")
    spawns, points, triggers = (struct.unpack_from("<i", data, k)[0] for k in (0x14, 0x20, 0x24))
    base = 0x2C + 4 * (version > 21)
    at_nodes, at_spawns, at_points, at_triggers = (struct.unpack_from("<i", data, base + k)[0] for k in (0, 0x10, 0x20, 0x24))
    f = lambda at: struct.unpack_from("<f", data, at)[0]
    out = {"valid_road": curves != 0, "nodes": [], "spawn_points": [], "map_points": [], "trigger_points": []}
    for a in range(at_nodes, at_nodes + 0x68 * nodes, 0x68):
        lanes = struct.unpack_from("<16i", data, a + 0x28)
        out["nodes"].append((f(a + 0x10), f(a + 0x18), f(a + 0x1C), f(a + 0x24), 16 - lanes.count(-1)))
    for a in range(at_spawns, at_spawns + 0x20 * spawns, 0x20):
        out["spawn_points"].append((f(a), f(a + 8), struct.unpack_from("<I", data, a + 0x1C)[0]))
    for a in range(at_points, at_points + 0x30 * points, 0x30):
        look, color, control, nav = data[a + 1], data[a + 2], data[a + 4], data[a + 5]
        n = struct.unpack_from("<i", data, a + 0x2C)[0]
        near = list(struct.unpack_from(f"<{n}i", data, a + 0x14))
        out["map_points"].append((f(a + 8), f(a + 0x10), LANES.get(look & 15, 1), LANE_OFFSETS.get(look >> 4, 0), bool(nav & 2), color, CONTROL_NODES.get(control, -1), near))
    for a in range(at_triggers, at_triggers + 0x30 * triggers, 0x30):
        out["trigger_points"].append((*struct.unpack_from("<Iq", data, a), f(a + 0x1C), f(a + 0x24)))
    return out


def reveal(data: bytes) -> str:
    """Text of a locale file, plain or obfuscated; only the full magic counts as obfuscated."""
    if data[:3] != TEXT_MAGIC or len(data) < 6:
        return data.decode("utf-8", "replace")
    body = np.frombuffer(data, np.uint8)[6:]
    key = (data[5] + np.arange(len(body))).astype(np.uint8)
    mask = ((((key << 2) ^ ~key) << 3) ^ key).astype(np.uint8)
    return (body ^ mask).tobytes().decode("utf-8", "replace")


def texture_path(data: bytes) -> str:
    """The texture that a pointer file names."""
    return data[0x30:].decode("utf-8", "replace").lstrip("/")


def read_texture(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, BGRA) of a DDS file: DXT3, DXT5 or 32 bits a pixel."""
    if data[:4] != b"DDS " or data[4:8] != b"\x7c\0\0\0":
        raise FormatError("no DDS header")
    height, width = struct.unpack_from("<II", data, 0x0C)
    code, body = data[0x54:0x58], np.frombuffer(data, np.uint8)[0x80:]
    if code not in (b"DXT3", b"DXT5"):
        return width, height, body[: 4 * width * height].tobytes()
    rows, columns = -(-height // 4), -(-width // 4)
    block = body[: 16 * rows * columns].reshape(-1, 16)
    ends = block[:, 8:12].copy().view("<u2").astype(np.int32)
    rgb = np.stack([(ends >> 11 & 31) * 255 // 31, (ends >> 5 & 63) * 255 // 63, (ends & 31) * 255 // 31], axis=-1)
    palette = np.stack([rgb[:, 0], rgb[:, 1], (2 * rgb[:, 0] + rgb[:, 1]) // 3, (rgb[:, 0] + 2 * rgb[:, 1]) // 3], axis=1)
    picks = block[:, 12:16].copy().view("<u4") >> np.arange(0, 32, 2, dtype=np.uint32) & 3
    color = np.take_along_axis(palette, picks[:, :, None].astype(np.int64), 1)
    if code == b"DXT3":
        nibbles = np.stack([block[:, :8] & 15, block[:, :8] >> 4], axis=2).reshape(-1, 16)
        alpha = nibbles.astype(np.int32) * 17
    else:
        a = block[:, :2].astype(np.int32)
        steps = np.arange(1, 7)
        seven = (a[:, :1] * (7 - steps) + a[:, 1:] * steps) // 7
        five = np.concatenate([(a[:, :1] * (5 - steps[:4]) + a[:, 1:] * steps[:4]) // 5, np.zeros_like(a[:, :1]), np.full_like(a[:, :1], 255)], axis=1)
        levels = np.concatenate([a, np.where(a[:, :1] > a[:, 1:], seven, five)], axis=1)
        bits = sum(block[:, 2 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(6))
        index = bits[:, None] >> np.arange(0, 48, 3, dtype=np.uint64) & np.uint64(7)
        alpha = np.take_along_axis(levels, index.astype(np.int64), 1)
    pixels = np.concatenate([color[:, :, ::-1], alpha[:, :, None]], axis=2).astype(np.uint8)
    image = pixels.reshape(rows, columns, 4, 4, 4).swapaxes(1, 2).reshape(4 * rows, 4 * columns, 4)
    return width, height, image[:height, :width].tobytes()


_M = (1 << 64) - 1
#: Multipliers of the path hash (fixed values).
_K = (0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557)


def path_hash(path: str) -> int:
    """CityHash64 (version 1.0) of a path, as hashed archives key their entries by."""
    raw = path.encode()
    s, n = raw, len(path)
    k0, k1, k2, k3 = _K
    word = lambda i: int.from_bytes(s[i : i + 8], "little")
    ror = lambda v, r: ((v & _M) >> r | v << (64 - r)) & _M

    def fold(u: int, v: int) -> int:
        m = 0x9DDFEA08EB382D69
        a = ((u ^ v) & _M) * m & _M
        b = ((v ^ a ^ a >> 47) & _M) * m & _M
        return (b ^ b >> 47) * m & _M

    def mix(v: int) -> int:
        v &= _M
        return v ^ v >> 47

    def pair(i: int, a: int, b: int) -> tuple[int, int]:
        w, x, y, z = (word(i + 8 * k) for k in range(4))
        a = a + w & _M
        b = ror(b + a + z, 21)
        c, a = a, a + x + y & _M
        return a + z & _M, b + ror(a, 44) + c & _M

    if n == 0:
        return k2
    if n < 4:
        return mix((s[0] + (s[n >> 1] << 8)) * k2 ^ (n + (s[n - 1] << 2)) * k3) * k2 & _M
    if n <= 8:
        low = int.from_bytes(s[:4], "little")
        return fold(n + (low << 3), int.from_bytes(s[n - 4 : n], "little"))
    if n <= 16:
        a, b = word(0), word(n - 8)
        return fold(a, ror(b + n & _M, n)) ^ b
    if n <= 32:
        a, b, c, d = word(0) * k1, word(8), word(n - 8) * k2, word(n - 16) * k0
        return fold(ror(a - b, 43) + ror(c, 30) + d & _M, a + ror(b ^ k3, 20) - c + n & _M)
    if n <= 64:

        def half(a: int, z: int, i: int) -> tuple[int, int]:
            b, c = ror(a + z, 52), ror(a, 37)
            a += word(i)
            c += ror(a, 7)
            a += word(i + 8)
            return a + z, b + ror(a, 31) + c

        vf, vs = half(word(0) + (n + word(n - 16)) * k0, word(24), 8)
        wf, ws = half(word(16) + word(n - 32), word(n - 8), n - 24)
        return mix(mix((vf + ws) * k2 + (wf + vs) * k0) * k0 + vs) * k2 & _M
    x, y = word(n - 40), word(n - 16) + word(n - 56)
    z = fold(word(n - 48) + n & _M, word(n - 24))
    v, w = pair(n - 64, n, z), pair(n - 32, y + k1, x)
    x = x * k1 + word(0) & _M
    for i in range(0, (n - 1) & ~63, 64):
        x = (ror(x + y + v[0] + word(i + 8), 37) * k1 & _M) ^ w[1]
        y = (ror(y + v[1] + word(i + 48), 42) * k1) + v[0] + word(i + 40) & _M
        z = ror(z + w[0], 33) * k1 & _M
        v = pair(i, v[1] * k1, x + w[0])
        w = pair(i + 32, z + w[1], y + word(i + 16))
        x, z = z, x
    return fold(fold(v[0], w[0]) + mix(y) * k1 + z & _M, fold(v[1], w[1]) + x & _M)


def archive_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of all files of an archive, hashed or ZIP, one at a time."""
    if data[:4] != ARCHIVE_MAGIC:
        with zipfile.ZipFile(BytesIO(data)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        return
    version, _, method, count, start = struct.unpack_from("<HH4sii", data, 4)
    if version != 1 or method != ARCHIVE_METHOD:
        raise FormatError("unsupported archive version or hash method")
    entries = {}
    for key, at, flags, _, size, packed in struct.iter_unpack("<QqIIii", data[start : start + 32 * count]):
        entries[key] = (at, flags, size, packed)

    def content(entry) -> bytes:
        at, _, size, packed = entry
        raw = data[at : at + packed]
        return zlib.decompress(raw) if size != packed else raw

    root = entries.get(path_hash(""))
    todo, seen = [""] if root is not None and root[2] else list(ROOTS), set()
    while todo:
        folder = todo.pop()
        entry = entries.get(path_hash(folder))
        if entry is None or folder in seen:
            continue
        seen.add(folder)
        for line in content(entry).decode("utf-8", "replace").splitlines():
            name = f"{folder}/{line.lstrip('*')}".lstrip("/")
            if line.startswith("*"):
                todo.append(name)
            elif line and name not in seen and (found := entries.get(path_hash(name))) is not None:
                seen.add(name)
                yield name, content(found)
