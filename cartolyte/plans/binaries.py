"""Queries over files of the binary formats: expressions write the tables' rows as files, the sources decode them.

Files are made as hex text, little-endian, and become bytes at the end. A sector holds the rows of 256 order keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.operators import polygons
from cartolyte.plans.catalogue import _table, query_into
from cartolyte.sources import formats, tables
from cartolyte.sources.shared import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_query = query_into(QUERIES, ORACLE_SQL)

#: Versions that sectors take by turns, and how many of the item types, in the order of the formats' table, each knows.
VERSIONS = {825: 16, 846: 16, 858: 16, 884: 17, 891: 18}


def _rows(spark, d, name: str, key: str) -> DataFrame:
    """A table's rows spread over tasks: it is small where the files made of its rows are not, so its own splits are too few."""
    return spread(_table(spark, d, name), key)


def _int(v: Column | int, width: int) -> Column:
    """An integer of ``width`` bytes."""
    v = (F.lit(v) if isinstance(v, int) else v).cast("long")
    nibble = F.lit(0x0F0F0F0F0F0F0F0F)
    # Half-bytes change places before the digits are reversed; a regular expression over the digits costs many times that.
    swapped = F.shiftleft(v.bitwiseAND(nibble), 4).bitwiseOR(F.shiftright(v, 4).bitwiseAND(nibble))
    return F.left(F.reverse(F.lpad(F.hex(swapped), 16, "0")), F.lit(2 * width))


def _float(v: Column | int) -> Column:
    """A whole number below 2**24 as a 32-bit float: sign, exponent and the bits after the first."""
    v = (F.lit(v) if isinstance(v, int) else v).cast("long")
    size, shift = F.abs(v), lambda a, n: F.call_function("shiftleft", a, n)
    exponent = F.length(F.bin(size)) - 1
    bits = shift((exponent + 127).cast("long"), F.lit(23)) + shift(size - shift(F.lit(1).cast("long"), exponent), 23 - exponent)
    return _int(F.when(v == 0, F.lit(0).cast("long")).otherwise(bits + F.when(v < 0, F.lit(1 << 31)).otherwise(F.lit(0))), 4)


def _zeros(n: int) -> Column:
    return F.lit("00" * n)


def _some(parts: list[Column], count: Column) -> Column:
    """The first ``count`` of the parts."""
    return F.array_join(F.slice(F.array(*parts), F.lit(1), count.cast("int")), "")


def _text(v: Column) -> Column:
    return F.hex(F.encode(v, "UTF-8"))


def _file(path: Column, content: Column) -> list[Column]:
    return [path.alias("path"), F.unhex(content).alias("content")]


def _action(which: str, action: Column) -> Column:
    if which == "actions_a":
        return F.concat(_int(action, 8), _zeros(8))
    if which == "actions_b":
        return F.concat(_int(action, 8), _zeros(20))
    return F.concat(_int(action, 8), F.when(action % 2 == 0, _int(-1, 4)).otherwise(F.concat(_int(1, 4), _zeros(20))))


def _body(kind: str, version: int) -> Column:
    """An item's body by its layout, of columns that :func:`_sectors` makes: kept lists hold ``ids``, other lists one row of zeros."""
    parts = []
    for skip, name, _, kept, width, each, _, call in formats.layout_steps(kind, version):
        if skip:
            parts += [_zeros(int(skip))] if parts else [F.col("flags"), _zeros(int(skip) - 5)]
        elif name:
            parts.append(F.col("overlay_look" if (kind, name) == ("overlay", "look") else name))
        elif kept:
            parts.append(F.col("ids"))
        elif width:
            parts.append(F.lit("01000000" + "00" * int(width)))
        elif each:
            parts.append(F.repeat(_zeros(int(each)), F.col("n_ids")))
        elif call.startswith("actions"):
            parts.append(F.col(call))
        elif call.startswith("signs"):
            # One board of two values: a byte, and a text of three.
            parts.append(F.lit("00" * 4 + "01000000" + "00" * (4 if call == "signs_a" else 12) + "02000000" + "0100" + "00" * 5 + "0500" + "00" * 4 + "03000000" + "00" * 7))
        elif call == "templates":
            parts.append(F.lit("01" + "00" * 24))
        else:
            parts.append(F.lit("01000000" + "00" * 20))
    return F.concat(*parts)


def _sectors(spark, d) -> DataFrame:
    """(path, content): sector files, each with an item and a node for each order."""
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    b0 = F.when(k % 11 == 0, 255).otherwise(F.floor(k / 5) % 3)
    b2, b3 = F.floor(k / 36) % 3, F.floor(k / 18) % 2 * 2
    n_ids = (k % 4).cast("int")
    actions = lambda which: F.concat(_int(2, 4), _action(which, k), _action(which, k + 5))
    # Every value once; items put them together.
    values = _rows(spark, d, "orders", "o_orderkey").select(
        k.alias("k"), F.floor(k / 256).alias("block"), n_ids.alias("n_ids"), F.concat(_int(n_ids, 4), _some([_int(k + i, 8) for i in range(3)], n_ids)).alias("ids"),
        F.concat(_int(b0, 1), _int(k * 11 % 256, 1), _int(b2, 1), _int(b3, 1), _zeros(1)).alias("flags"),
        F.concat(_int(F.when(k % 7 == 0, -k).otherwise(k * 1000003), 8), _float(c - 500), _zeros(4), _float(-(k % 4096)), _zeros(28)).alias("start_of_item"),
        _int(c * 7919 + k, 8).alias("look"), _int(c % 3, 8).alias("overlay_look"), _int(k - 1, 8).alias("start"), _int(k + 1, 8).alias("end"), _int(k * 3, 8).alias("node"), _int(-k, 8).alias("prefab"),
        _int(c, 4).alias("color"), _int(k % 6, 1).alias("origin"), _float(c % 100).alias("width"), _float(k % 50).alias("height"),
        F.concat(actions("actions_a"), _zeros(24)).alias("actions_a"), F.concat(actions("actions_b"), _zeros(24)).alias("actions_b"), F.concat(actions("actions_c"), F.when(n_ids == 1, _zeros(4)).otherwise(F.lit(""))).alias("actions_c"),
        F.concat(_int(F.floor(k / 3), 8), _int(c, 4), _zeros(4), _int(-k, 4), _float(1), _zeros(4), _float(k % 9 - 4), _zeros(24)).alias("node_row"),
    )
    item = F
    for turn, (version, n) in enumerate(VERSIONS.items()):
        body = F
        for i, (code, kind) in enumerate(list(formats.TYPES.items())[:n]):
            code -= version <= 825
            body = body.when(F.col("k") % n == i, F.concat(F.lit(code.to_bytes(4, "little").hex()), F.col("start_of_item"), _body(kind, version)))
        item = item.when(F.col("block") % len(VERSIONS) == turn, body)
    held = values.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", item.alias("item"), "node_row"))).alias("r"))
    version = F.element_at(F.array(*map(F.lit, VERSIONS)), (F.col("block") % len(VERSIONS) + 1).cast("int"))
    joined = lambda part: F.array_join(F.transform("r", lambda x: x[part]), "")
    end = F.when(version >= 891, F.concat(_int(1, 4), _zeros(8))).otherwise(F.lit(""))
    content = F.concat(_int(version, 4), _zeros(12), _int(F.size("r"), 4), joined("item"), _int(F.size("r"), 4), joined("node_row"), end)
    return held.select(*_file(F.format_string("map/m/%012d.base", "block"), content))


_SECTORS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 256 AS b FROM orders),
    v AS (SELECT *, [16, 16, 16, 17, 18][(b % 5 + 1)::INT] AS n, ((dense_rank() OVER (ORDER BY b) - 1) << 32) + row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS load_seq FROM o)"""


@_query(
    "q52_sector_items",
    f"""WITH {_SECTORS},
             i AS (SELECT *, [3, 4, 6, 7, 8, 12, 18, 19, 22, 34, 35, 36, 37, 38, 41, 42, 46, 48][(k % n + 1)::INT] AS type, CASE WHEN k % 11 = 0 THEN 255 ELSE k // 5 % 3 END AS b0, k * 11 % 256 AS b1, k // 36 % 3 AS b2, k // 18 % 2 * 2 AS b3 FROM v)
        SELECT (load_seq >> 32 << 32) + row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS load_seq, type, CASE WHEN k % 7 = 0 THEN -k ELSE k * 1000003 END AS uid, (c - 500)::DOUBLE AS x, (-(k % 4096))::DOUBLE AS z,
               CASE WHEN type = 3 THEN b3 = 2 WHEN type = 4 THEN b1 BETWEEN 13 AND 127 OR b2 = 2 WHEN type = 12 THEN b0 % 2 = 1 WHEN type = 18 THEN b1 BETWEEN 13 AND 127 OR b0 = 255 WHEN type IN (6, 34, 42) THEN b1 BETWEEN 13 AND 127 ELSE false END AS hidden,
               coalesce((CASE WHEN type = 18 AND c % 3 = 0 AND b2 = 1 THEN {tables.PARKING} WHEN type = 18 THEN c % 3 WHEN type IN (3, 4, 6, 12, 19) THEN c * 7919 + k END)::VARCHAR, '') AS look_token,
               coalesce((CASE WHEN type = 4 THEN k % 6 END)::VARCHAR, '') AS origin, CASE WHEN type IN (4, 34, 42) THEN array_to_string([k, k + 1, k + 2][1:(k % 4)::INT], ',') ELSE '' END AS nodes,
               coalesce((CASE WHEN type = 3 THEN k - 1 END)::VARCHAR, '') AS start_uid, coalesce((CASE WHEN type = 3 THEN k + 1 END)::VARCHAR, '') AS end_uid, coalesce((CASE WHEN type = 12 THEN k * 3 END)::VARCHAR, '') AS node_uid, CASE WHEN type = 12 THEN (c % 100)::DOUBLE END AS width, CASE WHEN type = 12 THEN (k % 50)::DOUBLE END AS height,
               coalesce((CASE WHEN type = 18 THEN b0 END)::VARCHAR, '') AS zoom_visibility, coalesce((CASE WHEN type = 19 THEN b0 > 0 END)::VARCHAR, '') AS is_train, coalesce((CASE WHEN type = 6 THEN -k END)::VARCHAR, '') AS prefab_uid, CASE WHEN type = 34 THEN k || ',' || (k + 5) ELSE '' END AS actions, coalesce((CASE WHEN type = 42 THEN c END)::VARCHAR, '') AS color_index, coalesce((CASE WHEN type = 42 THEN b0 > 0 END)::VARCHAR, '') AS draw_over
        FROM i WHERE type <> 46 OR b3 = 0""",
)
def q52(spark, d):
    out = tables.sector_items(_sectors(spark, d), types=frozenset(formats.TYPES.values()))
    shown = {"x": "double", "z": "double", "width": "double", "height": "double", "type": "long"}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select(*(listed(c) if c in ("nodes", "actions") else F.col(c).cast(shown[c]).alias(c) if c in shown else F.col(c) if c in ("load_seq", "uid", "hidden") else text(c) for c in out.columns))


@_query(
    "q53_sector_nodes",
    f"""WITH {_SECTORS}, f AS (SELECT k // 3 AS uid, min_by({{'k': k, 'c': c, 's': load_seq}}, load_seq) AS r FROM v GROUP BY 1)
        SELECT r.s AS load_seq, uid, r.c / 256.0::DOUBLE AS x, -r.k / 256.0::DOUBLE AS z, round(fmod(pi() - atan2(r.k % 9 - 4, 1), pi()) * 2, 3) AS rotation FROM f""",
)
def q53(spark, d):
    out = tables.sector_nodes(_sectors(spark, d))
    return out.select("load_seq", "uid", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"), F.round(F.col("rotation").cast("double"), 3).alias("rotation"))


def _prefabs(spark, d) -> DataFrame:
    """(path, content): a descriptor for each part, of a road between two points and an area of four."""
    k = F.col("p_partkey").cast("long")
    nodes, spawns, triggers = F.floor(k / 2) % 2 + 1, k % 3, k % 2

    def node(j: int) -> Column:
        count = k % 5 + 1 if j == 0 else k % 3 + 2
        lanes = F.concat(F.repeat(_int(j, 4), count.cast("int")), F.repeat(_int(-1, 4), (16 - count).cast("int")))
        return F.concat(_zeros(0x10), _float(k % 90 + j), _zeros(4), _float(-j), _float(1), _zeros(4), _float(j), lanes)

    def point(look: Column, color: Column, control: Column, nav: Column, x: Column, z: Column, neighbour: int) -> Column:
        return F.concat(_zeros(1), _int(look, 1), _int(color, 1), _zeros(1), _int(control, 1), _int(nav, 1), _zeros(2), _float(x), _zeros(4), _float(z), _int(neighbour, 4), _zeros(20), _int(1, 4))

    zero = F.lit(0)
    points = [
        point(F.when(k % 3 == 0, 14).otherwise(1) + k % 8 * 16, zero, k % 2, zero, k % 90, zero, 1),
        point(F.when(k % 4 == 0, 14).otherwise(2) + F.floor(k / 8) % 8 * 16, zero, F.lit(2), F.when(k % 5 == 0, 2).otherwise(0), k % 90 + 10 + k % 7, k % 11, 0),
        *(point(F.lit(13), (k + i) % 16, zero, zero, k % 90 + x, F.lit(z), 2 + (i + 1) % 4) for i, (x, z) in enumerate(((0, 0), (10, 0), (10, 10), (0, 10)))),
    ]
    spawn = [F.concat(_float(k % 50 + j), _zeros(4), _float(j), _zeros(16), _int(k % 20, 4)) for j in range(2)]
    trigger = [F.concat(_int(k + 7, 4), _int(-k, 8), _zeros(16), _float(k % 30), _zeros(4), _float(-(k % 40)), _zeros(8))]
    # The header's end is the first record; offsets stand four bytes later from version 22 on.
    at_nodes = F.lit(0x60)
    at_spawns = at_nodes + 0x68 * nodes
    at_points = at_spawns + 0x20 * spawns
    offsets = F.concat(_int(at_nodes, 4), _zeros(12), _int(at_spawns, 4), _zeros(12), _int(at_points, 4), _int(at_points + 0x30 * len(points), 4))
    table = F.when(k % 2 == 0, F.concat(offsets, _zeros(12))).otherwise(F.concat(_zeros(4), offsets, _zeros(8)))
    head = F.concat(_int(21 + k % 2, 4), _int(nodes, 4), _int(k % 6, 4), _zeros(8), _int(spawns, 4), _zeros(8), _int(len(points), 4), _int(triggers, 4), _zeros(4), table)
    content = F.concat(head, _some([node(0), node(1)], nodes), _some(spawn, spawns), *points, _some(trigger, triggers))
    return _rows(spark, d, "part", "p_partkey").select(*_file(F.format_string("prefab/%d.ppd", k), content))


_LANE_OFFSET = "[0, 1, 2, 5, 10, 15, 20, 25]"


@_query(
    "q54_prefab_descriptors",
    f"""WITH p AS (SELECT p_partkey AS k, p_partkey // 2 % 2 + 1 AS n FROM part)
        SELECT 'prefab/' || k || '.ppd' AS path, k % 6 <> 0 AS valid_road, array_to_string([(k % 90) || ' 0 1 0 ' || (k % 5 + 1), (k % 90 + 1) || ' -1 1 1 ' || (k % 3 + 2)][1:n::INT], ';') AS nodes,
               array_to_string([(k % 50) || ' 0 ' || (k % 20), (k % 50 + 1) || ' 1 ' || (k % 20)][1:(k % 3)::INT], ';') AS spawn_points,
               concat_ws(';', (k % 90) || ' 0 ' || (CASE WHEN k % 3 = 0 THEN -2 ELSE 2 END) || ' ' || {_LANE_OFFSET}[(k % 8 + 1)::INT] || ' false 0 ' || (CASE WHEN k % 2 = 1 THEN 0 ELSE -1 END) || ' 1',
                         (k % 90 + 10 + k % 7) || ' ' || (k % 11) || ' ' || (CASE WHEN k % 4 = 0 THEN -2 ELSE 4 END) || ' ' || {_LANE_OFFSET}[(k // 8 % 8 + 1)::INT] || ' ' || (k % 5 = 0) || ' 0 1 0',
                         (k % 90) || ' 0 -1 0 false ' || (k % 16) || ' -1 3', (k % 90 + 10) || ' 0 -1 0 false ' || ((k + 1) % 16) || ' -1 4',
                         (k % 90 + 10) || ' 10 -1 0 false ' || ((k + 2) % 16) || ' -1 5', (k % 90) || ' 10 -1 0 false ' || ((k + 3) % 16) || ' -1 2') AS map_points,
               CASE WHEN k % 2 = 1 THEN (k + 7) || ' ' || -k || ' ' || (k % 30) || ' ' || -(k % 40) ELSE '' END AS trigger_points
        FROM p""",
)
def q54(spark, d):
    whole = ("x", "z", "rot_x", "rot_z")

    def rows(c: str, *fields: str) -> Column:
        shown = lambda p, f: p[f].cast("long").cast("string") if f in whole else F.array_join(p[f].cast("array<string>"), ",") if f == "neighbours" else p[f].cast("string")
        return F.array_join(F.transform(c, lambda p: F.concat_ws(" ", *(shown(p, f) for f in fields))), ";").alias(c)

    return tables.prefabs(_prefabs(spark, d)).select(
        "path", "valid_road", rows("nodes", *whole, "lane_count"), rows("spawn_points", "x", "z", "type"),
        rows("map_points", "x", "z", "lane_count", "lane_offset", "hidden", "color_flags", "control_node", "neighbours"), rows("trigger_points", "trigger_id", "action", "x", "z"),
    )


@_query(
    "q55_prefab_shapes",
    f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 90 AS x0, p_partkey % 90 + 10 + p_partkey % 7 AS x1, p_partkey % 11 AS z1, {_LANE_OFFSET}[(p_partkey % 8 + 1)::INT] AS f0, {_LANE_OFFSET}[(p_partkey // 8 % 8 + 1)::INT] AS f1,
                          CASE WHEN p_partkey % 3 <> 0 THEN 2 WHEN p_partkey % 2 = 1 THEN p_partkey % 5 + 1 END AS own, CASE WHEN p_partkey % 4 <> 0 THEN 4 WHEN p_partkey // 2 % 2 = 1 THEN p_partkey % 3 + 2 END AS other FROM part),
             q AS (SELECT *, coalesce(own, other, 1) AS a, coalesce(other, own, 1) AS b, atan2(z1, x1 - x0) AS yaw FROM p WHERE k % 5 <> 0),
             c AS (SELECT k, v, CASE WHEN v IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN v IN (0, 3) THEN 0 ELSE z1 END AS z, yaw + CASE WHEN v < 2 THEN pi() / 2 ELSE -pi() / 2 END AS turn, (4.5::DOUBLE * CASE WHEN v IN (0, 3) THEN a ELSE b END + CASE WHEN v = 1 THEN f1 ELSE f0 END) / 2 AS half FROM q, range(0, 4) t(v)),
             s AS (SELECT k, s, v, (k + (s + 1) % 4) % 16 AS flags, (s + 1 + v) % 4 AS corner FROM p, range(0, 4) t(s), range(0, 4) u(v))
        SELECT 'prefab/' || k || '.ppd' AS path, 0 AS look_no, v AS pos, 4 AS z_index, 'road' AS color, round(x + half * cos(turn), 3) + 0.0 AS x, round(z + half * sin(turn), 3) + 0.0 AS z FROM c
        UNION ALL
        SELECT 'prefab/' || k || '.ppd', s + CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END, v, CASE WHEN flags % 2 = 1 THEN 3 ELSE 2 END, CASE WHEN flags & 2 > 0 THEN 'light' WHEN flags & 4 > 0 THEN 'dark' WHEN flags & 8 > 0 THEN 'green' ELSE 'light' END,
               k % 90 + [0, 10, 10, 0][(corner + 1)::INT], [0, 0, 10, 10][(corner + 1)::INT] FROM s""",
)
def q55(spark, d):
    out = polygons.shapes(tables.prefabs(_prefabs(spark, d))).select("path", F.col("look_no").cast("long").alias("look_no"), F.col("z_index").cast("long").alias("z_index"), "color", F.posexplode("points").alias("pos", "p"))
    return out.select("path", "look_no", F.col("pos").cast("long").alias("pos"), "z_index", "color", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.z", 3) + 0.0).alias("z"))


def _obfuscated(text: Column, key: Column) -> Column:
    """Text as locale files hide it: each byte meets a mask that follows from a running key."""
    digits = _text(text)

    def hidden(i: Column) -> Column:
        k = (key + i) % 256
        mask = F.shiftleft(F.shiftleft(k, 2).bitwiseXOR(F.bitwise_not(k)), 3).bitwiseXOR(k)
        return _int(F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(mask).bitwiseAND(F.lit(255)), 1)

    every = F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    return F.concat(F.hex(F.lit(formats.TEXT_MAGIC)), F.lit("0100"), _int(key, 1), F.array_join(F.transform(every, hidden), ""))


@_query("q56_locale_names", "SELECT 'l' || p_partkey % 7 AS locale, 'p' || p_size AS key, arg_min(p_name || ' é', p_partkey) AS name FROM part GROUP BY ALL")
def q56(spark, d):
    k = F.col("p_partkey").cast("int")
    text = F.concat(F.lit('key[]: "p'), "p_size", F.lit('"\nval[]: "'), "p_name", F.lit(' é"\nval[]: "later"\n'))
    content = F.when(k % 2 == 0, _text(text)).otherwise(_obfuscated(text, k * 37 % 256))
    return tables.locale_names(_rows(spark, d, "part", "p_partkey").select(*_file(F.format_string("locale/l%d/%012d.sui", k % 7, k), content)))


@_query(
    "q57_textures",
    """WITH t AS (SELECT p_partkey AS k, md5(p_partkey || '') AS h, CASE p_partkey % 3 WHEN 0 THEN md5(p_partkey || '') || md5(p_partkey || 'b') || md5(p_partkey || 'c') || md5(p_partkey || 'd') END AS raw FROM part),
            y AS (SELECT k, list_transform(range(0, 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS m FROM t WHERE raw IS NULL),
            e AS (SELECT k, m, m[9] + 256 * m[10] AS c0, m[11] + 256 * m[12] AS c1, m[13] + 256 * m[14] + 65536 * m[15] + 16777216 * m[16] AS picks, m[3] + 256 * m[4] + 65536 * m[5] + 16777216 * m[6] + 4294967296 * m[7] + 1099511627776 * m[8] AS levels FROM y),
            f AS (SELECT k, m, picks, levels, [(c0 & 31) * 255 // 31, (c0 >> 5 & 63) * 255 // 63, (c0 >> 11 & 31) * 255 // 31] AS a, [(c1 & 31) * 255 // 31, (c1 >> 5 & 63) * 255 // 63, (c1 >> 11 & 31) * 255 // 31] AS b FROM e),
            x AS (SELECT k, m, a, b, i, picks >> (2 * i)::INT & 3 AS pick, levels >> (3 * i)::INT & 7 AS level FROM f, range(0, 16) r(i)),
            z AS (SELECT k, i, list_transform([1, 2, 3], lambda j: CASE pick WHEN 0 THEN a[j] WHEN 1 THEN b[j] WHEN 2 THEN (2 * a[j] + b[j]) // 3 ELSE (a[j] + 2 * b[j]) // 3 END) AS bgr,
                         CASE WHEN k % 3 = 1 THEN (m[(i // 2 + 1)::INT] >> (i % 2 * 4)::INT & 15) * 17 WHEN level < 2 THEN m[(level + 1)::INT] WHEN m[1] > m[2] THEN (m[1] * (8 - level) + m[2] * (level - 1)) // 7 WHEN level < 6 THEN (m[1] * (6 - level) + m[2] * (level - 1)) // 5 WHEN level = 6 THEN 0 ELSE 255 END AS alpha FROM x)
       SELECT 'tex/' || k || '.dds' AS path, 4 AS width, 4 AS height, string_agg(printf('%02X%02X%02X%02X', bgr[1], bgr[2], bgr[3], alpha), '' ORDER BY i) AS pixels FROM z GROUP BY k
       UNION ALL SELECT 'tex/' || k || '.dds', 4, 4, upper(raw) FROM t WHERE raw IS NOT NULL""",
)
def q57(spark, d):
    k = F.col("p_partkey").cast("string")
    method = F.when(F.col("p_partkey") % 3 == 0, _zeros(4)).otherwise(F.concat(F.lit("445854"), F.when(F.col("p_partkey") % 3 == 1, "33").otherwise("35")))
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(*(F.md5(F.concat(k, F.lit(more))) for more in ("", "b", "c", "d")))).otherwise(F.md5(k))
    content = F.concat(F.lit("444453207C000000"), _zeros(4), _int(4, 4), _int(4, 4), _zeros(0x40), method, _zeros(0x28), body)
    return tables.textures(_rows(spark, d, "part", "p_partkey").select(*_file(F.concat(F.lit("tex/"), k, F.lit(".dds")), content))).select("path", "width", "height", F.hex("bgra").alias("pixels"))


@_query(
    "q58_map_sectors",
    "SELECT 'map/m' || s_suppkey % 9 || '/s' || s_suppkey || '.base' AS path, 'm' || s_suppkey % 9 AS map FROM supplier WHERE s_suppkey % 4 < 2 AND 'm' || s_suppkey % 9 IN (SELECT 'm' || n_nationkey // 5 FROM nation)",
)
def q58(spark, d):
    s, key = _table(spark, d, "supplier"), F.col("s_suppkey")
    folder = F.when(key % 4 < 2, F.concat(F.lit("map/m"), key % 9)).when(key % 4 == 2, F.concat(F.lit("map/m"), key % 9, F.lit("/deeper"))).otherwise(F.lit("elsewhere/m0"))
    sectors = s.select(*_file(F.concat(folder, F.lit("/s"), key, F.lit(".base")), F.lit("")))
    index = _table(spark, d, "nation").select(*_file(F.concat(F.lit("map/m"), F.floor(F.col("n_nationkey") / 5), F.lit(".mbd")), F.lit("")))
    return tables.map_sectors(sectors.unionByName(index)).select("path", "map")


def _zlib(text: Column) -> Column:
    """A zlib stream of one stored block, of ASCII text below 64 kB."""
    n = F.length(text)
    start = F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"))

    def step(sums: Column, i: Column) -> Column:
        a = (sums["a"] + F.ascii(F.substr(text, i, F.lit(1)))) % 65521
        return F.struct(a.alias("a"), ((sums["b"] + a) % 65521).alias("b"))

    sums = F.aggregate(F.sequence(F.lit(1), n), start, step)
    check = F.concat(F.lpad(F.hex(sums["b"]), 4, "0"), F.lpad(F.hex(sums["a"]), 4, "0"))
    return F.concat(F.lit("780101"), _int(n, 2), _int(65535 - n, 2), _text(text), check)


def _hashed_archive(files: dict[str, Column]) -> Column:
    """A hashed archive of texts by path, with listings of its folders; all but the listings are compressed."""
    listings = {"": "*def", "def": "*world\na.sii", "def/world": "b.sii"}
    blobs = {path: (_text(F.lit(t)), F.lit(len(t)), F.lit(len(t))) for path, t in listings.items()}
    blobs |= {path: (_zlib(t), F.length(t), F.length(t) + 11) for path, t in files.items()}
    at, rows = F.lit(20 + 32 * len(blobs)), []
    for path, (_, size, packed) in blobs.items():
        rows += [F.lit(formats.path_hash(path).to_bytes(8, "little").hex()), _int(at, 8), _int(int(path in listings), 4), _zeros(4), _int(size, 4), _int(packed, 4)]
        at = at + packed
    head = F.concat(F.hex(F.lit(formats.ARCHIVE_MAGIC)), _int(1, 2), _zeros(2), F.hex(F.lit(formats.ARCHIVE_METHOD)), _int(len(blobs), 4), _int(20, 4))
    return F.concat(head, *rows, *(data for data, _, _ in blobs.values()))


def zip_archive(path: Column, text: Column) -> Column:
    """A ZIP archive of one stored file."""
    name, data = F.encode(path, "UTF-8"), F.encode(text, "UTF-8")
    about = F.concat(_zeros(8), _int(F.crc32(data), 4), _int(F.length(data), 4), _int(F.length(data), 4), _int(F.length(name), 2), _zeros(2))
    local = F.concat(F.lit("504B03041400"), about, F.hex(name), F.hex(data))
    entry = F.concat(F.lit("504B010214001400"), about, _zeros(14), F.hex(name))
    end = F.concat(F.lit("504B0506"), _zeros(4), _int(1, 2), _int(1, 2), _int(F.length(entry) / 2, 4), _int(F.length(local) / 2, 4), _zeros(2))
    return F.concat(local, entry, end)


@_query(
    "q59_layered_archives",
    """SELECT 'def/a.sii' AS path, 2 AS archive_seq, 'mod of ' || n_name AS text FROM nation WHERE n_nationkey = 24
       UNION ALL SELECT 'def/world/b.sii', 1, 'world' UNION ALL SELECT 'only/' || n_nationkey || '.sii', 2, 'mod of ' || n_name FROM nation WHERE n_nationkey < 24""",
)
def q59(spark, d):
    """A base of a hashed archive, and a ZIP for each nation in the layer above; one of these replaces a base file."""
    n, key = _table(spark, d, "nation"), F.col("n_nationkey")
    base = spark.range(1).select(*_file(F.lit("base.scs"), _hashed_archive({"def/a.sii": F.lit("base"), "def/world/b.sii": F.lit("world")})))
    mods = n.select(*_file(F.lit("mods/mod.scs"), zip_archive(F.when(key == 24, "def/a.sii").otherwise(F.concat(F.lit("only/"), key, F.lit(".sii"))), F.concat(F.lit("mod of "), "n_name"))))
    files = tables.layered(tables.unpacked(base.unionByName(mods), {"base.scs": 1, "mod.scs": 2}))
    return files.select("path", F.col("archive_seq").cast("long").alias("archive_seq"), F.decode("content", "UTF-8").alias("text"))


@_query("q60_hashed_archives", "SELECT 'def/a.sii' AS path, p_name AS text FROM part UNION ALL SELECT 'def/world/b.sii', p_type || ' ' || p_partkey FROM part")
def q60(spark, d):
    """A hashed archive for each part; every file of each, in no layer."""
    content = _hashed_archive({"def/a.sii": F.col("p_name"), "def/world/b.sii": F.concat("p_type", F.lit(" "), "p_partkey")})
    archives = _rows(spark, d, "part", "p_partkey").select(*_file(F.lit("part.scs"), content))
    return tables.unpacked(archives, {}).select("path", F.decode("content", "UTF-8").alias("text"))
