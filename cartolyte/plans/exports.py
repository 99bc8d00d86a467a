"""Exports: cities, countries, overlays, bus stops and road points as JSON arrays, overlay images, and the tile map's description.

Outputs go through sinks with commit; only the one-row tile description is written by the driver.
"""

from __future__ import annotations

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.functions import geometry, strings
from cartolyte.functions.tokens import name_of, token, token_of
from cartolyte.operators import lookup, polygons, precedence, runs
from cartolyte.operators.spatial import bounds, grid_join
from cartolyte.sources import sinks

#: Spawn point types that are exported: (icon, label) by code (fixed values).
SPAWNS = {
    3: ("gas_ico", "Fuel"),
    4: ("service_ico", "Service"),
    6: ("weigh_station_ico", "WeightStation"),
    7: ("dealer_ico", "TruckDealer"),
    8: ("hotel_ico", "Hotel"),
    15: ("garage_large_ico", "Garage"),
    16: ("recruitment_ico", "Recruitment"),
}


#: Spawn point at which a company's sign stands, and the action that makes a trigger a car park (fixed values).
COMPANY_SPAWN, PARKING_ACTION = 13, "hud_parking"
#: Bits of what to export (fixed values).
FLAGS = {"tile_map_info": 1, "cities": 2, "city_dimensions": 4, "city_names": 8, "countries": 16, "country_names": 32, "overlays": 64, "overlay_pngs": 128}
ROAD, PREFAB, COMPANY, CITY, OVERLAY, FERRY, TRIGGER, BUS_STOP = 3, 4, 6, 12, 18, 19, 34, 37


def wants(flags: int, *names: str) -> bool:
    """All the bits of these names are set."""
    mask = sum(FLAGS[n] for n in names)
    return flags & mask == mask


def spawn_label(code: Column) -> Column:
    """(icon, label, token) of a spawn point type as a struct; null for types that are not exported."""
    chosen = F
    for k, (icon, label) in SPAWNS.items():
        chosen = chosen.when(code == k, F.struct(F.lit(icon).alias("icon"), F.lit(label).alias("label"), F.lit(token_of(icon)).alias("token")))
    return chosen.otherwise(None)


def cities(items: DataFrame, definitions: DataFrame, countries: DataFrame) -> DataFrame:
    """Name, LocalizationToken, Country, X, Y, CountryId, LocalizedNames of the cities that are not hidden."""
    held = items.where("NOT hidden").select("look_token", "x", "z").join(definitions.withColumnRenamed("token", "look_token"), "look_token")
    ids = countries.select(F.col("token").alias("_country"), F.col("country_id").alias("CountryId"))
    out = held.withColumn("_country", token(F.col("country"))).join(ids, "_country", "left")
    return out.select(F.col("name").alias("Name"), F.col("loc_token").alias("LocalizationToken"), F.col("country").alias("Country"), F.col("x").alias("X"), F.col("z").alias("Y"), "CountryId", F.col("localized_names").alias("LocalizedNames"))


def countries(definitions: DataFrame, with_names: bool = True) -> DataFrame:
    names = F.col("localized_names") if with_names else F.lit(None).cast("map<string,string>")
    return definitions.select(F.col("country_id").alias("CountryId"), F.col("name").alias("Name"), F.col("country_code").alias("CountryCode"), F.col("x").alias("X"), F.col("y").alias("Y"), names.alias("LocalizedNames"))


def with_city(points: DataFrame, city_areas: DataFrame, point_id: str, cell: float = 600.0) -> DataFrame:
    """Points with the struct ``City`` of the first city area that holds them; hidden areas count too."""
    found = grid_join(points, city_areas, point_id, "city_id", "seq", cell)
    named = city_areas.select("city_id", F.struct(strings.localised(F.col("localized_names"), "en_us", F.col("name")).alias("Name"), F.col("in_game_id").alias("InGameID"), F.col("country").alias("Country")).alias("City"))
    return points.join(found.join(named, "city_id", "left").drop("city_id"), point_id, "left")


def city_areas(items: DataFrame, definitions: DataFrame) -> DataFrame:
    """The areas of city items, hidden ones too, for :func:`with_city`."""
    held = items.where(F.col("type") == CITY).join(definitions.select(F.col("token").alias("look_token"), "name", "localized_names", "country"), "look_token")
    return held.select(F.col("load_seq").alias("city_id"), F.col("load_seq").alias("seq"), F.col("x").alias("rx"), F.col("z").alias("rz"), F.col("width").alias("w"), F.col("height").alias("h"), "name", "localized_names", name_of(F.col("look_token")).alias("in_game_id"), "country")


def bus_stops(items: DataFrame, areas: DataFrame) -> DataFrame:
    """X, Y, Type, City of all bus stops; none is hidden."""
    held = with_city(items.where(F.col("type") == BUS_STOP).select("load_seq", "x", "z"), areas, "load_seq")
    return held.select(F.col("x").alias("X"), F.col("z").alias("Y"), F.lit("BusStop").alias("Type"), "City")


def prefab_frames(items: DataFrame, definitions: DataFrame, prefabs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Prefab items whose definition and first node exist, with the definition's points and the frame that places them."""
    known = definitions.select(F.col("token").alias("look_token"), "path")
    held = items.where(F.col("type") == PREFAB).join(known, "look_token").withColumn("node_uid", F.get("nodes", F.lit(0)))
    points = prefabs.select("path", "nodes", "spawn_points", "trigger_points")
    return polygons.framed(held.select("uid", "load_seq", "hidden", "x", "z", "path", "origin", "node_uid"), points, nodes)


def spawn_overlays(frames: DataFrame) -> DataFrame:
    """A row for each exported spawn point of the frames."""
    spawns = frames.select("load_seq", "frame", F.posexplode("spawn_points").alias("part", "p")).withColumn("sign", spawn_label(F.col("p.type"))).where("sign IS NOT NULL")
    return _typed(spawns.withColumn("at", polygons.turned(F.col("frame"), F.col("p"))), F.col("sign.token"), F.col("sign.icon"), F.col("sign.label"), F.col("at.x"), F.col("at.z"), F.col("part"))


def trigger_overlays(frames: DataFrame) -> DataFrame:
    """A row for each run of trigger points with one id, if the run's first is a car park."""
    points = frames.select("load_seq", "frame", F.posexplode("trigger_points").alias("part", "p")).withColumn("trigger_id", F.col("p.trigger_id"))
    first = runs.run_starts(points, ["load_seq"], ["part"], "trigger_id").where(F.col("p.action") == token_of(PARKING_ACTION))
    return _typed(first.withColumn("at", polygons.turned(F.col("frame"), F.col("p"))), F.lit(token_of("parking_ico")), F.lit("parking_ico"), F.lit("Parking"), F.col("at.x"), F.col("at.z"), F.col("part"))


def company_overlays(items: DataFrame, frames: DataFrame) -> DataFrame:
    """A row for each company: at its prefab's company spawn point, else at its own place."""
    sign = lookup.first_item(F.col("spawn_points"), lambda p: p["type"] == COMPANY_SPAWN)
    known = frames.select(F.col("uid").alias("prefab_uid"), F.col("load_seq").alias("prefab_seq"), F.when(sign.isNotNull(), polygons.turned(F.col("frame"), sign)).alias("at"))
    held = items.where(F.col("type") == COMPANY).select("load_seq", "look_token", "x", "z", "prefab_uid")
    held = lookup.first_match(held, known, "prefab_uid", "prefab_seq")
    return _typed(held, F.col("look_token"), name_of(F.col("look_token")), F.lit("Company"), F.coalesce("at.x", "x"), F.coalesce("at.z", "z"))


def _typed(rows: DataFrame, token_, name, kind, x, z, part=None, visibility=None) -> DataFrame:
    zoom = F.lit(None) if visibility is None else visibility
    return rows.select("load_seq", F.coalesce(part, F.lit(0)).alias("part") if part is not None else F.lit(0).alias("part"), token_.alias("token"), name.alias("Name"), kind.alias("Type"), x.cast("double").alias("X"), z.cast("double").alias("Y"), zoom.cast("int").alias("ZoomLevelVisibility"))


def is_parking(actions: Column) -> Column:
    return F.array_contains(actions, F.lit(token_of(PARKING_ACTION)))


def icon_rows(items: DataFrame) -> DataFrame:
    """The icons that stand at an item's own place: overlay items, parking triggers and ferries, by one look at each item."""
    own, kind, train = F.col("look_token"), F.col("type"), F.coalesce("is_train", F.lit(False))
    sign = lambda token_, name, label, visibility=None: F.struct(token_.alias("token"), name.alias("name"), label.alias("label"), (F.lit(None) if visibility is None else visibility).cast("int").alias("visibility"))
    fixed = lambda icon, label: sign(F.lit(token_of(icon)), F.lit(icon), F.lit(label))
    chosen = (
        F.when(kind == OVERLAY, sign(own, name_of(own), F.lit("Overlay"), F.col("zoom_visibility")))
        .when((kind == TRIGGER) & is_parking(F.col("actions")), fixed("parking_ico", "Parking"))
        .when((kind == FERRY) & train, fixed("train_ico", "Train"))
        .when(kind == FERRY, fixed("port_overlay", "Ferry"))
    )
    rows = items.withColumn("sign", chosen).where("sign IS NOT NULL")
    return _typed(rows, F.col("sign.token"), F.col("sign.name"), F.col("sign.label"), F.col("x"), F.col("z"), visibility=F.col("sign.visibility"))


def overlay_rows(items: DataFrame, prefab_definitions: DataFrame, prefabs: DataFrame, nodes: DataFrame, areas: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """X, Y, ZoomLevelVisibility, Name, Type, Width, Height, City of the overlays of six sources.

    The sources are overlay items, companies, parking triggers, ferries, and the spawn and trigger points of prefabs.
    Hidden items have none. Rows whose overlay (by token) has no bitmap go; the city is that of the item's own place.

    The items of these kinds, the placed prefabs and the city areas have several readers each; they are persisted, so
    that each is made once, and stay so until the caller clears Spark's cache.
    """
    kinds = (OVERLAY, COMPANY, TRIGGER, FERRY, PREFAB)
    columns = ("load_seq", "type", "uid", "x", "z", "hidden", "look_token", "origin", "nodes", "prefab_uid", "is_train", "zoom_visibility", "actions")
    held = items.where(F.col("type").isin(*kinds)).select(*columns).persist()
    frames = prefab_frames(held, prefab_definitions, prefabs, nodes).persist()
    shown, seen = held.where("NOT hidden"), frames.where("NOT hidden")
    rows = icon_rows(shown)
    for part in (company_overlays(shown, frames), spawn_overlays(seen), trigger_overlays(seen)):
        rows = rows.unionByName(part)
    rows = rows.join(precedence.first_wins(bitmaps.select("token", "name", "width", "height"), ["token"], "name").drop("name"), "token")
    cities_ = with_city(shown.select("load_seq", "x", "z"), areas.persist(), "load_seq").select("load_seq", "City")
    return rows.join(cities_, "load_seq").select("X", "Y", "ZoomLevelVisibility", "Name", "Type", F.col("width").alias("Width"), F.col("height").alias("Height"), "City")


def road_points(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """(load_seq, pos, x, y) of all roads whose end nodes exist, and whose look does if ``items`` are only those."""
    held = lookup.with_ends(items.where(F.col("type") == ROAD).select("load_seq", "start_uid", "end_uid"), nodes.select("uid", "x", "z", "rotation"), "start_uid", "end_uid")
    points = held.select("load_seq", F.posexplode(geometry.road_points(F.col("start"), F.col("end"))).alias("pos", "p"))
    return points.select("load_seq", "pos", F.col("p.x").alias("x"), F.col("p.z").alias("y"))


def png(width: int, height: int, bgra: bytes) -> bytes:
    """A PNG file of the pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = np.frombuffer(bgra, np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]].reshape(height, 4 * width)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def overlay_pngs(bitmaps: DataFrame) -> DataFrame:
    """(name, png): an image for each overlay name."""
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"name": frame["name"], "png": [png(w, h, b) for w, h, b in zip(frame["width"], frame["height"], frame["bgra"])]})

    return precedence.first_wins(bitmaps.select("name", "token", "width", "height", "bgra"), ["name"], "token").select("name", "width", "height", "bgra").mapInPandas(run, "name string, png binary")


def write_pngs(images: DataFrame, folder: str) -> None:
    """Each image as a file of a folder that all tasks can write to, all of them or none."""
    sinks.write_files(images.select(F.concat("name", F.lit(".png")).alias("name"), F.col("png").alias("content")), folder)


def write_rows(rows: DataFrame, path: str) -> None:
    """The rows as one JSON array, by place and, where they have one, name."""
    sinks.write_json_array(rows, path, [c for c in ("X", "Y", "Name", "Type") if c in rows.columns])


def tile_map_rows(points: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """One row: x1, x2, y1, y2 of the square that holds all points, and the zoom range."""
    b = bounds(points)
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"))
    b = b.select(side.alias("side"), ((F.col("min_x") + F.col("max_x") - side) / 2).alias("x1"), ((F.col("min_z") + F.col("max_z") - side) / 2).alias("y1"))
    return b.select("x1", (F.col("x1") + F.col("side")).alias("x2"), "y1", (F.col("y1") + F.col("side")).alias("y2"), F.lit(min_zoom).alias("minZoom"), F.lit(max_zoom).alias("maxZoom"))


def tile_map_info(points: DataFrame, min_zoom: int, max_zoom: int, path: str | None = None) -> dict:
    """The same as a dict, and as a JSON file if there is a path."""
    info = tile_map_rows(points, min_zoom, max_zoom).first().asDict()
    if path:
        with open(path, "w") as f:
            json.dump(info, f, indent=2)
    return info


def write_exports(flags: int, folder: str, tables: dict[str, DataFrame]) -> None:
    """What the flags ask for, under a folder: Cities, Countries, Overlays, BusStop as JSON arrays, and Overlays as images.

    ``tables`` has items, nodes, cities, countries (both with localized_names), prefab_definitions, prefabs and bitmaps.
    """
    Path(folder).mkdir(parents=True, exist_ok=True)
    t, areas = tables, city_areas(tables["items"], tables["cities"])
    named = wants(flags, "city_names")
    if wants(flags, "cities"):
        out = cities(t["items"].where(F.col("type") == CITY), t["cities"], t["countries"])
        write_rows(out if named else out.drop("LocalizedNames"), f"{folder}/Cities.json")
        write_rows(bus_stops(t["items"], areas), f"{folder}/BusStop.json")
    if wants(flags, "countries"):
        write_rows(countries(t["countries"], named), f"{folder}/Countries.json")
    if wants(flags, "overlays"):
        write_rows(overlay_rows(t["items"], t["prefab_definitions"], t["prefabs"], t["nodes"], areas, t["bitmaps"]), f"{folder}/Overlays.json")
        if wants(flags, "overlay_pngs"):
            write_pngs(overlay_pngs(t["bitmaps"]), f"{folder}/Overlays")
