"""Schemas of decoded tables. Unsigned 64-bit keys are stored as signed BIGINT; ``load_seq`` is the order of loading."""

from __future__ import annotations

ITEMS = (
    "load_seq long, type int, uid long, x float, z float, hidden boolean, look_token long, origin int, nodes array<long>, start_uid long, end_uid long, node_uid long, "
    "width float, height float, zoom_visibility int, is_train boolean, prefab_uid long, actions array<long>, color_index long, draw_over boolean"
)
NODES = "load_seq long, uid long, x float, z float, rotation float"
PREFABS = (
    "path string, valid_road boolean, nodes array<struct<x:float,z:float,rot_x:float,rot_z:float,lane_count:int>>, spawn_points array<struct<x:float,z:float,type:long>>, "
    "map_points array<struct<x:float,z:float,lane_count:int,lane_offset:int,hidden:boolean,color_flags:int,control_node:int,neighbours:array<int>>>, "
    "trigger_points array<struct<trigger_id:long,action:long,x:float,z:float>>"
)
FILES = "archive_seq int, archive string, entry int, path string, content binary"
TEXTURES = "path string, width int, height int, bgra binary"
