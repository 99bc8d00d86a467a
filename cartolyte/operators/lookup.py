"""Joins of items with definitions, nodes, prefabs, countries and ports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolyte.operators.precedence import first_wins, last_wins


def with_definition(items: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """Items whose definition exists. Spark broadcasts the definitions if their size allows."""
    return items.join(definitions, key)


def with_ends(roads: DataFrame, nodes: DataFrame, start: str, end: str) -> DataFrame:
    """Roads with both end nodes as structs ``start`` and ``end``; roads without one are left out."""
    side = lambda name, key: nodes.select(F.col("uid").alias(key), F.struct("*").alias(name))
    return roads.join(side("start", start), start).join(side("end", end), end)


def with_node(items: DataFrame, nodes: DataFrame, key: str, name: str = "node") -> DataFrame:
    """Items with their node as a struct, null where it is missing."""
    return items.join(nodes.select(F.col("uid").alias(key), F.struct("*").alias(name)), key, "left")


def connections_from(ports: DataFrame, connections: DataFrame) -> DataFrame:
    """Each port (port_token) with the connections that start there."""
    return ports.join(connections.withColumnRenamed("start_token", "port_token"), "port_token")


def ordered_points(items: DataFrame, nodes: DataFrame, key: str, uids: str) -> DataFrame:
    """(key, points): each item's nodes in the order of its list; missing ones are skipped."""
    rows = items.select(key, F.posexplode(uids).alias("pos", "uid")).join(nodes, "uid")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "z"))).alias("l"))
    return lists.select(key, F.transform("l", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"))).alias("points"))


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """A left join with the first right row of each key."""
    return left.join(first_wins(right, [key], order), key, "left")


def first_item(array, condition):
    """The first element of an array that meets a condition, or null."""
    return F.try_element_at(F.filter(array, condition), F.lit(1))


def port_ends(connections: DataFrame, ports: DataFrame) -> DataFrame:
    """Connections (start_token, end_token) with the location of both ports; of several items of a port the last counts.

    A connection from a port to itself has its start located only.
    """
    last = last_wins(ports, ["port_token"], "load_seq")
    start = last.select(F.col("port_token").alias("start_token"), F.col("x").alias("start_x"), F.col("z").alias("start_z"))
    end = last.select(F.col("port_token").alias("end_token"), F.col("x").alias("_x"), F.col("z").alias("_z"))
    apart = F.col("start_token") != F.col("end_token")
    out = connections.join(start, "start_token", "left").join(end, "end_token", "left")
    return out.withColumn("end_x", F.when(apart, F.col("_x"))).withColumn("end_z", F.when(apart, F.col("_z"))).drop("_x", "_z")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")
