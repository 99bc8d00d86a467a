"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it.

Copies. The index holds each distinct vector once, as a node, with the k + 1 smallest ids that have it. What the search
finds is expanded from these, so of equal vectors the smallest ids are always the ones that count.

Index. Nodes carry their vector as it is; the graph and the search measure by Euclidean distances in double precision on
it, whatever the scales of the vectors. Every node starts with neighbours from ``TREES`` orders of the nodes by codes, the
sides of ``PLANES`` planes halfway between two random vectors, so that regions are cut where the vectors are, however wide
or narrow they spread. The orders are dealt out by range and cut into cells of ``CELL`` nodes. A round of
NN-descent then joins each node's list with those of its neighbours: the members of a neighbourhood, the node's
``DEGREE`` neighbours and ``REVERSE`` of the nodes that have it as one, are compared with each other, and a member takes
what is nearer than the last of its list. Pairs that have met before, both old in the list, aren't compared again. Rounds
follow until one changes no more than ``SETTLED`` of all lists' entries. The
bound on reverse members leaves out proposals of an approximate method, not rows: they are members elsewhere. Many
distances of a cell or neighbourhood are got at once from products of vectors around its middle; what these let through is measured again.

Search. Each distinct query vector starts at its own node and holds a beam of its ``BEAM`` nearest so far. A step measures
all neighbours of the nodes that have just entered the beam; it ends when no beam changes. The query travels to the
nodes, and only what enters the beam travels back, with its links. Links are whole neighbour lists, without a cap.

All steps are Spark joins on node numbers; what is held for a node or a query is bounded by the parameters. A node that
is in very many lists has its rows combined in the task that finds them, and its joins have plain exchanges, which Spark
splits. Distances are Euclidean in double precision on the original vectors.

Defined cases: rows without an id and vectors that are null or zero, of another length than most, or hold null or non-finite
components take no part, neither as candidates nor as queries; of equal distances the smaller id comes first; rows that
repeat id and vector count once, an id with several vectors is as many rows, each searched for with ranks of its own, and
a query's own id is never among its neighbours; fewer candidates than asked for give all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolyte.llm.common import bounded_batches, drop_written, written

DEGREE, REVERSE, PROPOSE, TREES, CELL = 40, 16, 8, 4, 256
#: Share of new entries at which the graph has settled.
SETTLED = 0.1
BEAM = 144
#: Hyperplanes of a code; cells are cut from the order of the codes, so more of them than needed do no harm.
PLANES = 30
#: Vectors, at most, from which the planes are made.
SAMPLE = 4000
#: Neighbourhoods compared at once.
AT_ONCE = 256


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part."""
    good = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    width = good.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).first()
    return good.where(F.size("v") == (width["width"] if width else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, v, ids): each distinct vector with its k smallest ids in order. To be written before use, as nodes are numbered by task."""
    # A limit on row numbers is kept in each task before the shuffle, so a common vector moves k rows a task.
    least = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(f"r <= {k}")
    groups = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.select(F.monotonically_increasing_id().alias("node"), "v", "ids")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lengths of the lists, and their values one after the other."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A matrix in double precision from packed vectors."""
    if not len(column):
        return np.zeros((0, 1))
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1).astype(float)


def _as_lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """Values of ascending owners 0..n-1 as a list for each."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows: the same for a pair wherever and in whichever order it is measured."""
    gap = x - y
    return (gap * gap).sum(axis=1)


def _firsts(owner: np.ndarray, other: np.ndarray, d: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's k nearest others, by owner and distance; of repeated pairs the old one."""
    order = np.lexsort((new, other, d, owner))
    a, b, c = owner[order], other[order], d[order]
    again = np.zeros(len(order), bool)
    again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
    order = order[~again]
    a = owner[order]
    return order[np.arange(len(a)) - np.searchsorted(a, a) < k]


def _found(owner: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> pa.RecordBatch:
    """A row for each node that something was found for."""
    at = _firsts(owner, other, d, np.zeros(len(owner), bool), k)
    nodes, rank = np.unique(owner[at], return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(nodes), _as_lists(rank, len(nodes), other[at]), _as_lists(rank, len(nodes), d[at])], ["node", "others", "ds"])


FOUND = "node long, others array<long>, ds array<double>"


def planes(sample: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """([tree, plane, dimension], [tree, plane]): unit normals and offsets of planes halfway between two vectors of the sample."""
    rng = np.random.default_rng(seed)
    first = rng.integers(0, len(sample), (trees, PLANES))
    second = (first + rng.integers(1, max(len(sample), 2), first.shape)) % len(sample)
    p, q = sample[first], sample[second]
    gap = p - q
    length = np.sqrt((gap * gap).sum(axis=2, keepdims=True))
    normals = gap / np.where(length > 0, length, 1)
    return normals, (normals * (p / 2 + q / 2)).sum(axis=2)


def coded(points: DataFrame, normals: np.ndarray, offsets: np.ndarray, kind: str) -> DataFrame:
    """(tree, code, node, x): on which sides of each tree's planes the points lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), kind)
            for tree in range(len(normals)) if len(x) else ():
                code = ((x @ normals[tree].T > offsets[tree]) << np.arange(normals.shape[1])[::-1]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int64)), batch.column("node"), batch.column("x")], ["tree", "code", "node", "x"])

    return points.select("node", "x").mapInArrow(run, "tree int, code long, node long, x binary")


def in_cells(ordered: DataFrame, cell: int, degree: int, kind: str) -> DataFrame:
    """(node, others, ds) from all distances within cells of consecutive rows."""
    def run(batches):
        for batch in batches:
            nodes, x = _longs(batch.column("node")), _matrix(batch.column("x"), kind)
            for part in np.array_split(np.arange(len(nodes)), max(1, -(-len(nodes) // cell))):
                n = min(degree, len(part) - 1)
                if n < 1:
                    continue
                own = x[part] - np.median(x[part], axis=0)
                norm = (own * own).sum(axis=1)
                d = norm[:, None] + norm - 2 * (own @ own.T)
                np.fill_diagonal(d, np.inf)
                i, j = np.repeat(part, n), part[np.argpartition(d, n - 1, axis=1)[:, :n].ravel()]
                # Trees follow each other in the order, so a cell may hold a node twice.
                i, j = i[nodes[i] != nodes[j]], j[nodes[i] != nodes[j]]
                yield _found(nodes[i], nodes[j], _gaps(x[i], x[j]), degree)

    return ordered.mapInArrow(run, FOUND)


def merged(graph: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """The graph with what was found: (node, x, others, ds, new), the lists by distance; ``new`` marks others that weren't there before."""
    rows = graph.select("node", "x", "others", "ds", F.lit(False).alias("new")).unionByName(found.withColumn("x", F.lit(None).cast("binary")).withColumn("new", F.lit(True)))
    held = rows.groupBy("node").agg(F.first("x", ignorenulls=True).alias("x"), F.collect_list(F.struct("others", "ds", "new")).alias("parts"))

    def run(batches):
        for batch in batches:
            parts, each = _lists(batch.column("parts"))
            others, ds, new = each.flatten()
            sizes, other = _lists(others)
            owner = np.repeat(np.repeat(np.arange(len(batch)), parts), sizes)
            other, d, new = _longs(other), ds.flatten().to_numpy(zero_copy_only=False), np.repeat(new.to_numpy(zero_copy_only=False), sizes)
            at = _firsts(owner, other, d, new, degree)
            columns = [_as_lists(owner[at], len(batch), c[at]) for c in (other, d, new)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("x"), *columns], ["node", "x", "others", "ds", "new"])

    return held.mapInArrow(run, "node long, x binary, others array<long>, ds array<double>, new array<boolean>")


def descend(graph: DataFrame, kind: str, degree: int = DEGREE, reverse: int = REVERSE, propose: int = PROPOSE) -> DataFrame:
    """One round of NN-descent: neighbours of neighbours are compared."""
    forward = graph.select(F.col("node").alias("at"), F.explode(F.arrays_zip("others", "new")).alias("e")).select("at", F.col("e.others").alias("member"), F.col("e.new").alias("new"))
    some = Window.partitionBy("at").orderBy(F.desc("new"), F.xxhash64("member", "at"))
    back = forward.select(F.col("member").alias("at"), F.col("at").alias("member"), "new").withColumn("r", F.row_number().over(some)).where(f"r <= {reverse}").drop("r")
    own = graph.select(F.col("node").alias("at"), F.col("node").alias("member"), F.lit(False).alias("new"))
    last = F.when(F.size("others") < degree, F.lit(float("inf"))).otherwise(F.element_at("ds", -1))
    points = graph.select(F.col("node").alias("member"), "x", last.alias("last"))
    around = forward.unionByName(back).unionByName(own).join(points.hint("shuffle_merge"), "member")
    lists = around.groupBy("at").agg(F.collect_list(F.struct("member", "x", "last", "new")).alias("members"))

    def run(batches):
        for batch in batches:
            sizes, members = _lists(batch.column("members"))
            node, x, last, new = members.flatten()
            node, x, last, new = _longs(node), _matrix(x, kind), last.to_numpy(zero_copy_only=False), new.to_numpy(zero_copy_only=False)
            first, found, middle = np.cumsum(sizes) - sizes, [], _longs(batch.column("at"))
            for a in range(0, len(sizes), AT_ONCE):
                n = sizes[a : a + AT_ONCE, None]
                width = int(n.max())
                if width < 2:
                    continue
                inside = np.arange(width) < n
                at = np.where(inside, first[a : a + AT_ONCE, None] + np.arange(width), 0)
                fresh, who = new[at] & inside, node[at]
                # Around the node whose neighbourhood it is, which is a member too.
                own = x[at]
                own -= own[np.arange(len(n)), (who == middle[a : a + AT_ONCE, None]).argmax(axis=1)][:, None, :]
                norm = np.where(inside, (own * own).sum(axis=2), np.inf)
                d = norm[:, :, None] + norm[:, None, :] - 2 * (own @ own.transpose(0, 2, 1))
                d[(who[:, :, None] == who[:, None, :]) | ~(fresh[:, :, None] | fresh[:, None, :])] = np.inf
                near = np.argpartition(d, min(propose, width - 1) - 1, axis=2)[:, :, :propose]
                # Norms round: measure again what may be nearer than the last.
                maybe = np.take_along_axis(d, near, 2) <= (last[at] * 1.001 + 1e-9 * np.where(inside, norm, 0))[:, :, None]
                maybe &= np.isfinite(np.take_along_axis(d, near, 2))
                row, i, j = np.nonzero(maybe)
                p, q = at[row, i], at[row, near[row, i, j]]
                exact = _gaps(x[p], x[q])
                better = exact < last[p]
                found.append((node[p[better]], node[q[better]], exact[better]))
            if found:
                yield _found(*(np.concatenate(c) for c in zip(*found)), degree)

    return merged(graph, lists.mapInArrow(run, FOUND), degree)


def _kind(index: DataFrame) -> str:
    """How a vector's numbers are packed: as they are, if they are of single precision."""
    return "<f4" if index.schema["v"].dataType.elementType.typeName() == "float" else "<f8"


def _packed(index: DataFrame, kind: str) -> DataFrame:
    """(node, x): the vectors as bytes."""
    def run(batches):
        for batch in batches:
            x = np.ascontiguousarray(_longs(batch.column("v").flatten()).astype(kind)).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "x"])

    return index.select("node", "v").mapInArrow(run, "node long, x binary")


def build_graph(index: DataFrame, degree: int = DEGREE, trees: int = TREES, cell: int = CELL, settled: float = SETTLED, seed: int = 11) -> DataFrame:
    """(node, x, others, ds, new): the neighbour graph of all nodes; ds are squared distances. None without nodes."""
    bounded_batches(index)
    sample = [np.asarray(r["v"], float) for r in index.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()]
    if not sample:
        return None
    kind = _kind(index)
    points = written(_packed(index, kind), "points")
    normals, offsets = planes(np.stack(sample), trees, seed)
    order = ["tree", "code", F.xxhash64("node", "tree")]
    dealt = coded(points, normals, offsets, kind).repartitionByRange(*order).sortWithinPartitions(*order)
    none = points.select("node", "x", F.array().cast("array<long>").alias("others"), F.array().cast("array<double>").alias("ds"))
    graph = written(merged(none, in_cells(dealt, cell, degree, kind), degree), "graph")
    changed, held = 1, 1
    while changed > settled * held:
        before, graph = graph, written(descend(graph, kind, degree), "graph")
        drop_written(before)
        changed, held = graph.agg(F.sum(F.size(F.filter("new", lambda x: x))), F.sum(F.size("others"))).first()
    drop_written(points)
    return graph


STATE = "query long, q binary, ids array<long>, ds array<double>, fresh array<long>"


def _advanced(beams: DataFrame, met: DataFrame, beam: int) -> DataFrame:
    """The beams with the nodes met: fresh is what those that entered lead to and the beam doesn't hold."""
    empty = F.lit(None)
    rows = beams.select("query", "q", "ids", "ds", empty.cast("struct<node:bigint,d:double,others:array<bigint>>").alias("m"))
    rows = rows.unionByName(met.select("query", empty.cast("binary").alias("q"), empty.cast("array<long>").alias("ids"), empty.cast("array<double>").alias("ds"), F.struct("node", "d", "others").alias("m")))
    held = rows.groupBy("query").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("q", "ids", "ds")), F.collect_list("m").alias("met"))

    def run(batches):
        for batch in batches:
            query, out = _longs(batch.column("query")), []
            had, ids = _lists(batch.column("ids"))
            ids, ds = _longs(ids), batch.column("ds").flatten().to_numpy(zero_copy_only=False)
            got, nodes = _lists(batch.column("met"))
            node, d, others = nodes.flatten()
            node, d = _longs(node), d.to_numpy(zero_copy_only=False)
            fan, link = _lists(others)
            link, to = _longs(link), np.concatenate([[0], np.cumsum(fan)])
            ids_to, met_to = np.concatenate([[0], np.cumsum(had)]), np.concatenate([[0], np.cumsum(got)])
            for i, q in enumerate(query.tolist()):
                a, b, m, n = ids_to[i], ids_to[i + 1], met_to[i], met_to[i + 1]
                all_ids, all_ds = np.concatenate([ids[a:b], node[m:n]]), np.concatenate([ds[a:b], d[m:n]])
                best = np.lexsort((all_ids, all_ds))[:beam]
                entered = best[best >= b - a] - (b - a) + m
                leads = np.unique(np.concatenate([link[to[e] : to[e + 1]] for e in entered])) if len(entered) else ids[:0]
                kept = all_ids[best]
                out.append((kept, all_ds[best], leads[~np.isin(leads, kept) & (leads != q)]))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(o[c]) for o in out])]).astype(np.int32)), pa.array(np.concatenate([o[c] for o in out]))) for c in range(3)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("q"), *lists], ["query", "q", "ids", "ds", "fresh"])

    return held.mapInArrow(run, STATE)


def search(asked: DataFrame, graph: DataFrame, kind: str, beam: int = BEAM) -> DataFrame:
    """(query, node): the beam of each query after a greedy search from its own node; ``asked`` has the nodes as ``query``."""
    def nearer(batches):
        for batch in batches:
            d = _gaps(_matrix(batch.column("q"), kind), _matrix(batch.column("x"), kind))
            near = pa.array(d < batch.column("last").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(d), batch.column("others")], ["query", "node", "d", "others"]).filter(near)

    start = asked.join(graph.hint("shuffle_merge"), F.col("query") == F.col("node"))
    held = written(start.select("query", F.col("x").alias("q"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("ds"), F.col("others").alias("fresh")), "beams")
    points = graph.select("node", "x", "others")
    # What a beam has dropped can't come back, as a beam's last only gets nearer; so this ends.
    while not held.where("size(fresh) > 0").isEmpty():
        last = F.when(F.size("ids") < beam, F.lit(float("inf"))).otherwise(F.element_at("ds", -1))
        pairs = held.select("query", "q", last.alias("last"), F.explode("fresh").alias("node"))
        met = pairs.join(points.hint("shuffle_merge"), "node").select("query", "q", "last", "node", "x", "others").mapInArrow(nearer, "query long, node long, d double, others array<long>")
        before, held = held, written(_advanced(held, met, beam), "beams")
        drop_written(before)
    return held.select("query", F.explode("ids").alias("node"))


def ranked(found: DataFrame, index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, measured on the original vectors.

    ``queries`` has (query_id, node). k + 1 ids of each vector suffice, as only the query's own is left out of them.
    """
    own = found.select("query").distinct().select("query", F.col("query").alias("node"))
    pairs = found.where("query <> node").unionByName(own).join(index.hint("shuffle_merge"), "node")
    pairs = pairs.join(index.select(F.col("node").alias("query"), F.col("v").alias("q")).hint("shuffle_merge"), "query")
    kind = index.schema["ids"].dataType.simpleString()

    def distances(frames):
        for frame in frames:
            if len(frame):
                q, v = (np.stack([np.asarray(x, float) for x in frame[c]]) for c in ("q", "v"))
                yield pd.DataFrame({"query": frame["query"], "ids": frame["ids"], "d": np.sqrt(_gaps(q, v))})

    rows = pairs.select("query", "ids", "q", "v").mapInPandas(distances, f"query long, ids {kind}, d double").select("query", "d", F.explode("ids").alias("vec_id"))
    near = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(near.hint("shuffle_merge"), queries["node"] == near["query"]).select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.d").alias("score"))


def nearest(rows: DataFrame, is_query, k: int = 10, beam: int = BEAM) -> DataFrame:
    """Index all rows, then search for those that ``is_query`` (a condition on the column id) selects."""
    every = written(usable(rows), "rows")
    index = written(distinct_vectors(every, k + 1), "index")
    graph = build_graph(index)
    queries = every.where(is_query).select(F.col("id").alias("query_id"), "v").distinct().join(index.select("node", "v").hint("shuffle_merge"), "v").select("query_id", "node")
    queries = written(queries, "queries")
    if graph is None:
        return ranked(queries.select(F.col("node").alias("query"), "node"), index, queries, k)
    return ranked(search(queries.select(F.col("node").alias("query")).distinct(), graph, _kind(index), beam), index, queries, k)
