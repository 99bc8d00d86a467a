"""Recall of the nearest neighbours on vectors of very different scales, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolyte.llm import ann


def vectors(name: str) -> np.ndarray:
    rng = np.random.default_rng(3)
    normal = rng.standard_normal((3000, 24))
    if name == "one far vector":
        normal[7] = 1e9
    elif name == "two spreads":
        normal = np.concatenate([normal[:1500] * 100, normal[1500:] * 0.01])
    elif name == "a narrow cluster far from the middle":
        normal = np.concatenate([normal[:1500] * 100, normal[1500:] * 1e-3 + 5])
    elif name == "all scales":
        normal = normal * 10.0 ** rng.uniform(-6, 6, (3000, 1))
    elif name == "large numbers":
        normal = normal * 1e37
    elif name == "small numbers":
        normal = normal * 1e-35
    return normal


NAMES = ["one far vector", "two spreads", "a narrow cluster far from the middle", "all scales", "large numbers", "small numbers"]


@pytest.mark.parametrize(("name", "kind"), [*((n, "float") for n in NAMES), ("one far vector", "double"), ("small numbers", "double")])
def test_recall(spark, name, kind):
    v = vectors(name)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], f"vec_id long, embedding array<{kind}>").repartition(4)
    stored = v if kind == "double" else v.astype(np.float32).astype(float)
    found: dict = {}
    for r in ann.nearest(df, F.col("id") % 100 == 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for i in range(7, len(v), 100):
        d = np.sqrt(((stored - stored[i]) ** 2).sum(axis=1))
        others = np.delete(np.arange(len(v)), i)
        best = others[np.lexsort((others, d[others]))[:10]]
        got = sorted(found[i])
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(s == pytest.approx(d[j], rel=1e-12) for _, j, s in got)
        hit += len(set(best.tolist()) & {j for _, j, _ in got})
    assert hit >= 0.97 * 10 * 30


def test_rounds_follow_until_the_graph_has_settled(spark, monkeypatch):
    """From three orders' cells of eight vectors the graph comes by NN-descent, round after round."""
    v = np.random.default_rng(5).standard_normal((2500, 6))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<float>").repartition(4)
    rounds, descend = [], ann.descend

    def counted(*args):
        rounds.append(1)
        return descend(*args)

    monkeypatch.setattr(ann, "descend", counted)
    index = ann.written(ann.distinct_vectors(ann.usable(df), 11), "index")
    graph = ann.build_graph(index, degree=20, trees=3, cell=8, settled=0.01)
    lists = {r["node"]: r["others"] for r in graph.collect()}
    rows = index.select("node", "v").collect()
    x = {r["node"]: np.asarray(r["v"], float) for r in rows}
    nodes = sorted(x)
    m = np.stack([x[n] for n in nodes])
    hit = 0
    for i in range(0, len(nodes), 25):
        d = ((m - m[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        hit += len({nodes[j] for j in np.argsort(d)[:20]} & set(lists[nodes[i]]))
    assert len(rounds) >= 3 and hit >= 0.9 * 20 * 100, (len(rounds), hit)
