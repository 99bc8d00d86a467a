"""URL filters, WARC revisits, page text and nearest neighbours on small cases."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolyte.llm import ann, html_extract, url_filter, warc


def test_url_filter_follows_the_list_history(spark):
    changes = spark.createDataFrame(
        [
            ("a", "block", "Bad.example", "2024-01-10", "added"), ("a", "block", "bad.example", "2024-02-01", "removed"), ("a", "block", "bad.example", "2024-03-01", "added"),
            ("b", "allow", "ok.bad.example", "2024-01-01", "added"), ("c", "block", "ok.bad.example", "2024-04-01", "added"),
            ("a", "block", None, "2024-01-01", "added"), ("a", "block", "same.example", "2024-01-01", "added"), ("a", "block", "same.example", "2024-01-01", "removed"),
        ],
        "list string, action string, pattern string, day string, state string",
    ).withColumn("day", F.col("day").cast("date"))
    cases = [
        ("http://bad.example/x", "2024-01-09", False), ("http://bad.example/x", "2024-01-10", True), ("https://WWW.bad.example:80/", "2024-01-31", True), ("http://bad.example", "2024-02-01", False),
        ("http://bad.example", "2024-03-05", True), ("http://notbad.example", "2024-03-05", False), ("http://ok.bad.example", "2024-03-05", False), ("http://ok.bad.example", "2024-04-02", True),
        (None, "2024-03-05", False), ("no url", "2024-03-05", False), ("http://bad.example", None, False), ("http://same.example", "2024-05-01", False), ("http://bad.example./", "2024-03-05", True),
    ]
    captures = spark.createDataFrame([(i, u, d, "kept") for i, (u, d, _) in enumerate(cases)], "id int, url string, fetch_day string, pattern string").withColumn("fetch_day", F.col("fetch_day").cast("date"))
    got = {r["id"]: r for r in url_filter.filter_captures(captures, changes).collect()}
    assert [got[i]["_blocked"] for i in range(len(cases))] == [b for _, _, b in cases]
    assert got[7]["_lists"] == "b,c" and got[1]["pattern"] == "kept"
    assert url_filter.filter_captures(captures.limit(0), changes).count() == 0
    assert url_filter.filter_captures(captures, changes.limit(0)).where("_blocked").count() == 0


def test_url_filter_keeps_columns_repeats_and_long_urls(spark):
    changes = spark.createDataFrame([("a", "block", "bad.example", "2024-01-10", "added")], "list string, action string, pattern string, day string, state string").withColumn("day", F.col("day").cast("date"))
    long = "http://bad.example/" + "x" * 200_000
    rows = [(1, long, "2024-02-01", "h1", "d1", "mine"), (1, long, "2024-02-01", "h1", "d1", "mine"), (2, "http://a.bad.example", "2024-02-01", None, "d2", "mine")]
    captures = spark.createDataFrame(rows, "id int, url string, fetch_day string, h string, d string, _h string").withColumn("fetch_day", F.col("fetch_day").cast("date"))
    got = url_filter.filter_captures(captures, changes)
    assert got.columns == ["id", "url", "fetch_day", "h", "d", "_h", "_host", "_blocked", "_pattern", "_lists"]
    assert sorted((r["id"], r["h"], r["d"], r["_h"], r["_blocked"], len(r["url"])) for r in got.collect()) == [(1, "h1", "d1", "mine", True, len(long))] * 2 + [(2, None, "d2", "mine", True, 20)]


def test_undated_responses_and_clashing_columns(spark):
    tag = {"etag": '"1"'}
    rows = [(1, "http://a.example/", None, False, tag, "b1"), (2, "http://a.example/", "2024-01-05 00:00:00", True, tag, None), (3, "http://a.example/", None, True, tag, None), (4, "http://b.example/", "2024-01-01 00:00:00", False, tag, "b4"),
            (5, "http://b.example/", "2024-01-01 00:30:00", True, {"etag": '"1"', "x": "y" * 100_000}, None), (5, "http://b.example/", "2024-01-01 00:30:00", True, {"etag": '"1"', "x": "y" * 100_000}, None), (6, None, None, False, None, "b6")]
    df = spark.createDataFrame(rows, "record_id int, url string, t string, is_revisit boolean, headers map<string,string>, payload string").withColumn("warc_date", F.col("t").cast("timestamp"))
    df = df.withColumn("canonical", F.lit("old")).withColumn("resolution", F.lit("old")).withColumn("_block", F.lit("mine")).withColumn("_found", F.lit("mine"))
    got = warc.resolve_revisits(df).collect()
    assert sorted((r["record_id"], r["resolution"], r["target_id"], r["_block"], r["_found"]) for r in got if r["record_id"] != 5) == [(1, "response", None, "mine", "mine"), (2, "missing", None, "mine", "mine"), (3, "missing", None, "mine", "mine"), (4, "response", None, "mine", "mine"), (6, "response", None, "mine", "mine")]
    assert [(r["resolution"], r["target_id"], len(r["merged_headers"]["x"])) for r in got if r["record_id"] == 5] == [("resolved", 4, 100_000)] * 2


def test_revisits(spark):
    h = lambda etag=None, **more: {k.replace("_", "-"): v for k, v in more.items()} | ({"etag": etag} if etag else {})
    rows = [
        (1, "http://www.a.example/x/", "2024-01-01 00:00:00", False, h('"1"', content_type="text/html", content_length="9", age="1"), "body1"),
        (2, "https://A.example/x#f", "2024-01-01 00:00:00", True, h('W/"1"', content_length="0", age="2"), None),
        (3, "http://a.example/x", "2024-01-05 00:00:00", True, h('"1"'), None),
        (4, "http://a.example/x", "2024-01-06 00:00:00", False, h('"2"', last_modified="m"), "body2"),
        (5, "http://a.example/x", "2024-02-06 00:00:00", True, h('"1"'), None),
        (6, "http://a.example/x", "2024-02-07 00:00:00", True, h(last_modified="m"), None),
        (7, "http://a.example/x", "2023-01-01 00:00:00", True, h('"1"'), None),
        (8, "http://a.example/x", "2024-02-08 00:00:00", True, None, None),
        (9, None, "2024-02-08 00:00:00", True, h('"1"'), None),
    ]
    df = spark.createDataFrame(rows, "record_id int, url string, t string, is_revisit boolean, headers map<string,string>, payload string").withColumn("warc_date", F.col("t").cast("timestamp"))
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r["resolution"], r["target_id"]) for k, r in got.items()} == {
        1: ("response", None), 2: ("resolved", 1), 3: ("resolved", 1), 4: ("response", None), 5: ("mismatch", None), 6: ("resolved", 4), 7: ("missing", None), 8: ("mismatch", None), 9: ("missing", None),
    }
    assert got[2]["payload"] == "body1" and got[2]["merged_headers"] == {"etag": 'W/"1"', "content-type": "text/html", "content-length": "9", "age": "2"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    def record(kind, http):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    parts = [record("warcinfo", b"x"), record("response", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\n<p>hi"), record("revisit", b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = {r["warc_type"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert set(got) == {"response", "revisit"} and bytes(got["response"]["body"]) == b"<p>hi" and got["revisit"]["status"] == 304 and got["response"]["headers"] == {"etag": '"1"'}


def test_damaged_warc_files():
    def record(n, date="2024-01-01T00:00:00Z", size=None):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{n}>\r\nWARC-Date: {date}\r\nContent-Length: {4 if size is None else size}\r\n\r\nHTTP\r\n\r\n".encode()

    ids = lambda data: [r[0] for r in warc.parse_warc(data)]
    packed = [gzip.compress(record(n)) for n in range(3)]
    assert ids(b"".join(packed)) == ["<0>", "<1>", "<2>"]
    assert ids(b"".join(packed)[:-12]) in (["<0>", "<1>"], ["<0>", "<1>", "<2>"]) and ids(packed[0] + b"\x1f\x8bno gzip") == ["<0>"]
    assert ids(record(0) + record(1, size=900)) == ["<0>"] and ids(record(0, size="x")) == ["<0>"] and ids(b"") == [] and ids(b"\x00" * 100) == []
    assert [r[2] for r in warc.parse_warc(record(0, date="some day"))] == [None]


def test_page_text(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li><li><a href='/y'>More</a></li></ul></nav>"
        "<div class=ad>Buy now.</div><article><h1>Big&amp;Small</h1><p>One  two,\n three.<br>Four <b>five</b>.<p>Six&nbsp;seven, eight and nine more words here.</p><!-- no --></article><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "long words here, and more. " * 3000 + "</p>"), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_pages(df).collect()
    texts = [r["text"] for r in got if r["page_id"] == 1]
    assert texts == ["Big&Small\nOne two, three. Four five.\nSix seven, eight and nine more words here."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[2] == "" and len({r["page_id"]: r["text"] for r in got}[4]) > 80_000
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_messages_equal_brute_force():
    rng = np.random.default_rng(4)
    parents, kinds = [-1, 0, 0, 1, 1, 2], [0, 1, 2, 1, 0, 2]
    unary, edges = rng.normal(size=6).tolist(), rng.normal(size=(3, 2, 2)).tolist()
    weights = {}
    for code in range(64):
        y = [code >> i & 1 for i in range(6)]
        weights[tuple(y)] = np.exp(sum(u for u, l in zip(unary, y) if l) + sum(edges[kinds[i]][y[parents[i]]][y[i]] for i in range(1, 6)))
    total = sum(weights.values())
    marginal, pairs = html_extract.messages(parents, kinds, unary, edges)
    for i in range(6):
        assert marginal[i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        if i:
            assert pairs[i][1][0] == pytest.approx(sum(w for y, w in weights.items() if y[parents[i]] and not y[i]) / total)


def test_held_out_pages():
    model = html_extract.train(html_extract.labelled_pages(80), epochs=25)
    right = total = 0
    for html, labels in html_extract.labelled_pages(40, seed=1234):
        page = html_extract.parse(html)
        kinds = [html_extract._KINDS.get(t, 0) for t in page.tags]
        marginal, _ = html_extract.messages(page.parents, kinds, html_extract._unary(html_extract.features(page), model.weights), model.edges)
        own = {e for e, _, t in page.texts if t.strip()}
        right += sum((marginal[e] >= 0.5) == labels[e] for e in own)
        total += len(own)
    assert right / total > 0.95


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype("float32")
    x[7] = x[5]
    rows = [(i, [float(v) for v in row], "extra") for i, row in enumerate(x)]
    rows += [(1000, None, "e"), (1001, [0.0] * 16, "e"), (1002, [float("nan")] * 16, "e"), (1003, [1.0, None] + [0.0] * 14, "e"), (1004, [1.0], "e"), (1005, [float("inf")] * 16, "e"), (1006, [], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, d string")
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    assert {r["query_id"] for r in got} == set(range(0, 600, 50))
    hit = 0
    wide = x.astype(float)
    for q in range(0, 600, 50):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-12) for r in own)
        hit += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(600), d))[:10].tolist()))
    assert hit / 120 >= 0.9
    few = ann.nearest(df.where("vec_id < 3"), F.col("id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0
    assert struct.calcsize("f") == 4


def test_nearest_with_repeated_ids_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "a", 1.0, 7, 8) for r in rows], "vec_id int, embedding array<float>, id string, v double, node int, query int")
    got = ann.nearest(df, F.col("id") == 0)
    assert got.dtypes == [("query_id", "int"), ("rank", "int"), ("vec_id", "int"), ("score", "double")]
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 3, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 2.0)]
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ann.nearest(two, F.col("id") == 0).collect()) == [(0, 1, 1, 1.0), (0, 1, 1, 2.0)]
    assert [tuple(r) for r in ann.nearest(two.limit(1), F.col("id") == 0).collect()] == []


def test_nearest_beside_a_group_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32)).astype("float32")
    x[200:1000] = x[200]
    x[1000:1200] = x[1000] + rng.normal(size=(200, 32)).astype("float32") * 1e-3
    x[0] = x[200] + 0.05
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got, hit = ann.nearest(df, F.col("id") % 50 == 0).collect(), 0
    wide = x.astype(float)
    for q in range(0, 1500, 50):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        best = np.lexsort((np.arange(1500), d))[:10].tolist()
        hit += len(set(own) & set(best))
        assert q or own == best
    assert hit / 300 >= 0.97


def test_nearest_of_many_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)).astype("float32")
    x[rng.permutation(3000)[:2000]] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("id") % 300 == 0).collect()
    copies = np.flatnonzero((x == x[0]).all(axis=1)).tolist()
    asked = [q for q in range(0, 3000, 300) if q in set(copies)]
    assert len(asked) > 1
    for q in asked:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert own == [(n + 1, i, 0.0) for n, i in enumerate([c for c in copies if c != q][:10])]
