"""Archives read by ranges, layers with ties, and sinks with commit."""

import json
import os
import zipfile

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cartolyte.sources import archives, formats, shared, sinks, tables
from tests.test_formats import archive


def entries_of(path):
    with open(path, "rb") as f:
        return {e.path: e for e in archives.index_of(f)}


def test_an_archive_is_many_tasks_and_only_chosen_bytes_are_read(spark, tmp_path):
    files = {f"def/f{i:03}.sii": bytes([i]) * 3000 + str(i).encode() * 500 for i in range(60)}
    path = tmp_path / "big.scs"
    path.write_bytes(archive(files))
    rows = archives.archives(spark, str(tmp_path), {"big.scs": 3}, splitbytes=100)
    assert {r["path"]: bytes(r["content"]) for r in rows.collect()} == files and rows.rdd.getNumPartitions() > 10
    assert {(r["archive_seq"], r["size"] > 3000) for r in rows.select("archive_seq", "size").collect()} == {(3, True)}
    # Whatever else the archive holds is spoiled: nothing of it may be read.
    chosen = {"def/f007.sii", "def/f033.sii"}
    data = bytearray(path.read_bytes())
    for name, e in entries_of(path).items():
        if name not in chosen:
            data[e.at : e.at + e.packed] = b"\xff" * e.packed
    path.write_bytes(data)
    picked = archives.archives(spark, str(tmp_path), splitbytes=100).where(F.col("path").isin(*chosen))
    assert {r["path"]: bytes(r["content"]) for r in picked.collect()} == {k: files[k] for k in chosen} and picked.rdd.getNumPartitions() <= 2
    one = archives.archives(spark, str(tmp_path)).where("path = 'def/f007.sii' AND size > 5")
    assert bytes(one.first()["content"]) == files["def/f007.sii"]
    begins = archives.archives(spark, str(tmp_path)).where(F.startswith("path", F.lit("def/f03")) & F.endswith("path", F.lit("3.sii")))
    with pytest.raises(PySparkException):  # spoiled neighbours have the prefix too
        begins.collect()
    listed = archives.archives(spark, str(tmp_path), content=False)
    assert listed.count() == 60 and listed.where("content IS NOT NULL").count() == 0
    laid = archives.layered_archives(spark, str(tmp_path), {}, lambda p: p.isin(*chosen))
    assert {r["path"]: bytes(r["content"]) for r in laid.collect()} == {k: files[k] for k in chosen}


def test_zip_members_and_roots(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.scs", "w") as z:
        z.writestr("def/x.sii", b"stored", zipfile.ZIP_STORED)
        z.writestr("def/y.sii", b"deflated " * 100, zipfile.ZIP_DEFLATED)
        z.mkdir("def/empty")
        z.writestr("def/nothing.sii", b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = {r["path"]: bytes(r["content"]) for r in archives.archives(spark, str(tmp_path)).collect()}
    assert got == {"def/x.sii": b"stored", "def/y.sii": b"deflated " * 100, "def/nothing.sii": b""}
    assert got == dict(formats.archive_entries((tmp_path / "a.scs").read_bytes()))
    (tmp_path / "none").mkdir()
    assert archives.archives(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(ValueError):
        archives.local_path("hdfs://host/x")


@pytest.mark.parametrize("order", [("a.scs", "b.scs"), ("b.scs", "a.scs")])
def test_ties_in_a_layer_go_to_the_last_name(spark, tmp_path, order):
    made = {name: archive({"def/x.sii": f"from {name}".encode(), f"def/{name}.sii": b"own"}) for name in ("a.scs", "b.scs", "low.scs")}
    rows = [("/mods/low.scs", bytearray(made["low.scs"])), *((f"/mods/{name}", bytearray(made[name])) for name in order)]
    files = tables.unpacked(spark.createDataFrame(rows, "path string, content binary").coalesce(1), {"a.scs": 1, "b.scs": 1})
    got = {r["path"]: (r["archive_seq"], bytes(r["content"])) for r in tables.layered(files).collect()}
    assert got == {"def/x.sii": (1, b"from b.scs"), "def/a.scs.sii": (1, b"own"), "def/b.scs.sii": (1, b"own"), "def/low.scs.sii": (0, b"own")}
    for name in order:
        (tmp_path / name).write_bytes(made[name])
    (tmp_path / "low.scs").write_bytes(made["low.scs"])
    by_ranges = archives.layered_archives(spark, str(tmp_path), {"a.scs": 1, "b.scs": 1})
    assert {r["path"]: (r["archive_seq"], bytes(r["content"])) for r in by_ranges.collect()} == got


def test_an_archive_is_unpacked_once(spark, tmp_path):
    (tmp_path / "a.scs").write_bytes(archive({f"def/{i}.sii": b"x" * i for i in range(50)}))
    seen = spark.sparkContext.accumulator(0)

    def counted(frames, n=seen):
        for frame in frames:
            n.add(len(frame))
            yield frame

    found = tables.archive_files(spark, str(tmp_path), {})
    assert tables.layered(found.mapInPandas(counted, found.schema)).count() == 50 and seen.value == 50


def failing(rows, at):
    """Rows of which one fails in its task, after others were written."""

    def run(frames):
        for frame in frames:
            if (frame["id"] == at).any():
                yield frame[frame["id"] < at]
                raise RuntimeError("a task fails")
            yield frame

    return rows.mapInPandas(run, rows.schema)


def test_json_array_in_order(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit('q"é'), "id").alias("Name"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("even")).repartition(7)
    path = tmp_path / "rows.json"
    sinks.write_json_array(rows, str(path), ["id"])
    want = [{"id": i, "Name": f'q"é{i}'} | ({"even": i} if i % 2 == 0 else {}) for i in range(1000)]
    assert json.loads(path.read_text(encoding="utf-8")) == want
    sinks.write_json_array(rows.where("id < 2"), str(path), ["id"])
    assert json.loads(path.read_text(encoding="utf-8")) == want[:2]
    sinks.write_json_array(rows.where("false"), str(path))
    assert json.loads(path.read_text()) == [] and [p.name for p in tmp_path.iterdir()] == ["rows.json"]


def test_a_failing_task_leaves_no_output(spark, tmp_path):
    rows = spark.range(100).repartition(4)
    with pytest.raises(PySparkException):
        sinks.write_json_array(failing(rows, 77), str(tmp_path / "rows.json"))
    files = rows.select("id", F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    with pytest.raises(PySparkException):
        sinks.write_files(failing(files, 77), str(tmp_path / "files"))
    assert list(tmp_path.iterdir()) == []
    (tmp_path / "rows.json").write_text("before")
    with pytest.raises(PySparkException):
        sinks.write_json_array(failing(rows, 77), str(tmp_path / "rows.json"))
    assert (tmp_path / "rows.json").read_text() == "before" and len(list(tmp_path.iterdir())) == 1


def test_files(spark, tmp_path):
    folder = tmp_path / "out"
    files = spark.range(50).repartition(5).select(F.concat(F.lit("d/"), "id", F.lit(".bin")).alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    sinks.write_files(files, str(folder))
    assert {p.name: p.read_bytes() for p in (folder / "d").iterdir()} == {f"{i}.bin": str(i).encode() for i in range(50)}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    for bad in (files.unionByName(files), files.withColumn("name", F.lit("../up"))):
        with pytest.raises(PySparkException):
            sinks.write_files(bad, str(tmp_path / "bad"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_written_tables_can_be_cleaned_up(spark):
    shared.clean_up(spark)
    rows = shared.written(spark.range(5), "some")
    again = shared.written(rows, "again")
    assert again.count() == 5 and shared.clean_up(spark) == 2 and shared.clean_up(spark) == 0
    assert not any(os.path.exists(archives.local_path(f)) for f in rows.inputFiles())


def test_small_archives_share_frames(monkeypatch):
    data = archive({"def/a.sii": b"a", "def/b.sii": b"b"})
    given = [pd.DataFrame({"path": [f"m/a{i}.scs" for i in range(k, k + 150)], "content": [data] * 150}) for k in (0, 150)]
    frames = list(tables.entry_frames(iter(given), {"a7.scs": 4}))
    assert len(frames) == 1 and len(frames[0]) == 600
    assert set(frames[0].loc[frames[0]["archive_seq"] == 4, "archive"]) == {"m/a7.scs"} and set(frames[0]["entry"]) == {0, 1}
    monkeypatch.setattr(tables, "FRAME_ROWS", 100)
    cut = list(tables.entry_frames(iter(given), {}))
    assert [len(f) for f in cut] == [100] * 6 and pd.concat(cut)["content"].tolist() == frames[0]["content"].tolist()
    assert list(tables.entry_frames(iter([]), {})) == []


def test_sector_rows_leave_in_bounded_frames(monkeypatch):
    files = pd.DataFrame({"content": [b"x"] * 6, "file_ord": range(6)})
    item = {"type": 3, "uid": -1 << 62, "x": 1.0, "z": 2.0, "hidden": False, "nodes": [], "actions": [], "flags": bytes(5)}
    read = ([("road", item | {"look": 9, "start": 1, "end": 2})] * 100, [{"uid": 7, "x": 0.5, "z": 1.5, "rotation": 0.0}] * 100)
    monkeypatch.setattr(formats, "read_sector", lambda *a, **k: read)
    monkeypatch.setattr(tables, "FRAME_ROWS", 250)
    for frames in (tables.item_frames(iter([files]), "ets2", formats.KEPT, True), tables.node_frames(iter([files]), True)):
        frames = list(frames)
        assert [len(f) for f in frames] == [250, 250, 100]
        assert pd.concat(frames)["load_seq"].tolist() == [o << 32 | i for o in range(6) for i in range(100)]


def test_small_archives_share_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"a{i:02}.scs").write_bytes(archive({"def/a.sii": str(i).encode()}))
    rows = archives.archives(spark, str(tmp_path), {"a07.scs": 5})
    assert rows.rdd.getNumPartitions() == 1
    assert sorted((r["archive"][-7:], r["archive_seq"], bytes(r["content"])) for r in rows.collect()) == [(f"a{i:02}.scs", 5 if i == 7 else 0, str(i).encode()) for i in range(40)]
    assert archives.archives(spark, str(tmp_path), splitbytes=4 * archives.OPEN_BYTES + 1000).rdd.getNumPartitions() == 10
