"""The pipeline, each stage held against brute force on what its predecessor kept."""

import re
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cartolyte.llm import near_dedup
from tests.llm.test_text_operators import JSON, ODD, WORD, brute_removal, prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    passage = prose(77, 60)
    texts = list(ODD) + [prose(500 + i, 90).capitalize() + "." for i in range(150)]
    texts += [t for t in texts[20:40]] + [t.replace(" ", "\t") for t in texts[20:30]] + [t.rsplit(" ", 2)[0] + " changed end." for t in texts[40:60]]
    texts += [prose(900 + i, 50) + " " + passage + " " + prose(950 + i, 50) for i in range(12)]
    junk = ["$$$ BUY!! 123456 ### %d " % (i % 7) * 12 for i in range(60)]
    n = len(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < n), 0) for i in range(13, len(rows), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), set(range(13, n))


def test_each_stage(spark, sf_dir, tmp_path):
    folder, clean = sf_dir
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert out.columns == columns
        docs, after = out, {r["doc_id"]: r["text"] for r in out.collect()}
        kept.append(len(after))
        if k == 0:
            assert len(clean - set(after)) <= 4 and len(set(after) - clean) <= len(ODD) + 2
        if k == 1:
            groups = defaultdict(list)
            for i, t in before.items():
                groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
            assert set(after) == {min(g) for g in groups.values()} and len(after) < len(before)
        if k == 2:
            ids = sorted(before)
            sets = dict(zip(ids, near_dedup.weighted_shingles([before[i] or "" for i in ids])))
            label = {i: i for i in ids}
            for i in ids:
                for j in ids:
                    (x, wx), (y, wy) = sets[i], sets[j]
                    if j < i and label[i] != label[j] and len(x) and len(y) and near_dedup.jaccard_p(x, near_dedup.weights_of(wx), y, near_dedup.weights_of(wy)) >= 0.8:
                        low, high = sorted((label[i], label[j]))
                        label = {d: low if c == high else c for d, c in label.items()}
            assert set(after) == set(label.values()) and len(after) < len(before)
        if k == 3:
            ids = sorted(before)
            want = dict(zip(ids, brute_removal([before[i] for i in ids], 20)))
            assert {i: WORD.findall(t or "") for i, t in after.items()} == want and any(len(want[i]) < len(WORD.findall(before[i] or "")) for i in ids)
    pieces, tok = defaultdict(int), Tokenizer.from_file(JSON)
    for r in out.collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after.items()}


def test_registered(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert corpus_pipeline.run(spark, sf_dir[0]).count() > 0


def _written(spark, folder, rows):
    """Documents whose extra columns have names that operators use inside, and ratings with nulls."""
    extra = ", rep string, key string, pos int, _key int, keep_id long, _gone int, class_id int"
    spark.createDataFrame([(*r, "r", "k", 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, int(i % 3 > 0), None) for i in range(0, len(rows), 2)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(marks if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _written(spark, tmp_path, [])).count() == 0


def test_null_ids_and_clashing_columns(spark, tmp_path):
    rows = [(i, prose(i, 60), None, None, None) for i in range(40)]
    rows += [(None, prose(3, 60), "en", "s", 1), (None, None, None, None, None), (None, prose(999, 60), "en", "s", 1), (5, prose(5, 60), "en", "s", 1), (41, None, "en", "s", 0)]
    folder = _written(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[1:4]:  # each on all rows, with null ids among them
        out = stage(spark, docs, folder)
        assert out.columns == columns
        got = [(r["doc_id"], r["text"], r["rep"], r["class_id"]) for r in out.collect()]
        assert {r[2:] for r in got} == {("r", 5)} and len(got) <= len(rows)
        assert {0, 1, 2, 3, 4} <= {r[0] for r in got}  # no id that is first of its kind goes
    assert corpus_pipeline.run(spark, folder).count() > 0
