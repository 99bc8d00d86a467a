"""Line dedup, source divergence and collocations against brute force, with nulls, empty, long and repeated texts, ties and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolyte.llm import collocations, divergence, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, h string, n long, pos int, term string, phrase string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA).repartition(parts)


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Line dedup


def dropped_lines(rows, least_chars, least_docs):
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    rank = lambda i: -1 if i is None else i
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(rank(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [len(held[key(x)]) >= least_docs and rank(i) != max(held[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g), gone))
    return out


def line_rows():
    rng = random.Random(3)
    common = ["This line is in nearly all of them", "Ümlaut LINE with É kept as it is", "short", "exactly twenty chars", "nineteen characters", "\x0bpadded line of some length\t "]
    rows = [(None, common[0], "", ""), (None, common[0].upper() + "\n\n" + common[1], "", ""), (7, None, "", ""), (8, "", "", ""), (9, "\n", "", ""), (10, "\n".join([common[0]] * 40), "", "")]
    for i in range(20, 60):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own line {rng.randrange(10**9)} of document {i}" for _ in range(rng.randint(1, 30))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else f" {x}" if rng.random() < 0.3 else x for x in lines), "", ""))
    rows += [rows[-1], (59, "another text of the same id\n" + common[0], "", ""), (3, "é" * 20 + "\n" + "É" * 20, "", ""), (4, "é" * 20, "", ""), (5, "é" * 20 + " ", "", "")]
    rows.append((100, "\n".join(f"line number {k % 5000} of a very long text" for k in range(60_000)), "", ""))
    rows += [(k, f"line number {k} of a very long text\nline number 7 of a very long text", "", "") for k in range(101, 104)]
    return rows


@pytest.mark.parametrize("least_chars, least_docs", [(20, 3), (1, 2)])
def test_line_dedup(spark, least_chars, least_docs):
    rows = line_rows()
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.line_dedup(docs(spark, rows), least_chars, least_docs).collect()]
    want = [r[:4] for r in dropped_lines(rows, least_chars, least_docs)]
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert sorted(got, key=order) == sorted(want, key=order) and any(r[2] for r in got)


def test_keep_bitmaps_are_the_lines_that_stay(spark):
    rows = [r for r in line_rows() if r[0] is not None and r[0] != 59]
    want = {r[0]: r[4] for r in dropped_lines(rows, 20, 3)}
    for r in line_dedup.line_dedup(docs(spark, rows)).select("doc_id", "keep_runs").collect():
        bits = [bool(i % 2) for i, n in enumerate(r["keep_runs"]) for _ in range(n)]
        assert bits == want[r["doc_id"]] and len(r["keep_runs"]) % 2 == 1 and all(r["keep_runs"][1:-1])


def test_line_dedup_streams_ranges(spark):
    found = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("h"), "id", (F.col("id") % 7).alias("doc_id"), F.lit(1).alias("version"), F.lit(2).alias("pos"))
    plan = line_dedup.frequent_keys(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "rangepartitioning(h" in plan and "Python" not in plan


def test_line_dedup_of_nothing(spark):
    assert line_dedup.digests(docs(spark, []).where("false")).collect() == []
    one = line_dedup.digests(docs(spark, [(1, None, None, None)])).first()
    assert (one["n_lines"], one["n_dropped"], one["kept_sha256"]) == (1, 0, hashlib.sha256(b"").hexdigest())


# Source divergence


def brute_divergence(rows, least, ranks):
    n, total, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add((lang, source))
        n[lang, source].update(terms)
        total[lang].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, d in held[lang].items() if d >= least]
        sizes = {s: sum(n[lang, s][t] for t in kept) + 5 * len(kept) for l, s in groups if l == lang}
        p = lambda s, t: 1 + 10**9 * (n[lang, s][t] + 5) // sizes[s]  # noqa: B023, E731
        everything = sum(total[lang][t] for t in kept) + 5 * len(kept)
        pairs = [(-sum(abs(p(source, t) - p(s, t)) for t in kept), s.encode(), s) for s in sizes if s != source]
        terms = [(-(p(source, t) - (1 + 10**9 * (total[lang][t] + 5) // everything)), t.encode(), t) for t in kept if n[lang, source][t]]
        out += [(lang, source, "pair", s, -v, k) for k, (v, _, s) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(x for x in terms if x[0] < 0), 1) if k <= ranks]
    return out


def source_rows():
    rng = random.Random(11)
    vocabulary = [*"abcdefgh", "ab", "abc", "abcd", "été", "ét", "Éa", "中文", "中", "x", "ÿ", "\U00010400b"]
    rows = [(None, None, None, None), (1, "", "en", None), (2, "a b C", None, "s"), (2, "a b C", None, "s"), (3, "1 2 3 [\\]^_`{|}~@", "xx", "s1"), (4, None, "xx", "s2"), (5, "rare", "xx", "s3")]
    for i in range(6, 160):
        lang, k = rng.choice(["en", "fr", ""]), rng.randrange(5)
        words = rng.choices(vocabulary, weights=[1 + (j + k) % 6 for j in range(len(vocabulary))], k=rng.randrange(40))
        rows.append((i, rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words), lang, f"s{k}"))
    return rows


@pytest.mark.parametrize("least, ranks", [(30, 50), (1, 3)])
def test_divergence(spark, least, ranks):
    rows = source_rows()
    got = [tuple(r) for r in divergence.divergence(docs(spark, rows), least, ranks).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(brute_divergence(rows, least, ranks)) and len(got) > 50


def test_divergence_of_nothing(spark):
    assert divergence.divergence(docs(spark, []).where("false")).collect() == []


def test_tries_hold_all_terms_in_order():
    rng, trie, want = random.Random(2), divergence.Trie(), {}
    for _ in range(30):
        terms = {bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(1, 8))) for _ in range(100)} - set(want)
        new = {t: len(want) + i for i, t in enumerate(terms)}
        trie.insert(sorted(new.items()))
        want |= new
        assert list(trie.walk()) == sorted(want.items()) and trie.leaves == len(want)


@pytest.mark.parametrize("leaves, held", [(3, 10), (50, 1), (10**6, 10**6)])
def test_tries_of_any_size_merge_to_the_same(monkeypatch, leaves, held):
    """Small tries, summed often, and batches that end inside a leaf's rows."""
    monkeypatch.setattr(divergence, "LEAVES", leaves)
    monkeypatch.setattr(divergence, "HELD", held)
    rows = [(lang or "", source or "", (text or "").encode()) for _, text, lang, source in source_rows()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20]), (pa.string(), pa.string(), pa.binary()))], names=["lang", "source", "text"]) for i in range(0, len(rows), 20)]
    found = pa.Table.from_batches(list(divergence._leaf_rows(iter(batches)))).sort_by([("lang", "ascending"), ("term", "ascending")])
    found = found.filter(pa.compute.not_equal(found["term"], ""))
    merged = [r for b in divergence._merging(2)(iter(found.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    n, docs = defaultdict(Counter), Counter()
    for lang, source, text in rows:
        terms = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        for t in terms:
            n[lang, t.decode()][source] += 1
        docs.update((lang, t.decode()) for t in set(terms))
    assert [(r["lang"], r["term"], r["docs"], {c["source"]: c["n"] for c in r["counts"]}) for r in merged] == [(*k, docs[k], dict(n[k])) for k in sorted(n, key=lambda k: (k[0], k[1].encode())) if docs[k] >= 2]


def test_shares_pass_64_bits():
    counts, sizes = np.array([[10**14, 3], [10**15 + 7, 0]]), np.array([9 * 10**15, 7])
    exact = [[1 + 10**9 * (c + 5) // d for c, d in zip(row, sizes.tolist())] for row in counts.tolist()]
    assert divergence._shares(counts, sizes).tolist() == exact
    assert divergence._shares(counts, sizes * 1000).tolist() == [[1 + 10**9 * (c + 5) // d for c, d in zip(row, (sizes * 1000).tolist())] for row in counts.tolist()]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    for text in (b"Abc def-ghi jkl mno pqr stu", b"a" * 50, b"", b"1" * 50 + b"\xc3\xa9t" * 9 + b" x"):
        assert [t for part in divergence.terms_of(text) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.lower())


# Collocations


def phrase_counts(rows, longest=5):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for m in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return f, n


def brute_collocations(rows, longest, least, ranks, share=100):
    out = []
    counts, sizes = phrase_counts(rows, longest)
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in candidates.items():
            inside = (q for q, b in candidates.items() if len(q) > len(p) and share * a <= 100 * b and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if next(inside, None) is None:
                score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, right, sizes[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(best)[:ranks], 1)]
    return out


def phrase_rows():
    rng = random.Random(4)
    words = ["a", "b", "B", "cc", "é", "É", "new", "york", "x\x00y", "d-e", "中文"]
    rows = [(None, None, None, None), (1, "", "en", None), (2, " \t ", "en", None), (3, "a b. c", None, None), (4, "...!?", "zz", None)]
    for i in range(5, 300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " New  York\tCity "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), None))
    return rows + [rows[-1]] * 3


@pytest.mark.parametrize("longest, least, ranks, share", [(5, 100, 2000, 100), (5, 5, 40, 100), (3, 2, 2000, 60)])
def test_collocations(spark, longest, least, ranks, share):
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.collocations(docs(spark, rows), longest, least, share, ranks).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, longest, least, ranks, share)) and len(got) > 5


def test_collocations_of_nothing_and_wrong_bounds(spark):
    assert collocations.collocations(docs(spark, []).where("false")).collect() == []
    for bad in ({"longest": 6}, {"least": 256}, {"least": 1}):
        with pytest.raises(ValueError):
            collocations.frequent_phrases(docs(spark, []), **bad)


def test_phrases_of_a_very_long_text(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(1_100_000))
    rows = [(1, text, "en", None), (2, "one two.three", "en", None)]
    f, n = phrase_counts(rows, 3)
    got = {(r["phrase"]): r["f"] for r in collocations.frequent_phrases(docs(spark, rows), 3, 100).collect()}
    assert got == {"": n["en"]} | {" ".join(p): c for p, c in f["en"].items() if c >= 100}


@pytest.mark.parametrize("block", [16, 40, 1000])
def test_blocks_lose_and_repeat_nothing(monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = phrase_rows()
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "text": pa.array([(r[1] or "").encode() for r in rows], pa.binary())})
    got = Counter()
    for b in collocations.blocks_of(batch, {}):
        data = b.data.tobytes()
        for n in range(1, 6):
            got.update(tuple(data[b.begins[i + j] : b.ends[i + j]].decode() for j in range(n)) for i in np.flatnonzero(b.runs(n)))
    assert got == phrase_counts([(r[0], r[1], "en") for r in rows])[0]["en"]


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With cells that all n-grams share, nearly all occurrences come through, and the counts are the same."""
    monkeypatch.setattr(collocations, "WIDTHS", (1 << 4, 1 << 4))
    rows = phrase_rows()
    f, n = phrase_counts(rows)
    got = {(r["lang"], r["phrase"]): r["f"] for r in collocations.frequent_phrases(docs(spark, rows), 5, 20).collect()}
    assert got == {(lang, " ".join(p)): c for lang, own in f.items() for p, c in own.items() if c >= 20} | {(lang, ""): c for lang, c in n.items()}
