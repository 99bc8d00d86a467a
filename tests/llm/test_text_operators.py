"""The operators on texts against brute force, with nulls, empty, long and repeated texts, and extra columns."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolyte.llm import bpe, components, exact_dedup, near_dedup, packing, quality, substring_dedup
from cartolyte.llm.words import split_words

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, keep_id string, h string"  # extra columns whose names clash with inner ones
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(parts, "doc_id")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("klmnop") for _ in range(n))


ODD = [None, "", " ", "\t\n", "a", "a b c", "a  b\tc", "it's  we'll \n\n x", "é中🙂 ͏", "x" * 5000, "<|endoftext|> b.", "1234 5,6!\r\n", prose(1, 3000)]


@pytest.fixture
def many():
    rng, texts = random.Random(5), list(ODD)
    base = [prose(100 + i, 120) for i in range(12)]
    passage = prose(999, 60)
    for b in base:
        texts += [b, b.replace(" ", "  ", 3)]
        for _ in range(4):
            words = b.split()
            for _ in range(rng.randint(1, 9)):
                words[rng.randrange(len(words))] = "zz%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
        texts.append(b[:300] + " " + passage + " " + prose(rng.randrange(10**6), 40))
    texts += [passage] * 5 + ["line again and again " * 30, "line again and again " * 41 + "end"]
    return texts


def test_bpe_equals_tiktoken_and_round_trips(spark, many):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark, many)
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(df, RANKS).collect()}
    assert ids == {i: want.encode_ordinary(t or "") for i, t in enumerate(many)}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(df, RANKS), RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(many)}
    row = bpe.digests(df, RANKS).where("doc_id = 7").first()
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[7])).encode()).hexdigest()
    assert row["n_tokens"] == len(ids[7]) and row["decoded_sha256"] == hashlib.sha256(many[7].encode()).hexdigest()


#: Letters and numbers above U+FFFF: CJK extensions, mathematical, Gothic, Adlam, Deseret, Osmanya; two signs; and two that only newer versions of Unicode assign.
HIGH = "\U00020000\U0002a6d6\U00030000\U0001d400\U0001d7ce\U0001d7ff\U00010330\U0001e900\U0001e950\U00010400\U000104a0\U0001f642\U0001d100\u0558\U0003fc3b"


def test_pretokens_above_the_bmp(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tik, tok = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(JSON)
    texts = [x for h in HIGH for b in "a7.-'é中 \n" for x in (h + b, b + h, b + h + b, h + b + h, " " + h + b + h)]
    rng = random.Random(9)
    texts += ["".join(rng.choice(HIGH + "a7.- '中s") for _ in range(40)) for _ in range(200)]
    df = docs(spark, texts)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(df, RANKS).collect()} == {i: tik.encode_ordinary(t) for i, t in enumerate(texts)}
    by_doc = defaultdict(list)
    for p in packing.pack(df, JSON, with_ids=True).collect():
        by_doc[p["doc_id"]].append((p["start"], p["ids"]))
    got = {i: [x for _, ids in sorted(own) for x in ids] for i, own in by_doc.items()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


def test_packing_covers_each_id_once(spark, many):
    tok = Tokenizer.from_file(JSON)
    pieces = packing.pack(docs(spark, many), JSON, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        raw = np.array(p["ids"], "<u4").tobytes()
        assert zlib.crc32(raw) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
    for i, t in enumerate(many):
        own = sorted(by_doc[i], key=lambda p: p["start"])
        ids = [x for p in own for x in p["ids"]]
        assert ids == tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert [p["start"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own[:-1]])) and own[0]["doc_tokens"] == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own[:-1]])) and sum(p["length"] for p in own) <= 1024


def test_packing_finds_the_cheapest_cuts():
    rng = np.random.default_rng(3)
    for _ in range(60):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 30, rng.integers(2, 50)))]))
        cost = rng.integers(0, 9, len(at))
        price = lambda d: packing.SEQUENCE_COST + (0 if d in packing.POWERS else 96 - d)
        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min((best[i] + cost[j] + price(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 96), default=10**9)
        cuts = packing.cheapest_cuts(at, cost, 96)
        assert sum(cost[np.searchsorted(at, b)] + price(b - a) for a, b in zip(cuts[:-1], cuts[1:])) == best[-1]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force(spark, many, weak):
    hash_of = (lambda c: F.length(c).cast("long")) if weak else exact_dedup.chunk_hash
    got = exact_dedup.exact_dedup(docs(spark, many + many[:4]), hash_of).collect()
    groups = defaultdict(list)
    for i, t in enumerate(many + many[:4]):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(many) + 4
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", (many + many[:4])[r["doc_id"]] or "")
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(groups[norm]), len(groups[norm]), r["doc_id"] == min(groups[norm]))
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    kept = exact_dedup.keep_first(docs(spark, many))
    assert kept.columns == ["doc_id", "text", "keep_id", "h"] and kept.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in many})


def brute_removal(texts, n):
    seen, gone = set(), defaultdict(set)
    for d, t in enumerate(texts):
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                gone[d].update(range(i, i + n))
            seen.add(key)
    return [[w for i, w in enumerate(WORD.findall(t or "")) if i not in gone[d]] for d, t in enumerate(texts)]


@pytest.mark.parametrize("window, k", [(20, 8), (4, 2), (3, 3)])
def test_substring_dedup_equals_brute_force(spark, many, window, k):
    want = brute_removal(many, window)
    for r in substring_dedup.substring_dedup(docs(spark, many), window, k).collect():
        kept = want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert r["n_removed"] == r["n_words"] - len(kept)
    cut = substring_dedup.cut_repeats(docs(spark, many), window, k)
    assert cut.columns == ["doc_id", "text", "keep_id", "h"]
    assert all(WORD.findall(r["text"] or "") == want[r["doc_id"]] for r in cut.collect())


def test_near_duplicates_equal_brute_force(spark, many):
    sets = near_dedup.weighted_shingles([t or "" for t in many])
    parent = list(range(len(many)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (x, wx) in enumerate(sets):
        for j in range(i):
            y, wy = sets[j]
            if len(x) and len(y) and near_dedup.jaccard_p(x, near_dedup.weights_of(wx), y, near_dedup.weights_of(wy)) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(spark, many)).collect()}
    assert got == {i: root(i) for i in range(len(many))}
    assert len(set(got.values())) < len(many)
    assert near_dedup.keep_one(docs(spark, many)).count() == len(set(got.values()))


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 10))
        x, y, e = rng.integers(0, 4, n).astype(float), rng.integers(0, 4, n).astype(float), np.arange(n).astype(np.uint64)
        if x.any() and y.any():
            want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(n)) for i in range(n) if x[i] and y[i])
            assert near_dedup.jaccard_p(e[x > 0], x[x > 0], e[y > 0], y[y > 0]) == pytest.approx(want)
    e = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    other = e.copy()
    other[:40] = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    w = rng.integers(1, 4, 400).astype(float)
    a, b = near_dedup.signature(e, w, 2048), near_dedup.signature(other, w, 2048)
    i, j = np.argsort(e), np.argsort(other)
    assert (a == b).mean() == pytest.approx(near_dedup.jaccard_p(e[i], w[i], other[j], w[j]), abs=0.04)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(3, 1), (1, 3), (2, 1), (7, 7), (50, 20)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {2: 1, 3: 1} | {i: 20 for i in [*range(21, 41), 50]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    good = lambda i: prose(10_000 + i, 60).capitalize() + "."
    junk = lambda i: " ".join(rng.choice(("$$$", "BUY!!", "123456", "###")) for _ in range(50))
    texts, marks = [], []
    for i in range(240):
        kind = i % 3
        texts.append(junk(i) if kind == 0 else good(i) + (" you vile rotten fool" if kind == 1 else ""))
        marks.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    labels = spark.createDataFrame(marks[:160] + [(5, None, None), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs(spark, texts + ODD), labels).collect()}
    assert len(got) == len(texts) + len(ODD)
    right = sum(got[i]["kept"] == (i % 3 == 2) for i in range(160, 240))
    assert right >= 76
    assert all(0 <= r["p_best"] <= r["p_good"] <= 1 and abs(r["expected_grade"] - r["p_good"] - r["p_best"]) < 1e-9 for r in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs(spark, texts[:9]), none).count() == 9


@pytest.mark.parametrize(
    "run",
    [
        lambda d, s: bpe.digests(d, RANKS),
        lambda d, s: packing.pack(d, JSON),
        lambda d, s: exact_dedup.exact_dedup(d),
        lambda d, s: near_dedup.near_duplicates(d),
        lambda d, s: substring_dedup.substring_dedup(d),
        lambda d, s: quality.score(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
    ],
)
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA), spark).count() == 0


def test_one_outsider_of_a_large_bucket_costs_its_size(spark):
    ids = spark.range(50_000)
    planes = [F.lit(0).cast("long").alias(f"{c}{i}") for c in "pq" for i in range(8)]
    rows = ids.select(F.lit(7).cast("long").alias("key"), F.col("id").alias("rep"), F.when(F.col("id") == 123, 123).otherwise(0).cast("long").alias("part"), F.lit(0).cast("long").alias("main"), F.lit(0.9).alias("s"), F.array(F.lit(7).cast("long")).alias("keys"), *planes)
    began = time.time()
    got = near_dedup.between(rows, 8, 0.8, 100)
    assert got.count() == 49_999 and got.where("a = 123 OR b = 123").count() == 49_999 and got.where("a <= b").isEmpty()
    assert time.time() - began < 30


def test_digests_are_of_the_words_alone():
    one, two = split_words(["a b\tc", "", "  x "]), split_words(["z a  b\n c"])
    at = lambda *x: np.array(x)
    assert (substring_dedup.digests(one, at(0), at(3)) == substring_dedup.digests(two, at(1), at(4))).all()
    assert (substring_dedup.digests(one, at(0), at(2)) != substring_dedup.digests(two, at(0), at(2))).any()
    assert substring_dedup.digests(split_words([""]), at()[:0].astype(int), at()[:0].astype(int)).shape == (0, 2)


def test_cuts_are_at_sentence_ends():
    rng = random.Random(8)
    sentence = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)) + "."
    texts = [" ".join(sentence(rng.randint(3, 60)) for _ in range(rng.randint(1, 200))) for _ in range(30)] + [sentence(5000)]
    ids, docs_, ends = packing.token_stream(texts, JSON)
    cuts = packing.cheapest_cuts(*packing.places(len(ids), docs_, ends))
    inside = [c for c in cuts[1:].tolist() if c not in set(docs_.tolist()) | set(ends.tolist())]
    assert inside and min(inside) > docs_[-2]  # only the last text's sentence, which is longer than a sequence
    assert (np.diff(cuts) <= 1024).all() and np.diff(cuts)[:-1].mean() > 960


def test_slopes_of_the_likelihood_equal_differences():
    rng = np.random.default_rng(6)
    for levels in (3, 4):
        score, grades, gaps, case = rng.normal(size=9), rng.integers(0, levels, 9), rng.normal(size=levels - 2), rng.random(9)
        start = 0.3
        sigmoid = lambda x: 1 / (1 + np.exp(-x))

        def loss(score, start, gaps):
            cut = [start + sum(np.exp(gaps[:k])) for k in range(levels - 1)]
            tails = [[1.0, *(sigmoid(s - t) for t in cut), 0.0] for s in score]
            return -sum(c * np.log(t[g] - t[g + 1]) for c, t, g in zip(case, tails, grades))

        value, push, head = quality.slopes(score, grades, start, gaps, case)
        assert value == pytest.approx(loss(score, start, gaps))
        e = 1e-6
        for i in range(9):
            step = np.eye(9)[i] * e
            assert push[i] == pytest.approx((loss(score + step, start, gaps) - loss(score - step, start, gaps)) / (2 * e), abs=1e-5)
        assert head[0] == pytest.approx((loss(score, start + e, gaps) - loss(score, start - e, gaps)) / (2 * e), abs=1e-5)
        for k in range(levels - 2):
            step = np.eye(levels - 2)[k] * e
            assert head[1 + k] == pytest.approx((loss(score, start, gaps + step) - loss(score, start, gaps - step)) / (2 * e), abs=1e-5)


def test_scores_equal_brute_force(spark):
    texts = [*ODD, *(prose(i, 40) for i in range(40)), *("BUY NOW!! 99 " * 9 for _ in range(20))]
    own = docs(spark, texts)
    marks = spark.createDataFrame([(i, int(i < 53), i % 2) for i in range(len(ODD), len(texts))], "doc_id long, quality int, toxic int")
    model = quality.train(own, marks)
    weight = model.weights.astype(np.float32)
    got = {r["doc_id"]: r for r in quality.score(own, marks).collect()}
    for i, t in enumerate(texts):
        at, values = quality.features(t or "", {})
        slow = sum(float(weight[a]) * v for a, v in zip(at.tolist(), values.tolist()))
        tails = [1 / (1 + np.exp(c - slow)) for c in model.thresholds]
        assert (got[i]["expected_grade"], got[i]["p_good"], got[i]["p_best"]) == pytest.approx((sum(tails), tails[0], tails[-1]), abs=1e-6)
        assert got[i]["kept"] == (got[i]["p_best"] >= 0.5)
        counts = defaultdict(int)  # the words' features once more, by hand
        for w in WORD.findall(t or ""):
            counts[zlib.crc32(w.strip(".,;:!?\"'()#$%&*").lower().encode()) % ((1 << 19) - 8)] += 1
        norm = sum((1 + np.log(c)) ** 2 for c in counts.values()) ** 0.5
        for a, v in zip(at.tolist(), values.tolist()):
            if a < (1 << 19) - 8:
                assert v == pytest.approx((1 + np.log(counts[a])) / norm)
