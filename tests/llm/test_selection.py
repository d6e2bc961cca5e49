"""Resampling, inner products and fill-in-the-middle against brute force, with their edge cases."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from chronoloom.llm import fim, innerproducts, resampling, rope

SCHEMA = "doc_id long, text string, weight string, rank string, form string, n string"
UNIT = r"[A-Za-z]+|[^A-Za-z]"


# Fill-in-the-middle
def test_rope_by_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        text = "".join(rng.choice("ab <PSM>é1\n😀") for _ in range(rng.randrange(60)))
        whole, units = rope.build(text, rng.choice([1, 2, 5, 50])), re.findall(UNIT, text)
        rank = rng.randrange(len(units) + 1)
        left, right = rope.split(whole, rank)
        assert (rope.text_of(left), rope.text_of(right)) == ("".join(units[:rank]), "".join(units[rank:]))
        assert (whole.units, whole.chars, left.units, left.chars) == (len(units), len(text), rank, len("".join(units[:rank])))
        assert rope.text_of(rope.concat(right, rope.concat(rope.build("<P>"), left))) == "".join(units[rank:]) + "<P>" + "".join(units[:rank])
        assert rope.find(whole, "<P") == text.find("<P") and rope.unit_rank(whole, len("".join(units[:rank]))) == rank


def test_rope_stays_balanced_and_refuses_to_join_letters():
    rng, whole = random.Random(2), rope.build("a b " * 5000, 8)
    for _ in range(400):
        left, right = rope.split(whole, 2 * rng.randrange(whole.units // 2))
        whole = rope.concat(right, left)
    assert whole.units == 20000 and whole.height <= 1.45 * math.log2(20000 / 2)
    with pytest.raises(ValueError):
        rope.concat(rope.build("ab"), rope.build("cd"))
    long = "x" * 50000 + " y"
    assert rope.build(long).units == 3 and rope.text_of(rope.split(rope.build(long), 1)[0]) == "x" * 50000


def slow_form(doc_id, text, rates=(90, 20)):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(UNIT, text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rates[0]:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < rates[1]
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_forms_by_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\r\n", "é😀é", "<P>", "a<M>b", "<S", "< P>", "x" * 30000, "word " * 20000, "😀" * 9000] + ["".join(rng.choice("ab<PSM> é\n") for _ in range(rng.randrange(40))) for _ in range(150)]
    rows = [(i, t, "w", "r", "f", "n") for i, t in enumerate(texts)] + [(None, "no id at all", "", "", "", ""), (3, texts[3], "w", "r", "f", "n"), (2**60 + 1, "large id here", "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = fim.form_documents(docs)
    found = sorted(((r["doc_id"], tuple(r)[1:]) for r in got.collect()), key=repr)
    assert found == sorted(((i, slow_form(i, t)) for i, t, *_ in rows), key=repr)
    assert {"psm", "spm", "plain"} == {f[1][1] for f in found}
    back = sorted(((r["doc_id"], r["t"]) for r in got.select("doc_id", fim.restored("output", "form").alias("t")).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert fim.report(fim.form_documents(spark.createDataFrame([], SCHEMA))).count() == 0


# Importance resampling
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_resample(docs, target, grams, buckets, percent, least):
    runs = lambda t: [crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [words_of(t)] for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in docs:
        for b in runs(x):
            s[b] += 1
    for x in target:
        for b in runs(x):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        own = runs(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain[b] for b in own) / len(own)) if own else 0
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words_of(x))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = fit[: len(fit) * percent // 100]
    return sorted([(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in fit[len(drawn) :] + [r for r in rows if r[4] < least]], key=repr)


@pytest.mark.parametrize("grams,buckets,percent,least", [(1, 10_000, 10, 20), (2, 65_536, 60, 3), (3, 7, 100, 0)])
def test_resampling_by_brute_force(spark, monkeypatch, grams, buckets, percent, least):
    monkeypatch.setattr(resampling, "BLOCK_FEATURES", 300)
    rng = random.Random(grams)
    some = [f"w{rng.randrange(40)}" for _ in range(60)] + ["É", "Straße", "日本", "Ab", "a-b", "x_y"]
    docs = [(i, " ".join(rng.choices(some, k=rng.randrange(60)))) for i in range(200)] + [(200, None), (201, ""), (202, "..!"), (None, "no id " * 15), (5, "another text of five " * 8), (300, "w1 " * 30_000)]
    docs += [(7, "equal rows " * 20)] * 5
    target = [" ".join(rng.choices(some[:10], k=30)), None, "", "É Straße ab"]
    frame = spark.createDataFrame([(i, t, "w", "r", "f", "n") for i, t in docs], SCHEMA).repartition(4)
    got = resampling.resample(frame, spark.createDataFrame([(t, 1) for t in target], "text string, item_id long"), grams, buckets, percent, least)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_resample(docs, target, grams, buckets, percent, least)


def test_resampling_of_empty_tables(spark):
    none, text = spark.createDataFrame([], SCHEMA), "text string"
    assert resampling.resample(none, spark.createDataFrame([("a",)], text)).count() == 0
    docs = spark.createDataFrame([(i, "some words here " * 9, "", "", "", "") for i in range(30)], SCHEMA)
    got = resampling.resample(docs, spark.createDataFrame([], text)).collect()
    assert len(got) == 30 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]


def test_runs_of_streams():
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 50, n).astype("<u2") for n in (0, 1, 1000, 77)]
    keys, lengths = resampling.merge_runs([resampling.encode_runs(s) for s in streams])
    want = np.bincount(np.concatenate(streams), minlength=50)
    assert keys.tolist() == np.flatnonzero(want).tolist() and lengths.tolist() == want[want > 0].tolist()


def test_many_equal_rows_are_drawn_and_returned(spark):
    docs = spark.range(50_000).selectExpr("cast(null as long) doc_id", "repeat('equal words ', 12) text")
    got = resampling.resample(docs, spark.createDataFrame([("equal",)], "text string")).selectExpr("count(*)", "count(rank)", "count(distinct rank)", "max(rank)").first()
    assert tuple(got) == (50_000, 5_000, 5_000, 5_000)


# Inner products
VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def slow_top(rows, every, k):
    clean = []
    for at, (i, v) in enumerate(rows):
        if v is not None and not any(x is None or not math.isfinite(x) for x in v):
            clean.append((at, i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, i, v in clean:
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for other, j, w in clean if other != at and len(w) == len(v)]
            out += [(i, n, None if missing else j, -s) for n, (s, missing, j) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed, n=700):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 12)) * np.geomspace(1, 0.02, 12) * rng.pareto(1.5, n)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    hot = x[50].tolist()
    rows += [(1000 + i, hot) for i in range(60)] + [(50, hot), (50, (x[50] * 2).tolist()), (100, x[100].tolist()), (100, x[100].tolist())]
    rows += [(None, hot), (None, x[3].tolist()), (2000, None), (2050, [1.0, None] + [0.0] * 10), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, []), (2201, []), (2250, [1.0, 2.0]), (2251, [3.0, 4.0]), (2252, [0.0, -1.0]), (2300, [0.0] * 12), (2350, [1e30] * 12)]
    return rows


@pytest.mark.parametrize("block,group", [(None, 8192), (40, 3)])
def test_top_k_by_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(innerproducts, "TILE", 16)
    rows = vectors(6)
    frame = spark.createDataFrame([(i, v, "s", "r") for i, v in rows], VECTORS).repartition(5)
    got = sorted(map(tuple, innerproducts.top_k(frame, block=block, group=group).collect()), key=repr)
    assert got == slow_top([(i, v) for i, v in rows if i != 2350], 50, 5)  # 1e30 is too large for exact scores: it takes no part


def test_bounds_leave_products_out_and_lose_none():
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(3000, 32)) * np.geomspace(1, 0.05, 32) * rng.pareto(2, 3000)[:, None]).astype(np.int64)
    x = x[np.argsort(-np.linalg.norm(x, axis=1), kind="stable")]
    q = x[rng.integers(0, 3000, 40)]
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    best, computed = innerproducts.search(q, q @ turn, np.full(40, innerproducts.LEAST), x, x @ turn, [np.array([i]) for i in range(3000)], 6)
    want = np.sort(q @ x.T, axis=1)[:, :-7:-1]
    assert all(best.rows[1][best.rows[0] == i].tolist() == want[i].tolist() for i in range(40))
    assert computed < 0.1 * 40 * 3000


def test_top_k_of_few_and_no_vectors(spark):
    assert innerproducts.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [0.5, 0.5], "", ""), (2, [1.0, 0.0], "", "")], VECTORS)
    assert sorted(map(tuple, innerproducts.top_k(few).collect())) == [(0, 1, 2, 65536), (0, 2, 1, 32768)]


def test_many_equal_query_rows(spark):
    rows = spark.range(3_000).selectExpr("cast(50 as long) vec_id", "array(cast(1 as float), cast(2 as float)) embedding")
    got = innerproducts.top_k(rows.unionByName(rows.limit(1).selectExpr("cast(7 as long) vec_id", "embedding")))
    assert got.count() == 15_000 and got.where("vec_id = 7").count() == 3_000 and got.where("rank = 1 AND vec_id = 7").count() == 3_000
