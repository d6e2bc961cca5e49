"""Shards of given links and files of packed rows, by brute force and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import fim, fingerprints, lm, neardup, packing, sharding

SCHEMA = "doc_id long, text string, shard string, weight string"


def cut_of(placed, edges, first):
    weight = {}
    for a, b, w in edges:
        if a != b and a in first and b in first and w and w > 0:
            weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0) + w
    return sum(w for (a, b), w in weight.items() if first[a] != first[b])


def test_shards_of_a_graph_are_level_and_cut_little(spark):
    rng = np.random.default_rng(21)
    docs = [(i, "t", "x", "y") for i in range(600)] + [(None, "t", "x", "y")] * 5 + [(7, "other", "x", "y")] * 4
    # Communities of twenty, a hub that a third of all links lead to, links to nowhere and to itself.
    edges = [(int(20 * c + a), int(20 * c + b), 1.0) for c in range(30) for a, b in rng.integers(0, 20, (60, 2))]
    edges += [(0, int(i), 0.01) for i in rng.integers(1, 600, 900)] + [(3, 3, 5.0), (4, 99_999, 5.0), (None, 4, 1.0), (5, 6, None), (5, 6, -2.0), (5, 6, 1.0), (6, 5, 1.0)]
    placed, cut = sharding.shard_graph(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(edges, "a long, b long, weight double"), 6, 8)
    rows = placed.collect()
    sizes = np.bincount([r["shard"] for r in rows], [r["copies"] for r in rows], 6)
    assert sizes.sum() == 609 and sizes.max() - sizes.min() <= 1
    copies = {}
    for r in rows:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    assert copies == {i: 5 if i in (7, None) else 1 for i in [*range(600), None]}
    first = {}
    for r in sorted(rows, key=lambda r: r["shard"]):
        first.setdefault(r["doc_id"], r["shard"])
    before, after = cut.first()
    assert round(after, 6) == round(cut_of(rows, [e for e in edges if None not in e[:2]], first), 6) and after < 0.5 * before
    again = {tuple(r) for r in sharding.shard_graph(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(edges, "a long, b long, weight double").repartition(4), 6, 8)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_graphs_without_links_or_documents(spark):
    none = spark.createDataFrame([], "a long, b long, weight double")
    placed, cut = sharding.shard_graph(spark.createDataFrame([(i, "", "", "") for i in range(10)], SCHEMA), none, 4)
    sizes = np.bincount([r["shard"] for r in placed.collect()], minlength=4)
    assert sorted(sizes) == [2, 2, 3, 3] and tuple(cut.first()) == (0.0, 0.0)
    placed, cut = sharding.shard_graph(spark.createDataFrame([], SCHEMA), none, 4)
    assert placed.count() == 0 and tuple(cut.first()) == (0.0, 0.0)


def test_packed_files_are_the_packed_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "FILE_ROWS", 3)
    texts = [None, "", "one two three " * 200, "é 日本 " * 90, "word " * 9000, "tail"] + [f"number {i} " * (i % 60) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "s", "w") for i, t in enumerate(texts)] + [(None, "no id", "s", "w"), (2**60 + 1, "large id", "s", "w")], SCHEMA)
    packed = packing.pack_documents(docs).persist()
    packing.write_packed(packed, f"file://{tmp_path}/packed")
    plain = lambda r: (bytes(r["ids"]), *(tuple(r[c]) for c in ("cu_seqlens", "resets", "doc_ids", "offsets", "lengths")))
    back = packing.read_packed(spark, f"file://{tmp_path}/packed").collect()
    assert sorted(map(plain, back), key=repr) == sorted(map(plain, packed.collect()), key=repr)
    assert any(2**60 + 1 in r["doc_ids"] for r in back) and any(None in r["doc_ids"] for r in back)
    stored = spark.read.parquet(f"file://{tmp_path}/packed").collect()
    assert all(len(f["ids"]) == 4 * f["n_rows"] * f["row_length"] and 1 <= f["n_rows"] <= 3 for f in stored) and len(stored) > 1
    packing.write_packed(packed.limit(0), f"file://{tmp_path}/none")
    assert packing.read_packed(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("operator", [fingerprints.fingerprint_documents, lambda d: lm.score_corpus(d, F.lit(False)), fim.form_documents, neardup.near_classes, packing.pack_documents])
def test_large_ids_stay_exact_beside_missing_ones(spark, operator):
    ids = [2**60 + 1, 2**60 + 3, None, -(2**61) - 7, 5]
    docs = spark.createDataFrame([(i, f"some text of number {n} here", "s", "w") for n, i in enumerate(ids)], SCHEMA).coalesce(1)
    out = operator(docs)
    got = out.select(F.explode("doc_ids").alias("doc_id")) if "doc_ids" in out.columns else out
    assert sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=repr) == sorted(ids, key=repr)
